"""Resumable processing of files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_available(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema, step: Callable[[DataFrame], DataFrame], fmt: str = "parquet", max_files: int = 64, case: list[str] | None = None) -> None:
    """Apply step to every input file not yet processed, each finished batch saved once, and return.

    The checkpoint remembers finished batches. A batch that ran but wasn't recorded runs again under the
    same number and replaces its own folder, so its rows are never there twice. With `case`, rows that agree in these columns
    are one case, and only the first that arrives is processed, whatever files and runs the others come in: the keys
    are kept as state beside the checkpoint (in RocksDB, so on disk), committed with the batch.
    """

    def save(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(in_dir)
    if case:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        stream = stream.dropDuplicates(case)
    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
