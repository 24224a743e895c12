"""Reading pinned sources and logs, publishing records and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_pinned(spark: SparkSession, path: str, fmt: str, schema: StructType | str, source: str, revision: str, license: str, **options) -> DataFrame:
    """A source under an explicit schema, stamped with source, revision and license."""
    df = spark.read.schema(schema).options(**options).format(fmt).load(path)
    return df.withColumn("source", F.lit(source)).withColumn("revision", F.lit(revision)).withColumn("license", F.lit(license))


def parse_state(df: DataFrame, fields: dict[str, tuple[str, str]], state: str = "state") -> DataFrame:
    """df with a typed column for each name: (JSON path, type); null where the state isn't JSON or lacks the path."""
    parsed = df.withColumn("__v", F.try_parse_json(F.col(state)))
    for name, (path, kind) in fields.items():
        parsed = parsed.withColumn(name, F.try_variant_get("__v", path, kind))
    return parsed.drop("__v")


def write_records(records: DataFrame, path: str) -> None:
    """Publish by split and source; rows of a partition come from as few tasks as Spark's rebalancing allows, however large one is."""
    records.hint("rebalance", "split", "source").write.mode("overwrite").partitionBy("split", "source").parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Append a run's raw predictions; readers that filter by run_id read only its folder."""
    predictions.write.mode("append").partitionBy("run_id").parquet(path)


def read_run_logs(spark: SparkSession, path: str, fmt: str, schema: str = "run_id string, step long, metric string, value double") -> DataFrame:
    """Curves from CSV (with header) or JSON lines."""
    reader = spark.read.schema(schema)
    return reader.csv(path, header=True) if fmt == "csv" else reader.json(path)


def to_bench_request(records: DataFrame) -> DataFrame:
    """(id, request): a record as one JSON line of a benchmark request."""
    body = F.struct(F.col("id"), F.col("state"), F.struct(F.col("question_type").alias("type"), F.col("question_text").alias("text"), F.col("options")).alias("question"))
    return records.select("id", F.to_json(body).alias("request"))


def from_bench_response(responses: DataFrame, response: str = "response") -> DataFrame:
    """(id, pred): benchmark response lines, {"id": ..., "probabilities": {option: p}}, as a prediction map."""
    parsed: Column = F.from_json(F.col(response), "id string, probabilities map<string,double>")
    return responses.select(parsed.alias("r")).select(F.col("r.id").alias("id"), F.col("r.probabilities").alias("pred"))


def pending(cases: DataFrame, done: DataFrame, key: str = "source_id") -> DataFrame:
    """Cases that a dropped session has not finished."""
    return cases.join(done.select(key), key, "left_anti")
