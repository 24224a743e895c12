"""What several operators share: the cluster's shared folder, cutting lineage, connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What rows of a bucket are dealt and sorted by: table, key, and the two blocks that meet.
BY = ["t", "key", "lo", "hi"]
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) gets a new one; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder. What is written there goes when the session's JVM ends, or earlier by drop_path()."""
    path = f"{shared_folder(spark)}/tarazu-{what}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    for made in getattr(_open, "lists", []):
        made.append(path)
    return path


_open = threading.local()  # of each thread: the lists of new paths, one for each dropping_temporaries() that it is in


@contextmanager
def dropping_temporaries(spark: SparkSession):
    """Drops at its end what its own thread wrote to new paths inside it; for work whose result has been written by then."""
    made: list[str] = []
    _open.lists = [*getattr(_open, "lists", []), made]
    try:
        yield
    finally:
        _open.lists = _open.lists[:-1]
        for path in made:
            drop_path(spark, path)


def materialise(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write df once to the shared folder and read it back: later steps neither recompute it nor depend on lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def may_match(df: DataFrame, key, keys: DataFrame, bits: int = 24) -> DataFrame:
    """df with __may: false only where the key (a hash, long) isn't among those of keys (one column of such hashes).

    A bitmap of 2^bits bits, of the keys modulo its size, is broadcast: at most 2^(bits - 6) rows of two numbers, 4 MB,
    however many keys there are; more keys only mean that more rows may match. So wide rows without a match needn't be shuffled to find that out.
    """
    word = lambda k: F.shiftright(k.bitwiseAND(F.lit((1 << bits) - 1)), 6)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))
    k = F.col(keys.columns[0])
    held = keys.select(word(k).alias("__word"), bit(k).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__held"))
    out = df.join(F.broadcast(held), word(key) == F.col("__word"), "left")
    return out.withColumn("__may", F.coalesce(F.col("__held").bitwiseAND(bit(key)) != 0, F.lit(False))).drop("__word", "__held")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as make them differ from all columns of df."""
    held = {c.lower() for c in df.columns}
    dash = "__"
    while any(dash + n.lower() in held for n in names):
        dash += "_"
    return [dash + n for n in names]


def word_count(text):
    """Number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_blocks(keyed: DataFrame, block: int, rows: DataFrame, by: str = "uid") -> DataFrame:
    """(t, key, lo, hi, own, uid, …): the rows of keyed (uid, t, key) that share their bucket, with the columns of rows, dealt and sorted by BY.

    A bucket over `block` rows is cut into blocks by a hash of the column `by`; each block meets itself and each other one in a group of its own.
    """
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, ["t", "key"]).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    met = met.join(rows, "uid").withColumn("own", F.pmod(F.xxhash64(F.lit(1), by), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("t", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", *rows.columns)
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(parts, *BY).sortWithinPartitions(*BY)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root being the least node that it can reach.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step hooks a node's
    neighbours to their least neighbour, so the number of rounds grows with the logarithm of the
    longest path. A round is two partial aggregations and two joins of edges with one row per node;
    a node with very many edges is a skewed join side, which AQE splits. Each round's edges go to
    the shared folder, so no lineage builds up and lost executors cost one round at most.
    Loops and repeated edges are ignored; edges with a null end are dropped; no edges give no rows.
    """
    spark = edges.sparkSession
    pair = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now, path = materialise(pair.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        )
        after, new = materialise(small, "edges")
        drop_path(spark, path)
        now, path, count = after, new, state(after)
        if count == before:
            break
        before = count
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
