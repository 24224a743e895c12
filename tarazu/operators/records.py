"""Decision records: conversion, long form, validation, profile, licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarazu.sources.schema import ORIGINS, QUESTION_TYPES, RECORD, SPLITS


def rec_map(df: DataFrame, mapping: dict[str, Column]) -> DataFrame:
    """Any source in the record schema; unmapped fields are null."""
    return df.select(*[mapping.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD])


def option_array(*pairs: tuple[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("text")) for i, t in pairs])


def one_hot(options: Column, label: Column) -> Column:
    """Gold of a hard label: 1 for its option, 0 for the others. Null if the label is no option."""
    ids = F.transform(options, lambda o: o["id"])
    gold = F.map_from_arrays(ids, F.transform(ids, lambda i: F.when(i == label, 1.0).otherwise(0.0)))
    return F.when(F.array_contains(ids, label), gold)


def gold_one_hot(df: DataFrame, label: str) -> DataFrame:
    """Hard labels as distributions; rows that have a soft gold keep it."""
    return df.withColumn("gold", F.coalesce(F.col("gold"), one_hot(F.col("options"), F.col(label))))


def case_to_decisions(cases: DataFrame, decisions: str = "decisions") -> DataFrame:
    """A row per question of a case: the case's columns, position, and the question's fields."""
    rest = [c for c in cases.columns if c != decisions]
    return cases.select(*rest, F.posexplode(decisions).alias("position", "d")).select(*rest, "position", "d.*")


def explode_options(records: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """The long form: a row per option with its index and gold probability."""
    out = records.select(*keep, "gold", F.posexplode("options").alias("idx", "o"))
    return out.select(*keep, "idx", F.col("o.id").alias("option_id"), F.col("o.text").alias("option_text"), F.coalesce(F.try_element_at("gold", "o.id"), F.lit(0.0)).alias("g"))


def rec_validate(records: DataFrame) -> DataFrame:
    """(id, violations): the broken rules of each record that breaks any."""
    ids = F.transform("options", lambda o: o["id"])
    total = F.aggregate(F.map_values("gold"), F.lit(0.0), lambda a, p: a + p)
    keys = (F.size(F.array_except(ids, F.map_keys("gold"))) == 0) & (F.size(F.array_except(F.map_keys("gold"), ids)) == 0)
    rules = {
        "gold_sum": F.coalesce(F.abs(total - 1) > 1e-6, F.lit(True)),
        "gold_keys": F.coalesce(~keys, F.lit(True)),
        "origin": ~F.coalesce(F.col("origin").isin(*ORIGINS), F.lit(False)),
        "question_type": ~F.coalesce(F.col("question_type").isin(*QUESTION_TYPES), F.lit(False)),
        "split": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)),
        "null_id": F.col("id").isNull() | F.col("source_id").isNull(),
        "duplicate_id": F.col("times") > 1,
    }
    times = records.groupBy("id").agg(F.count("*").alias("times")).where("times > 1 and id is not null")
    found = records.join(times, "id", "left").withColumn("times", F.coalesce("times", F.lit(1)))
    broken = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return found.select("id", F.array_join(broken, ",").alias("violations")).where("violations <> ''")


def dataset_profile(records: DataFrame) -> DataFrame:
    """Counts by source, split, origin and type, with subtotals by source and in all (level: the number of columns summed over)."""
    return (
        records.groupingSets([["source", "split", "origin", "question_type"], ["source", "split"], ["source"], []], "source", "split", "origin", "question_type")
        .agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("cases"), F.grouping_id("source", "split", "origin", "question_type").cast("long").alias("level"))
    )


#: A prime below 2^61: versions are sums of row numbers modulo it.
PRIME = (1 << 61) - 1


def row_number(columns: list[str]) -> Column:
    """60 bits of the MD5 of a row: each field as `-` if null, else its length in bytes, `:` and the field, so that no two rows read alike."""
    texts = [F.col(c).cast("string") for c in columns]
    said = F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("bigint")


def _total(number: Column) -> Column:
    return (F.coalesce(F.sum(number.cast("decimal(20,0)")), F.lit(0)) % F.lit(PRIME)).cast("bigint")


def dataset_version_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, version): a hash of the rows as a multiset, a sum that depends on no order and in which equal rows don't cancel."""
    return df.select(row_number(columns).alias("number")).agg(F.count("*").alias("n"), _total(F.col("number")).alias("version"))


def version_buckets(df: DataFrame, columns: list[str], id_col: str = "id", buckets: int = 1024) -> DataFrame:
    """(bucket, n, version): the same for each bucket of ids. The version of the whole is the sum of these modulo PRIME, so stored buckets merge and are compared without the rows."""
    b = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))
    return df.select(b.alias("bucket"), row_number(columns).alias("number")).groupBy("bucket").agg(F.count("*").alias("n"), _total(F.col("number")).alias("version"))


def version_diff(old: DataFrame, new: DataFrame, columns: list[str], id_col: str = "id", buckets: int = 1024) -> DataFrame:
    """(id, change): ids whose rows were `added`, `removed` or `changed` between two versions; only rows of buckets whose versions differ are compared."""
    both = version_buckets(old, columns, id_col, buckets).withColumn("side", F.lit(0)).union(version_buckets(new, columns, id_col, buckets).withColumn("side", F.lit(1)))
    differ = both.groupBy("bucket", "n", "version").agg(F.count("*").alias("sides")).where("sides = 1").select("bucket").distinct()
    b = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))
    rows = [df.select(F.col(id_col).alias("id"), b.alias("bucket"), row_number(columns).alias("number"), F.lit(k).alias("side")).join(F.broadcast(differ), "bucket", "left_semi") for k, df in enumerate((old, new))]
    per = rows[0].union(rows[1]).groupBy("id").agg(*[F.count_if(F.col("side") == k).alias(f"n{k}") for k in (0, 1)], *[_total(F.when(F.col("side") == k, F.col("number"))).alias(f"v{k}") for k in (0, 1)])
    change = F.when(F.col("n0") == 0, "added").when(F.col("n1") == 0, "removed").otherwise("changed")
    return per.where("n0 <> n1 or v0 <> v1").select("id", change.alias("change"))


def license_release_filter(records: DataFrame, policy: DataFrame, purpose: str) -> DataFrame:
    """Records whose licence allows the purpose (`train`, `test` or `release`); licences without a policy allow nothing."""
    allowed = policy.where(F.col(f"allow_{purpose}")).select("license")
    return records.join(allowed, "license", "left_semi")


def license_audit(records: DataFrame, policy: DataFrame) -> DataFrame:
    """(split, kind, n, bad): records of each restricted kind (NC, GPL, ND) in each split, bad where training isn't allowed."""
    found = records.join(policy.where("kind <> 'open'"), "license")
    return found.groupBy("split", "kind").agg(F.count("*").alias("n"), F.sum(F.when((F.col("split") == "train") & ~F.col("allow_train"), 1).otherwise(0)).alias("bad"))


def dedup_exact(df: DataFrame, key: Column, id_col: str = "id") -> DataFrame:
    """One row of each key: that with the lowest id, a null one last; of equal ids the one whose other fields hash lowest.

    A row number that is cut at 1: each task sends one row of a key at most, so a key that holds most rows is no burden.
    """
    plain = [F.col(f"`{f.name}`") for f in df.schema if "map" not in f.dataType.simpleString()]
    first = W.partitionBy(key).orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(*plain))
    return df.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")


def ranked(df: DataFrame, by: list[str], order: list, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
