"""From raw documents to packed training sequences: five stages, each written as Parquet before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarazu.llm import langid, linededup, mixing, packing, simhash
from tarazu.llm.common import drop_path, dropping_temporaries, materialise, may_match, new_path
from tarazu.llm.queries import tokenizer_path

#: A document whose language is less probable than this is rejected.
MIN_SCORE = 0.5


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed, and their new names: an operator's own columns then take no input column's place, whatever its name."""
    own = {c: f"own_{k}_{c}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(v) for c, v in own.items()]), own


def back(out: DataFrame, own: dict[str, str]) -> DataFrame:
    return out.select(*[F.col(f"`{v}`").alias(c) for c, v in own.items()])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; those without a letter or with an unsure prediction go.

    Null and empty texts have no letter; null ids and repeated rows are judged by their texts like others, long texts whole;
    a tie between languages is decided by name. All columns stay as they are, whatever their names. An empty table stays empty.
    """
    renamed, own = apart(docs)
    found = langid.identify(renamed, own["doc_id"], own["text"], own["lang"])
    return back(found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)), own)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their site's boilerplate lines; n_chars follows the text.

    All rows stay: null texts stay null, texts of boilerplate alone become empty, a null source is a site, repeated rows are pages;
    a line right at the ratio stays. All columns but text and n_chars stay as they are, whatever their names. An empty table stays empty.
    """
    renamed, own = apart(docs)
    out = linededup.drop_boilerplate(renamed, own["source"], own["text"])
    if "n_chars" in own:
        out = out.withColumn(own["n_chars"], F.length(own["text"]).cast(docs.schema["n_chars"].dataType))
    return back(out, own)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more): that with the least doc_id, rows with a null doc_id last; of these that with the least MD5 of its text.

    Rows are told apart by doc_id and text, so neither a null nor a repeated doc_id takes other texts with it. Of rows equal in both, the least by the other columns stays.
    Null, empty and blank texts are copies of each other. Texts of any length count whole. An empty table stays empty.
    All columns stay as they are, whatever their names.
    What goes or repeats is written first; of the texts only those move that are among it, or may be by a bitmap.
    """
    docs, own = apart(docs)
    doc_id, text = F.col(own["doc_id"]), F.col(own["text"])
    row = F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), F.md5(text).alias("h"))
    groups, _ = materialise(simhash.similar_groups(docs.select(row.alias("row"), text.alias("text")), id_col="row"), "groups")
    key = lambda i, h: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), F.coalesce(h, F.lit("null")))
    named = groups.select(key(F.col("row.doc_id"), F.col("row.h")).alias("of"), (~F.col("row").eqNullSafe(F.col("component_id"))).alias("gone"))
    found, _ = materialise(named.groupBy("of").agg(F.max("gone").alias("gone"), F.count("*").alias("n")).where("gone or n > 1").select("of", "gone"), "found")
    keyed = may_match(docs.withColumn("k", key(doc_id, F.md5(text))), F.xxhash64("k"), found.select(F.xxhash64("of")))
    # the window and the join are dealt by one key: a text that moves does so once, of equal rows in a task only one
    same = W.partitionBy("k").orderBy(*[F.col(f"`{v}`") for c, v in own.items() if c not in ("doc_id", "text")], F.lit(0))
    some = keyed.where("__may").withColumn("n", F.row_number().over(same)).where("n = 1")
    some = some.join(found, F.col("k") == F.col("of"), "left").where("gone is null or not gone")
    return back(keyed.where("not __may"), own).unionByName(back(some, own))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, each copy at its own place in the order of training.

    Null and empty texts have no words and are never taken; a null source is a source; repeated rows are taken one by one, ties in place broken by
    id and text. All columns stay as they are, whatever their names. An empty table stays empty.
    """
    renamed, own = apart(docs)
    return back(mixing.mix(renamed, own["doc_id"], own["text"], own["source"], partial=False, keep=True, per_copy=True), own)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens. Null texts are the end id alone, repeated rows are packed as often as they occur, long texts are cut; ties in size are broken by hash; other columns are not read; an empty table gives no rows."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language ID", known_language), ("line dedup", without_boilerplate), ("SimHash near-dedup", without_near_copies), ("mixing sources", mixed), ("packing", packed)]

#: Tokens and learned weights have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{k}")
        with dropping_temporaries(spark):  # what operators wrote aside for this stage
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
