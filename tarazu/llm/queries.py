"""The registered queries of this subpackage, with production parameters, each over its whole table."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.llm import alignment, chat, itq, langid, linededup, merkle, mixing, packing, pii, repetition, simhash, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.tarazu.pii.key", None)
    if not key:  # none is built in: without one, pseudonyms are those of this session alone
        key = secrets.token_hex(32)
        spark.conf.set("spark.tarazu.pii.key", key)
    return pii.pseudonymise(_read(spark, sf_dir, "documents"), key).select("doc_id", "text", "pii_found", "pii_kinds")


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "first_position", "second_position")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op4_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op5_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(_read(spark, sf_dir, "documents"))


def op6_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_read(spark, sf_dir, "pages"))
    back = warc.read_archives(spark, index)
    return back.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op7_itq_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(_read(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_boilerplate(_read(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op9_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_turns(turns))


def op11_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]


def op12_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "passages")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    out = merkle.manifest(_read(spark, sf_dir, "documents"), F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")))
    said = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    out = out.withColumns({"proof_sha256": F.sha2(said, 256), "folded_root": merkle.folded(F.col("checked"), F.col("proof"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (op1_pii_pseudonyms, op2_curriculum_mix, op3_language_id, op4_first_fit_packing, op5_repetition_coverage, op6_warc_bundles, op7_itq_near_dups, op8_line_dedup, op9_simhash_bktree, op10_chat_format, op11_pair_bitmaps, op12_toxic_segments, op13_merkle_manifest)}
