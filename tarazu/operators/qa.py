"""Translation checks over pairs (source_id, field, source_text, target_text, rule), review and release."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.functions.seeded import h32
from tarazu.functions.text import numbers, script_share, words
from tarazu.operators.prep import glossary_hits, sample_fixed

#: Standard normal quantile of a 95 % interval. Fixed value.
Z95 = 1.959963984540054


def keep_identical(pairs: DataFrame) -> DataFrame:
    """Keep-fields: ok where both texts are equal byte by byte (two nulls are equal)."""
    return pairs.where("rule = 'keep'").select("source_id", "field", F.encode("source_text", "UTF-8").eqNullSafe(F.encode("target_text", "UTF-8")).alias("ok"))


def numbers_survive(pairs: DataFrame) -> DataFrame:
    """ok where both texts hold the same numbers as often, whatever the digits."""
    return pairs.select("source_id", "field", (numbers(F.col("source_text")) == numbers(F.col("target_text"))).alias("ok"))


def language_ok(pairs: DataFrame, script: str = "Arabic", least: float = 0.5) -> DataFrame:
    """Translated fields: ok where at least that share of the letters is in the script; false without a letter."""
    share = script_share(F.col("target_text"), script)
    return pairs.where("rule = 'translate'").select("source_id", "field", F.coalesce(share >= least, F.lit(False)).alias("ok"))


def length_ratio(pairs: DataFrame, low: float = 0.4, high: float = 2.5) -> DataFrame:
    """Translated fields: ok where the target isn't empty and its length is within the ratios to the source's."""
    ratio = F.try_divide(F.length("target_text").cast("double"), F.length("source_text").cast("double"))
    ok = (F.length(F.trim(F.col("target_text"))) > 0) & ratio.between(low, high)
    return pairs.where("rule = 'translate'").select("source_id", "field", F.round(ratio, 6).alias("ratio"), F.coalesce(ok, F.lit(False)).alias("ok"))


def looping(pairs: DataFrame, n: int = 3, share: float = 0.3, times: int = 4) -> DataFrame:
    """ok unless the commonest word n-gram of the target makes up at least `share` of them and occurs `times` times.

    Counted within the row, by 64-bit hashes of the n-grams: a translation's words never leave their task.
    """
    w = words(F.col("target_text"))
    d = pairs.select("source_id", "field", w.alias("w"))
    gram = F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda k: F.xxhash64(F.slice("w", k, n)))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("g", F.array_sort(gram)).withColumn("total", F.size("g"))
    run = F.aggregate("g", F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).alias("n"), F.lit(0).alias("best")), lambda a, x: F.struct(x.alias("x"), F.when(x == a["x"], a["n"] + 1).otherwise(1).alias("n"), F.greatest(a["best"], F.when(x == a["x"], a["n"] + 1).otherwise(1)).alias("best")), lambda a: a["best"])
    d = d.withColumn("top", run)
    return d.select("source_id", "field", F.col("total").cast("long").alias("total"), F.col("top").cast("long").alias("top"), (~((F.col("top") >= times) & (F.col("top") >= share * F.col("total")))).alias("ok"))


def glossary_match(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(source_id, en_term, ok): each glossary term, of one word or more, in a case's source, ok where every field that has it has its rendering in the target.

    Terms are found by the source texts alone and meet the targets by the sources' MD5, so a target moves once and not with each place of a term.
    """
    named = pairs.select("source_id", "source_text", F.md5("source_text").alias("k"), F.lower(F.coalesce("target_text", F.lit(""))).alias("t"))
    hits = glossary_hits(named, glossary, "source_text", ["k"]).select("k", F.array_distinct("terms").alias("terms")).groupBy("k").agg(F.first("terms").alias("terms"))
    hit = named.select("source_id", "k", "t").join(hits, "k").select("source_id", "t", F.explode("terms").alias("en_term"))
    hit = hit.join(glossary.select("en_term", "fa_term"), "en_term")
    return hit.groupBy("source_id", "en_term").agg(F.bool_and(F.contains("t", F.lower("fa_term"))).alias("ok"))


FLAG_KINDS = ("meaning", "urgency", "negation", "actor")


def meaning_flags(cases: DataFrame, verdicts: DataFrame, kinds: tuple[str, ...] = FLAG_KINDS) -> DataFrame:
    """(source_id, one column per kind, meaning_flag): the checker's verdicts beside each case; without a verdict: false."""
    wide = verdicts.groupBy("source_id").pivot("flag_kind", list(kinds)).agg(F.bool_or("flagged"))
    out = cases.select("source_id").distinct().join(wide, "source_id", "left")
    out = out.select("source_id", *[F.coalesce(k, F.lit(False)).alias(k) for k in kinds])
    return out.withColumn("meaning_flag", reduce(lambda a, b: a | b, [F.col(k) for k in kinds]))


def qa_flags(checks: dict[str, DataFrame]) -> DataFrame:
    """(source_id, check, ok): each case's verdict by check; ok only if all its fields are."""
    return reduce(DataFrame.unionByName, [c.groupBy("source_id").agg(F.bool_and("ok").alias("ok")).withColumn("check", F.lit(name)) for name, c in checks.items()])


def qa_summary(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, cases, pass_rate), and the row `all` for cases that pass everything they were checked for."""
    flags = qa_flags(checks)
    each = flags.groupBy("check").agg(F.count("*").alias("cases"), F.avg(F.col("ok").cast("double")).alias("pass_rate"))
    every = flags.groupBy("source_id").agg(F.bool_and("ok").alias("ok")).agg(F.lit("all").alias("check"), F.count("*").alias("cases"), F.avg(F.col("ok").cast("double")).alias("pass_rate"))
    return each.unionByName(every)


def review_queue(flags: DataFrame, n: int = 125, seed: int = 0) -> DataFrame:
    """(source_id, reason): every flagged case, and n random ones of the rest. flags: (source_id, flagged)."""
    hit = flags.where("flagged").select("source_id", F.lit("flagged").alias("reason"))
    return hit.unionByName(sample_fixed(flags.where("not flagged"), n, seed, "source_id").select("source_id", F.lit("random").alias("reason")))


def wilson(p, n):
    """(low, high) of the 95 % Wilson interval."""
    z2 = Z95 * Z95
    middle, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z95 / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return middle - half, middle + half


def review_error_rate(queue: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row (n, errors, rate, low, high) of the random part; an outcome other than `ok` is an error."""
    d = queue.where("reason = 'random'").join(reviews, "source_id").agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("outcome") != "ok").cast("long")), F.lit(0)).alias("errors"))
    d = d.withColumn("rate", F.try_divide(F.col("errors").cast("double"), F.col("n").cast("double")))
    low, high = wilson(F.col("rate"), F.when(F.col("n") > 0, F.col("n").cast("double")))
    return d.withColumn("low", low).withColumn("high", high)


def review_apply(pairs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Pairs after review: dropped cases are gone, fixed ones have the reviewer's text."""
    d = pairs.join(reviews.select("source_id", "outcome", "fix_text"), "source_id", "left").where("outcome is null or outcome <> 'drop'")
    return d.withColumn("target_text", F.when(F.col("outcome") == "fix", F.coalesce("fix_text", "target_text")).otherwise(F.col("target_text"))).drop("outcome", "fix_text")


def pilot_blind(candidates: DataFrame, seed: int = 0) -> DataFrame:
    """(source_id, a, b, swapped): two candidates' texts under the names A and B by the parity of a hash."""
    swapped = h32(F.lit(seed), F.col("source_id")) % 2 == 1
    return candidates.select("source_id", F.when(swapped, F.col("second")).otherwise(F.col("first")).alias("a"), F.when(swapped, F.col("first")).otherwise(F.col("second")).alias("b"), swapped.alias("swapped"))


def pilot_tally(blind: DataFrame, votes: DataFrame) -> DataFrame:
    """One row (first_wins, second_wins, ties) from votes (source_id, vote: a, b or tie)."""
    d = blind.join(votes, "source_id")
    first = ((F.col("vote") == "a") & ~F.col("swapped")) | ((F.col("vote") == "b") & F.col("swapped"))
    return d.agg(F.sum(first.cast("long")).alias("first_wins"), F.sum(((F.col("vote") != "tie") & ~first).cast("long")).alias("second_wins"), F.sum((F.col("vote") == "tie").cast("long")).alias("ties"))


def release_parity(original: DataFrame, translated: DataFrame) -> DataFrame:
    """(id, problem) where the sets differ: missing, extra, split or gold. Both: (id, split, gold label as text)."""
    a, b = original.select("id", F.col("split").alias("s1"), F.col("label").alias("l1"), F.lit(1).alias("x")), translated.select("id", F.col("split").alias("s2"), F.col("label").alias("l2"), F.lit(1).alias("y"))
    problem = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(~F.col("s1").eqNullSafe(F.col("s2")), "split").when(~F.col("l1").eqNullSafe(F.col("l2")), "gold")
    return a.join(b, "id", "full").select("id", problem.alias("problem")).where("problem is not null")


def checker_agreement(verdicts: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row (tp, fp, fn, tn, precision, recall): the checker's flags (source_id, flagged) against human errors."""
    d = verdicts.join(reviews.select("source_id", (F.col("outcome") != "ok").alias("bad")), "source_id")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    f, b = F.col("flagged"), F.col("bad")
    d = d.agg(n(f & b).alias("tp"), n(f & ~b).alias("fp"), n(~f & b).alias("fn"), n(~f & ~b).alias("tn"))
    return d.withColumn("precision", F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")))
