"""Mixing sources to target weights: a time-varying curriculum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarazu.llm.common import materialise, word_count

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Weight over training time as knots (time, weight), one schedule for each of WEIGHTS: heavy sources fade, light ones rise.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Rows of one source that are summed in one window, about, or the square root of all rows where that is more: then neither rows in a bucket nor buckets of a source are many.
BUCKET_ROWS = 512


def segments(knots) -> list[tuple[float, ...]]:
    """(c0, c1, t0, dt, slope, level) of each linear piece: the share of the source's demand met at its ends, and its area a x^2 + b x, x from 0 to 1."""
    if any(b[0] <= a[0] for a, b in zip(knots, knots[1:])) or min(w for _, w in knots) < 0:
        raise ValueError("knots need rising times and weights of at least 0")
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total, out, done = sum(areas), [], 0.0
    if total <= 0:
        raise ValueError("a schedule needs some weight")
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
        out.append((done / total, (done + area) / total, t0, t1 - t0, (w1 - w0) * (t1 - t0) / 2 / total, w0 * (t1 - t0) / total))
        done += area
    return out


def position(share: Column, kind: Column, schedules) -> Column:
    """The training time at which a source's cumulative demand reaches the share: its schedule's integral, inverted piece by piece."""
    out = None
    for k, knots in enumerate(schedules):
        for c0, c1, t0, dt, a, b in reversed(segments(knots)):
            area = share - F.lit(c0)
            root = F.sqrt(F.greatest(F.lit(b * b) + F.lit(4 * a) * area, F.lit(0.0)))
            t = F.lit(t0) + F.lit(dt) * F.when(area <= 0, 0.0).otherwise(2 * area / (F.lit(b) + root))
            here = (kind == k) & (share >= c0)
            out = F.when(here, t) if out is None else out.when(here, t)
    return out


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, kind, target) from (source, source_size): shares by weight, none above `most` times its source.

    Sources in the order of their cap per weight: one is capped if the fair rate among it and all
    after it exceeds its cap; the first that is not sets the rate of the rest, which is where
    resharing the excess again and again ends.
    """
    one = W.partitionBy(F.lit(0))  # one row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("kind") + 1)
    s = sizes.withColumn("kind", ((F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)).cast("int"))
    s = s.withColumn("weight", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    s = s.withColumn("j", F.row_number().over(one.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())))
    before = one.orderBy("j").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("budget", F.lit(total_share) * F.sum("source_size").over(one))
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("rate", left / (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("rate", F.min_by("rate", F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.col("j"))).over(one))
    return s.select("source", "source_size", "kind", F.coalesce(F.least("cap", F.col("rate") * F.col("weight")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, schedules=SCHEDULES, total_share: float = 1.5, most: float = 2.0, partial: bool = True, seed: int = 0, keep: bool = False, per_copy: bool = False) -> DataFrame:
    """One row per document in the order of training: id, size, source_size, target, taken, copies, first_position, second_position (null if not taken so often).

    A source's documents follow each other in the order of a hash, pass after pass, until its target is
    met. With `partial` the last document is cut, so the taken words are the rounded target; without, whole
    documents are taken up to the one whose middle lies beyond it. The middle of each taken copy, as a share
    of the source's taken words, gives its training position by the inverted schedule; rows are
    range-sorted by the first. With `keep` all input columns stay (new columns replace equal names). With
    `per_copy` there is a row for each taken copy instead, range-sorted by its own `position`.

    Null text: size 0, never taken. A null source is a source of its own, the last. The hash is that of id and
    text, so rows with null or repeated ids are dealt and ordered by their texts, whole and however long; rows equal
    in both are documents like others, share a bucket, and it doesn't matter which of them is taken. All sizes 0 give
    targets and takings of 0. An empty table gives no rows. Reruns agree. `most` is 2 at most.
    A hot source is summed bucket by bucket of the hash, then across its buckets.
    """
    if not 0 < most <= 2 or len(schedules) != len(weights):
        raise ValueError("most must be in (0, 2] and each weight needs a schedule")
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep else [id_col])]).alias("__row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("name"), word_count(F.col(text_col)).alias("size"), h.alias("h"))
    if not keep:
        base, _ = materialise(base, "sizes")
    n = docs.count() if keep else base.count()
    per_bucket = max(BUCKET_ROWS, math.isqrt(n))
    digits = max(1, math.ceil(math.log(n / per_bucket, 16))) if n > per_bucket else 1
    base = base.withColumn("bucket", F.substring("h", 1, digits))
    buckets, _ = materialise(base.groupBy("source", "name", "bucket").agg(F.sum("size").alias("words")), "buckets")
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total_share, most)
    known = starts.join(targets, starts.source.eqNullSafe(targets.source)).select("name", "bucket", "start", "source_size", "kind", "target")
    d = base.join(known, ["name", "bucket"])

    inside = W.partitionBy("name", "bucket").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, -1)  # dealt as the join is: names are never null
    d = d.withColumn("cum", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.when(F.col("source_size") == 0, 0).when(F.col("target") >= 2 * F.col("source_size"), 2).when(F.col("target") >= F.col("source_size"), 1).otherwise(0)
    d = d.withColumn("passes", whole.cast("long"))
    d = d.withColumn("rest", F.floor(F.col("target") + 0.5) - F.col("passes") * F.col("source_size"))
    if partial:
        extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("cum")))
    else:
        extra = F.when(2 * F.col("cum") + F.col("size") <= 2 * F.col("rest"), F.col("size")).otherwise(F.lit(0))
    d = d.withColumn("extra", F.when(F.col("rest") > 0, extra).otherwise(F.lit(0)).cast("long"))
    d = d.withColumn("taken", F.col("passes") * F.col("size") + F.col("extra"))
    d = d.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("passes") + (F.col("extra") > 0).cast("long")).cast("int"))

    def at(k: int) -> Column:
        length = F.when(F.lit(k) < F.col("passes"), F.col("size")).otherwise(F.col("extra"))
        middle = F.col("cum") + F.lit(k) * F.col("source_size") + length / 2.0
        share = F.least(middle / F.greatest(F.floor(F.col("target") + 0.5), F.lit(1)), F.lit(1.0))
        return F.when(F.col("copies") > k, F.round(position(share, F.col("kind"), schedules), 9))

    d = d.withColumn("first_position", at(0)).withColumn("second_position", at(1))
    new = ["size", "source_size", "target", "taken", "copies", "first_position", "second_position"]
    old = [F.col(f"__row.`{c}`").alias(c) for c in (docs.columns if keep else [id_col]) if c not in new and not (per_copy and c == "position")]
    if not per_copy:
        order = ["first_position", "taken", id_col]
        return d.select(*old, *new).repartitionByRange(*order).sortWithinPartitions(*order)
    places = F.filter(F.array("first_position", "second_position"), lambda p: p.isNotNull())
    copies = d.select(*old, *new, F.explode(places).alias("position"))
    return copies.repartitionByRange("position", "taken", id_col).sortWithinPartitions("position", "taken", id_col)
