"""Groups of cases that must stay on one side of a split: near copies, and whatever they reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarazu.functions.seeded import h32
from tarazu.operators.prep import set_name, shingle_array
from tarazu.sources.shared import written


def connected(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): for each node of an edge the least node that it reaches.

    Large stars and small stars in turn (Kiveris et al., 2014): a node's larger neighbours hang on its least one, then its
    smaller ones do. Paths shrink by a factor a round, so rounds grow with the logarithm of the longest. Each round is
    written, and the loop ends when a round changes nothing. Loops, repeated edges and null ends are ignored; no edges give no rows.
    """
    two = lambda x, y: (F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"))
    now = written(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(*two(a, b)).distinct(), "edges")
    sums = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
    seen = sums(now)
    for _ in range(max_rounds):
        ends = now.union(now.select("lo", "hi")).toDF("node", "other")
        least = ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        stars = ends.where("other > node").join(least, "node").select(F.col("other").alias("hi"), F.col("m").alias("lo")).distinct()
        low = stars.groupBy("hi").agg(F.min("lo").alias("m"))
        small = stars.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", F.col("m").alias("lo")))
        now = written(small.distinct(), "edges")
        if (found := sums(now)) == seen:
            return now.toDF("node", "root").union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        seen = found
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_copy_links(df: DataFrame, text: str = "state", key: str = "source_id", n: int = 5, jaccard: float = 0.8) -> DataFrame:
    """(a, b): cases that hold texts whose sets of word n-grams have at least that Jaccard similarity, each set's cases as a star and one edge for each pair of sets.

    Exact. Two such sets share one of each other's rarest shingles, as many as are left without the part that they must
    share and one more (of equally rare ones the least); pairs are found by these alone, of sizes that can reach the similarity, and
    counted on the sets. Texts with equal sets are one, so copies cost nothing; a group of g distinct near copies costs up to g^2 / 2
    pairs of set names before they are counted. Texts without a word and null cases link with nothing.
    """
    made = df.where(F.col(key).isNotNull()).select(F.col(key).alias("case"), shingle_array(F.col(text), n).alias("s")).where(F.size("s") > 0)
    made = written(made.select("case", set_name(F.col("s")).alias("set"), "s"), "shingles")
    sets = written(made.groupBy("set").agg(F.min("case").alias("case"), F.first("s").alias("s")), "sets")
    each = sets.select("set", F.size("s").alias("size"), F.explode("s").alias("sh"))
    times = each.groupBy("sh").agg(F.count("*").alias("times")).where("times > 1")
    rank = F.row_number().over(W.partitionBy("set").orderBy(F.coalesce("times", F.lit(1)), "sh"))
    rare = each.join(times, "sh", "left").withColumn("k", rank).where(F.col("k") <= F.col("size") - F.ceil(jaccard * F.col("size") - 1e-9) + 1).where("times is not null")
    x, y = (rare.select("sh", F.col("set").alias(f"set_{p}"), F.col("size").alias(f"size_{p}")) for p in "ab")
    fits = F.least("size_a", "size_b") >= jaccard * F.greatest("size_a", "size_b") - 1e-9
    pairs = x.join(y, "sh").where((F.col("set_a") < F.col("set_b")) & fits).select("set_a", "set_b").distinct()
    pairs = written(pairs, "pairs")
    of = lambda p: sets.select(F.col("set").alias(f"set_{p}"), F.col("s").alias(f"s_{p}"), F.col("case").alias(p))
    both = F.size(F.array_intersect("s_a", "s_b"))
    near = pairs.join(of("a"), "set_a").join(of("b"), "set_b").where(both >= jaccard * (F.size("s_a") + F.size("s_b") - both) - 1e-9)
    stars = made.join(sets.select("set", F.col("case").alias("first")), "set").where("case <> first").select(F.col("first").alias("a"), F.col("case").alias("b"))
    return near.select("a", "b").where("a <> b").union(stars).distinct()


def split_by_group(df: DataFrame, links: DataFrame, seed: int = 0, key: str = "source_id") -> DataFrame:
    """df with `group`, the least case that a case is linked to directly or over others (itself without a link), and `split`, 80/8/4/8 by a hash of the group.

    So no link crosses the split. A null case is a group of its own kind, split like an empty name.
    """
    roots = connected(links).select(F.col("node").alias(key), F.col("root").alias("group"))
    out = df.drop("group", "split").join(roots, key, "left").withColumn("group", F.coalesce("group", key))
    b = h32(F.lit(seed), F.col("group")) % 100
    return out.withColumn("split", F.when(b < 80, "train").when(b < 88, "validation").when(b < 92, "calibration").otherwise("test"))
