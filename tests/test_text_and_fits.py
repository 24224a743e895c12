"""Joiners in Persian text, fitted temperatures and merged sketches against references."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarazu.functions import text as TX
from tarazu.operators import score as S


def normal(spark, *texts):
    d = spark.createDataFrame([(i, t.replace("|", TX.ZWNJ)) for i, t in enumerate(texts)], "i int, t string")
    return [r.t.replace(TX.ZWNJ, "|") for r in d.select("i", TX.normalize(F.col("t")).alias("t")).orderBy("i").collect()]


def test_joiners_where_they_belong(spark):
    cases = {
        "می رود": "می|رود", "نمی خواهم بروم": "نمی|خواهم بروم", "کتاب های من": "کتاب|های من", "کتابهایش": "کتاب|هایش", "رفته ام": "رفته|ام", "خانه ای": "خانه|ای",
        "بزرگ تر از": "بزرگ|تر از", "تنها ماند": "تنها ماند", "می را خورد": "می را خورد", "آن می": "آن می", "abc ها": "abc ها", "من ام": "من ام", "|می|رود|": "می|رود", "a|1 |ب": "a1 ب", "": "",
    }
    assert normal(spark, *cases) == list(cases.values())
    assert spark.range(1).select(TX.normalize(F.lit(None).cast("string")).alias("x")).first().x is None


def test_normalizing_twice_changes_nothing(spark):
    rnd = random.Random(7)
    parts = ["می", "نمی", " ", " ", " ", "ها", "های", "تر", "ه", "ام", "ای", "رود", "کتاب", TX.ZWNJ, TX.ZWNJ, "و", "است", "تنها", "\t", "x", "1", "آ", "ب", "ً", "."]
    d = spark.createDataFrame([("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 12))),) for _ in range(20_000)], "t string")
    d = d.select(TX.normalize(F.col("t")).alias("a")).withColumn("b", TX.normalize(F.col("a")))
    assert d.where("a <> b").count() == 0
    long = spark.range(1).select(F.length(TX.normalize(F.repeat(F.lit("ک"), 1_000_000))).alias("x"), F.length(TX.normalize(F.repeat(F.lit("می "), 300_000))).alias("y")).first()
    assert (long.x, long.y) == (1_000_000, 899_999)


def loss_at(questions, t):
    total = 0.0
    for s, g in questions:
        z = np.array(s) / t
        z -= z.max()
        total -= float((np.array(g) / sum(g)) @ (z - np.log(np.exp(z).sum())))
    return total / len(questions)


def test_temperatures_against_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {}
    for name, scale in (("wide", 9.0), ("even", 1.0), ("narrow", 0.2), (None, 2.0)):
        groups[name] = []
        for _ in range(120):
            s = rng.normal(size=rng.integers(2, 6)) * scale
            p = np.exp(s / 1.7) / np.exp(s / 1.7).sum()
            groups[name].append((s.tolist(), rng.multinomial(3, p).astype(float).tolist()))
    groups["sure"] = [([3.0, 0.0, 0.0], [1.0, 0.0, 0.0])]
    groups["wrong"] = [([3.0, 0.0], [0.0, 1.0]), ([2.0, 0.0], [0.0, 1.0])]
    groups["says nothing"] = [([1.0, 1.0], [1.0, 0.0])]
    rows = [(r, str(i), j, float(s[j]), g[j]) for r, qs in groups.items() for i, (s, g) in enumerate(qs) for j in range(len(s))]
    rows += [("even", "no gold", 0, 1.0, 0.0), ("even", "0", 9, None, 1.0), ("sure", "0", 9, 5.0, None)]
    long = spark.createDataFrame(rows, "run string, id string, idx int, score double, g double")
    got = {r.run: r for r in S.temperature_fit(long, ["run"]).collect()}
    grid = {r.run: r.loss for r in S.temperature_grid(long.where("g is not null and score is not null"), ["run"]).collect()}
    assert set(got) == set(groups)
    assert (got["sure"].t, got["wrong"].t, got["says nothing"].t) == (0.01, 100.0, 1.0)
    for name in ("wide", "even", "narrow", None):
        lo, hi = 0.01, 100.0  # golden section in log t, where the loss has a single minimum
        for _ in range(200):
            a, b = math.exp(math.log(lo) + 0.382 * math.log(hi / lo)), math.exp(math.log(lo) + 0.618 * math.log(hi / lo))
            lo, hi = (lo, b) if loss_at(groups[name], a) < loss_at(groups[name], b) else (a, hi)
        # a flat minimum holds t to the root of the precision only; the loss shows the rest
        assert got[name].t == pytest.approx(lo, rel=1e-5) and got[name].loss == pytest.approx(loss_at(groups[name], lo), abs=1e-6)
    assert all(got[n].loss <= grid[n] + 1e-6 for n in ("wide", "narrow"))
    assert S.temperature_fit(long.limit(0), ["run"]).count() == 0


def test_merged_sketches_keep_ranks(spark):
    n = 200_000
    d = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("v"), (F.col("id") % 9).alias("day"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"))
    odd = spark.createDataFrame([(None, 0, "a"), (float("nan"), 1, "a"), (None, 0, "none")], "v double, day long, g string")
    q = S.latency_quantiles(S.latency_sketch(d.unionByName(odd), ["g", "day"], "v"), ["g"], {"p5": 0.05, "p50": 0.5, "p99": 0.99})
    got = {r.g: r for r in q.collect()}
    assert got["none"].n == 0 and got["none"].p50 is None
    for g in "ab":
        v = np.sort([r.v for r in d.where(F.col("g") == g).select("v").collect()])
        assert got[g].n == len(v)
        for name, x in (("p5", 0.05), ("p50", 0.5), ("p99", 0.99)):
            assert abs(np.searchsorted(v, got[g][name]) / len(v) - x) < 0.015
