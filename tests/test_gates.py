"""Simultaneous intervals: against brute force with the same weights, and how often they err."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_operators import slow_weights

from tarazu.operators import compare as C

SCHEMA = "run int, id string, case_id int, lang string, correct boolean, conf double"


def rows_of(rng, runs=4, cases=40):
    return [(run, f"{case}-{k}", case, rng.choice(["en", "fa"]), rng.random() < 0.5 + run / 10, round(rng.uniform(0.5, 1), 3)) for run in range(runs) for case in range(cases) for k in range(3)]


def values(top):
    v = C.gate_values(top, "run", "case_id", F.col("lang") == "en", F.col("lang") == "fa")
    return v, [c for c in v.columns if c not in ("run", "unit")]


def test_leads_against_brute_force(spark):
    rows = rows_of(random.Random(8))
    w = {case: np.array([1.0, *slow_weights(case, 99)]) for case in range(40)}

    def share(run, lang):
        some = [r for r in rows if r[0] == run and r[3] == lang]
        return sum(w[r[2]] * r[4] for r in some) / sum(w[r[2]] for r in some)

    def ece(run):
        some = [r for r in rows if r[0] == run and r[3] == "fa"]
        gaps = [sum((w[r[2]] * (r[4] - r[5]) for r in some if min(int(r[5] * 10), 9) == k), np.zeros(100)) for k in range(10)]
        return -sum(map(abs, gaps)) / sum(w[r[2]] for r in some)

    stat = {"accuracy": lambda run: share(run, "fa"), "ece": ece, "language_gap": lambda run: share(run, "fa") - share(run, "en")}
    v, names = values(spark.createDataFrame(rows, SCHEMA))
    got = {(r.run, r.baseline, r.metric): r for r in C.boot_leads(v, names, C.CRITERIA, [0, 1], replicates=99, unit="unit").collect()}
    assert len(got) == 2 * 2 * 3
    for run in (2, 3):
        lead = {(b, m): f(run) - f(b) for b in (0, 1) for m, f in stat.items()}
        far = np.max([abs(x[1:] - x[1:].mean()) / x[1:].std() for x in lead.values()], axis=0)
        q = np.quantile(far, 0.95)
        assert q > 1.96
        for (b, m), x in lead.items():
            r = got[run, b, m]
            assert (r.lead, r.low, r.high) == pytest.approx((x[0], x[0] - q * x[1:].std(), x[0] + q * x[1:].std()), abs=2e-6)
            assert r.verdict == ("better" if r.low > 0 else "worse" if r.high < 0 else "tie")


def test_family_error_where_no_run_is_better(spark):
    """200 trials of a run and five baselines that are all alike: any verdict but a tie is an error."""
    rng, trials, cases = np.random.default_rng(3), 200, 100
    hits = rng.random((trials, 6, cases)) < 0.6
    rows = [(t, run, case, float(hits[t, run, case])) for t in range(trials) for run in range(6) for case in range(cases)]
    items = spark.createDataFrame(rows, "trial int, run int, case_id int, hit double").repartition(8)
    mean = {"accuracy": "try_divide(hit, w)"}

    def errors(leads):
        return leads.groupBy("trial").agg(F.max((F.col("verdict") != "tie").cast("int")).alias("e")).agg(F.avg("e")).first()[0]

    together = errors(C.boot_leads(items, ["hit"], mean, [0, 1, 2, 3, 4], by=("trial",), replicates=200, unit="case_id"))
    # each baseline in a family of its own: what single intervals do
    alone = items.where("run = 5").crossJoin(spark.range(5).withColumnRenamed("id", "b")).unionByName(items.where("run < 5").withColumn("b", F.col("run").cast("long")))
    single = errors(C.boot_leads(alone, ["hit"], mean, [0, 1, 2, 3, 4], by=("trial", "b"), replicates=200, unit="case_id"))
    assert together <= 0.05 + 3 * (0.05 * 0.95 / trials) ** 0.5 and single > 0.1 and single > together


def test_a_clear_lead_and_a_constant_one(spark):
    rows = [(run, str(case), case, "fa", case % 10 < (9 if run == 2 else 4 + run), 0.75) for run in range(3) for case in range(200)]
    v, names = values(spark.createDataFrame(rows, SCHEMA))
    leads = C.boot_leads(v, names, {"accuracy": C.CRITERIA["accuracy"], "gap": C.CRITERIA["language_gap"], "one": "1.0"}, [0, 1], replicates=100, unit="unit")
    got = {(r.baseline, r.metric): r for r in leads.collect()}
    assert all(got[b, "accuracy"].verdict == "better" and got[b, "accuracy"].lead == pytest.approx(0.5 - b / 10) for b in (0, 1))
    # no English answers: the gap is undefined; a constant is a tie with itself
    assert all(got[b, "gap"].verdict is None and got[b, "gap"].lead is None and got[b, "gap"].low is None for b in (0, 1))
    assert all((got[b, "one"].low, got[b, "one"].high, got[b, "one"].verdict) == (0, 0, "tie") for b in (0, 1))
    gate = {r.metric: (r.baselines, r.beaten, r.passed) for r in C.gate_leads(leads).collect()}
    assert gate == {"accuracy": (2, 2, True), "gap": (2, 0, False), "one": (2, 0, False)}
    assert {r.metric: r.nearest for r in C.gate_leads(leads).collect()}["gap"] is None


def test_leads_of_nothing(spark):
    v, names = values(spark.createDataFrame(rows_of(random.Random(1), 2, 5), SCHEMA))
    run = lambda x, baselines: C.boot_leads(x, names, C.CRITERIA, baselines, replicates=8, unit="unit").count()
    assert run(v.limit(0), [0]) == 0 and run(v, [9]) == 0 and run(v, [0, 1]) == 0 and run(v, [0]) == 3
    nulls = spark.createDataFrame([(None, "x", 1, "fa", True, 0.5), (0, None, None, None, None, None), (1, "y", 2, "fa", None, 0.7)], SCHEMA)
    v, names = values(nulls)
    assert {r.verdict for r in C.boot_leads(v, names, C.CRITERIA, [0], replicates=8, unit="unit").collect()} == {None}
