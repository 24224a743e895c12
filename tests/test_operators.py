"""Operators on small literals, with values worked out by hand, and invariants."""

import datetime

import pytest
from pyspark.sql import functions as F

from tarazu.functions import text as TX
from tarazu.operators import compare as C
from tarazu.operators import generate as G
from tarazu.operators import mix as M
from tarazu.operators import qa as Q
from tarazu.operators import records as R
from tarazu.operators import score as S
from tarazu.sources import io
from tarazu.streaming.resume import process_available


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_persian_text(spark):
    assert one(spark, TX.normalize(F.lit("كتاب‌‌ي  ١٢۳ ‌ x "))) == "کتاب‌ی 123 x"
    assert one(spark, TX.normalize(F.lit("12"), "persian")) == "۱۲"
    assert one(spark, TX.numbers(F.lit("۱۲,۳۴۵ و 7.50 و ١٢"))) == ["12", "12345", "7.50"]
    assert one(spark, TX.script_share(F.lit("سلام ab"), "Arabic")) == pytest.approx(4 / 6)
    assert one(spark, TX.swap_digits(TX.swap_digits(F.lit("a1۲b")))) == "a1۲b"


def test_calendar_anchors(spark):
    dim = {r.jdate: r for r in G.jalali_dim(spark).where("jy in (1399, 1403, 1405)").collect()}
    d = datetime.date
    assert dim["1399/01/01"].gdate == d(2020, 3, 20) and dim["1403/01/01"].gdate == d(2024, 3, 20) and dim["1405/01/01"].gdate == d(2026, 3, 21)
    assert dim["1405/07/15"].gdate == d(2026, 10, 7) and G.WEEKDAYS[dim["1405/07/15"].weekday - 1] == "چهارشنبه"
    assert "1399/12/30" in dim and "1405/12/30" not in dim and G.jalali_dim(spark).select("gdate").distinct().count() == G.jalali_dim(spark).count()


def test_iranian_formats(spark):
    for text, ok in (("09123456789", True), ("+989123456789", True), ("۰۹۱۲۳۴۵۶۷۸۹", True), ("9123456789", False), ("0912345678", False)):
        assert one(spark, G.mobile_valid(F.lit(text))) == ok
    assert one(spark, G.postal_valid(F.lit("۱۲۳۴۵۶۷۸۹۰"))) and not one(spark, G.postal_valid(F.lit("123456789")))


def recs(spark, n=200):
    opts = R.option_array(("a", "A"), ("b", "B"), ("c", "C"))
    r = spark.range(n).select(F.col("id").cast("string").alias("id"), opts.alias("options"))
    return r.withColumn("gold", F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(0.3), F.lit("c"), F.lit(0.2)))


def test_gold_follows_options(spark):
    for out in (M.opt_shuffle(recs(spark)), M.opt_rename(recs(spark)), M.opt_none_of_these(recs(spark)), C.pert_distractor(recs(spark))):
        rows = out.collect()
        assert len(rows) == 200
        for r in rows:
            assert sum(r.gold.values()) == pytest.approx(1) and {o.id for o in r.options} == set(r.gold)
            text = {o.text: r.gold[o.id] for o in r.options}
            assert all(text.get(t, p) == p for t, p in (("A", 0.5), ("B", 0.3), ("C", 0.2)))
    dropped = [r for r in M.opt_none_of_these(recs(spark)).collect() if "a" not in r.gold]
    assert dropped and all(r.gold["none"] == 0.5 for r in dropped)
    orders = {tuple(o.id for o in r.options) for r in M.opt_shuffle(recs(spark)).collect()}
    assert len(orders) == 6


def test_share_cap(spark):
    def caps(counts):
        return {r.source: r.cap for r in M.share_caps(spark.createDataFrame(list(counts.items()), "source string, n long"), 0.3).collect()}

    got = caps({"a": 1000, "b": 900, "c": 100, "d": 100, "e": 80})
    assert got == {"a": 210, "b": 210, "c": 100, "d": 100, "e": 80}
    assert caps({"a": 10, "b": 10, "c": 10, "d": 10}) == {"a": 10, "b": 10, "c": 10, "d": 10}
    with pytest.raises(Exception, match="too few"):
        caps({"a": 10, "b": 10, "c": 10})


def test_truncate_keeps_the_answer(spark):
    d = spark.createDataFrame([("x" * 50 + "ANSWER" + "y" * 50, "ANSWER"), ("short ANSWER", "ANSWER"), ("z" * 60, "none")], "p string, a string")
    a, b, c = (r.x for r in d.select(M.truncate_keep_answer(F.col("p"), F.col("a"), 20).alias("x")).collect())
    assert len(a) == 20 and "ANSWER" in a and b == "short ANSWER" and c == "z" * 20


def test_metrics_by_hand(spark):
    rows = [(0, "q1", 0, "a", 1.0, 0.8), (0, "q1", 1, "b", 0.0, 0.2), (0, "q2", 0, "a", 0.0, 0.5), (0, "q2", 1, "b", 1.0, 0.5)]
    long = spark.createDataFrame(rows, "run int, id string, idx int, option_id string, g double, p double")
    top = {r.id: r for r in S.top1(long).collect()}
    assert top["q1"].correct and not top["q2"].correct and top["q2"].pred == "a"
    t = S.top1(long)
    assert S.m_accuracy(t, ["run"]).first().accuracy == 0.5 and S.m_ece(t, ["run"]).first().ece == pytest.approx(0.35)
    assert S.m_brier(long, ["run"]).first().brier == pytest.approx((0.08 + 0.5) / 2)
    assert S.m_total_variation(long, ["run"]).first().tv == pytest.approx(0.35)
    assert S.m_macro_f1(t, ["run"]).first().macro_f1 == pytest.approx((2 / 3 + 0) / 2, abs=1e-6)
    curve = S.m_acc_coverage(t, ["run"])
    gate = S.m_gate(curve, ["run"], 0.9).first()
    assert gate.threshold == 55 and gate.coverage == 0.5
    assert S.m_reliability(t, ["run"]).count() == 10


def test_temperature_softens_an_overconfident_run(spark):
    rows = [(0, str(k), j, str(j), 1.0 if j == (k % 5 == 0) else 0.0, 4.0 if j == 0 else 0.0) for k in range(100) for j in (0, 1)]
    long = spark.createDataFrame(rows, "run int, id string, idx int, option_id string, g double, score double")
    t = S.temperature_fit(long, ["run"]).first()
    assert 2.5 < t.t < 3.2  # four of five right: log 4 = 4 / t


def test_bootstrap_of_a_constant(spark):
    items = spark.createDataFrame([(r, str(k), float(r)) for r in (0, 1) for k in range(50)], "run int, id string, v double")
    assert [(r.diff, r.low, r.high, r.verdict) for r in C.boot_paired(items, "v", 50).collect()] == [(1.0, 1.0, 1.0, "win")]


def test_early_stop(spark):
    curve = spark.createDataFrame([("r", k, v) for k, v in enumerate([5.0, 4.0, 3.0, 3.5, 3.2, float("nan"), 3.1, 1.0])] + [("s", 0, 2.0), ("s", 1, 1.0)], "run_id string, step int, value double")
    got = {r.run_id: (r.best_step, r.best, r.stop_step) for r in C.early_stop(curve).collect()}
    assert got == {"r": (2, 3.0, 6), "s": (1, 1.0, None)}


def test_looping_and_ratio(spark):
    p = spark.createDataFrame([("1", "f", "x" * 60, "go on and go on and go on and go on and", "translate"), ("2", "f", "a b c d", "a b c d", "translate"), ("3", "f", "abc", "", "translate"), ("4", "f", None, None, "translate")], "source_id string, field string, source_text string, target_text string, rule string")
    assert {r.source_id: r.ok for r in Q.looping(p).collect()} == {"1": False, "2": True, "3": True, "4": True}
    assert {r.source_id: r.ok for r in Q.length_ratio(p).collect()} == {"1": True, "2": True, "3": False, "4": False}


def test_business_hours_past_midnight(spark):
    hours = spark.createDataFrame([(6, 1200, 120)], "day int, from_min int, to_min int")
    ts = [("1", "2024-01-04 21:30:00"), ("2", "2024-01-05 01:59:00"), ("3", "2024-01-05 02:00:00"), ("4", "2024-01-04 19:59:00")]
    t = spark.createDataFrame(ts, "id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {r.id: r.open for r in G.business_hours(t, "ts", hours).collect()} == {"1": "yes", "2": "yes", "3": "no", "4": "no"}


def test_resume_processes_each_file_once(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    run = lambda: process_available(spark, src, out, ckpt, "id long", lambda b: b)
    spark.range(5).coalesce(1).write.parquet(src)
    run()
    spark.range(5, 8).coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))


def test_predictions_are_appended_and_pruned(spark, tmp_path):
    path = str(tmp_path / "p")
    for run in ("a", "b"):
        io.write_predictions(spark.range(3).select(F.lit(run).alias("run_id"), "id"), path)
    only = spark.read.parquet(path).where("run_id = 'a'")
    assert only.count() == 3 and "PartitionFilters: [isnotnull(run_id" in only._jdf.queryExecution().toString()


def test_validation_names_broken_rules(spark):
    r = recs(spark, 2).withColumn("source_id", F.lit("s")).withColumn("origin", F.lit("native")).withColumn("question_type", F.lit("choice")).withColumn("split", F.lit("train"))
    assert R.rec_validate(r).count() == 0
    bad = r.withColumn("gold", F.create_map(F.lit("a"), F.lit(0.5))).withColumn("split", F.lit("dev"))
    assert {x.violations for x in R.rec_validate(bad).collect()} == {"gold_sum,gold_keys,split"}


def test_short_texts_leak_as_a_whole(spark):
    from tarazu.operators import prep

    train = spark.createDataFrame([(1, "yes"), (2, "to be sure"), (3, "to be sure now and then"), (4, ""), (5, None)], "id long, state string")
    test = spark.createDataFrame([(7, "yes"), (8, "to  be sure"), (9, "no"), (10, ""), (11, None)], "id long, state string")
    assert sorted(tuple(r) for r in prep.leak_near_dup(train, test).collect()) == [(7, 1, 1, 1.0, 1.0), (8, 2, 1, 1.0, 1.0)]


def slow_shingles(text, n=5):
    import re

    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({("",) + tuple(w)} if w else set())


def near_copies(spark, n=100):
    """Texts and copies of them with more and more words replaced, some of them with a common passage."""
    import random

    rng, train, test = random.Random(3), [], []
    common = " ".join(f"common{k}" for k in range(30))
    for k in range(n):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 120))]
        train.append((k, " ".join(w) + (" " + common if k % 3 == 0 else "")))
        for j in range(rng.randrange(0, 12) if k % 2 else rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"new{j}"
        test.append((k, " ".join(w) + (" " + common if k % 3 == 0 else "")))
    return (spark.createDataFrame([*x, (900, None), (901, ""), (902, common)], "id long, state string") for x in (train, test))


def test_near_copies_leak_as_all_pairs_say(spark):
    from tarazu.operators import prep

    train, test = near_copies(spark)
    want = {}
    for b in test.collect():
        for a in train.collect():
            x, y = slow_shingles(a.state), slow_shingles(b.state)
            both = len(x & y)
            if both and (both / len(x | y) >= 0.8 or both / len(y) >= 0.5):
                want[b.id, a.id] = (both, both / len(x | y), both / len(y))
    got = {(r.test_id, r.train_id): (r.shared, r.jaccard, r.containment) for r in prep.leak_near_dup(train, test).collect()}
    assert len(want) > 60 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    exact = {k for k, v in want.items() if v[1] >= 0.8}
    found = {(r.test_id, r.train_id) for r in prep.leak_minhash(train, test).collect()}
    assert found <= exact and len(found) >= 0.97 * len(exact) > 20  # 16 bands of 4 rows: 0.9998 at a similarity of 0.8


def test_null_sources_stay(spark):
    d = spark.range(100).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    assert M.mix_cap_share(d).count() == 100 and M.mix_cap_share(d).columns == d.columns
    up = M.mix_upsample(d, 60)
    assert up.count() == 5 * 60 and up.where("source is null").count() == 60


def test_dates_outside_the_calendar_stay(spark):
    import datetime

    day = lambda y: datetime.date(y, 5, 5)
    d = spark.createDataFrame([(1, day(1800), day(2024)), (2, day(2023), day(2024))], "id int, a date, b date")
    got = {r.id: (r.question, r.label) for r in G.compare_dates(d, "a", "b", G.jalali_dim(spark)).collect()}
    assert got[1] == (None, "yes") and got[2][0].startswith("آیا 1402/02/15") and got[2][1] == "yes"
    assert {r.id: r.jdate for r in G.weekday_items(d.drop("b"), "a", G.jalali_dim(spark)).collect()} == {1: None, 2: "1402/02/15"}


def test_every_question_gets_another_passage(spark):
    q = spark.range(500).select("id", F.concat(F.lit("q"), "id").alias("question"), F.concat(F.lit("p"), "id").alias("passage"), F.lit("none").alias("answer"))
    rows = M.neg_wrong_passage(q, group_rows=50).collect()
    assert len({r.id for r in rows}) == len(rows) > 480 and all(r.passage == f"p{r.from_id}" and r.from_id != r.id for r in rows)


def slow_weights(unit, replicates):
    import hashlib

    for r in range(replicates):
        u = int(hashlib.md5(f"{r // C.LANES}:{unit}".encode()).hexdigest()[8 * (r % C.LANES) : 8 * (r % C.LANES) + 8], 16) / 2**32
        yield sum(u >= cut for cut in C.POISSON)


def test_intervals_by_case_against_brute_force(spark):
    """Mean, calibration error and language gap, each case (three decisions) with one weight."""
    import random

    import numpy as np

    rng = random.Random(5)
    rows = [(run, f"{case}-{k}", case, rng.choice(["en", "fr"]), rng.random() < 0.6 + run / 10, round(rng.uniform(0.5, 1), 3)) for run in (0, 1) for case in range(40) for k in range(3)]
    top = spark.createDataFrame(rows, "run int, id string, case_id int, lang string, correct boolean, conf double").withColumn("hit", F.col("correct").cast("int"))
    w = {case: np.array(list(slow_weights(case, 101)), float) for case in range(40)}
    assert 0.9 < np.mean(list(w.values())) < 1.1

    def check(got, name, stat):
        for run in (0, 1):
            mine = [r for r in rows if r[0] == run]
            many, one = stat(mine, lambda r: w[r[2]]), stat(mine, lambda r: np.ones(1))[0]
            r = next(x for x in got if x["run"] == run)
            assert (r[name], r["low"], r["high"]) == pytest.approx((one, np.quantile(many, 0.025), np.quantile(many, 0.975)), abs=2e-6)

    mean = lambda some, of: sum(of(r) * r[4] for r in some) / sum(of(r) for r in some)
    check(C.boot_ci(top, ["run"], "hit", 101, "case_id").collect(), "mean", mean)
    ece = lambda some, of: sum(abs(sum((of(r) * (r[4] - r[5]) for r in some if min(int(r[5] * 10), 9) == b), np.zeros(1))) for b in range(10)) / sum(of(r) for r in some)
    check(C.boot_ece(top, ["run"], 101, "case_id").collect(), "ece", ece)
    gap = lambda some, of: mean([r for r in some if r[3] == "en"], of) - mean([r for r in some if r[3] == "fr"], of)
    check(C.boot_gap(top, ["run"], F.col("lang") == "en", F.col("lang") == "fr", 101, "case_id").collect(), "gap", gap)


@pytest.mark.parametrize("kind", ["order", "rename", "distractor", "digits"])
def test_perturbations_keep_the_answer_of_a_steady_reader(spark, kind):
    """Records perturbed, scored by their option texts and mapped back to the options they were: no answer flips; a reader of option places does flip."""
    r = recs(spark, 120).withColumn("state", F.concat(F.lit("year 19"), "id"))
    p = {"order": lambda: M.opt_shuffle(r), "rename": lambda: M.opt_rename(r), "distractor": lambda: C.pert_distractor(r), "digits": lambda: C.pert_digits(r, "state")}[kind]()
    was = r.select(F.lit(0).alias("run"), "id", F.explode("options").alias("o")).select("run", "id", F.col("o.id").alias("was"), F.col("o.text").alias("option_text"))

    def answers(df, score):
        long = R.explode_options(df).withColumn("run", F.lit(0)).withColumn("p", score).join(was, ["run", "id", "option_text"], "left")
        best = S.top1(long.withColumn("option_id", F.coalesce("was", "option_id")))
        return best.select("run", "id", "pred", F.lit(kind).alias("kind"))

    steady, by_place = F.ascii("option_text") * -1.0, F.col("idx") * -1.0
    assert C.robust_flip(answers(r, steady), answers(p, steady), ["kind"]).first().flips == 0
    flips = C.robust_flip(answers(r, by_place), answers(p, by_place), ["kind"]).first().flips
    assert (flips > 0.4) == (kind == "order")


def test_token_lengths_by_a_function(spark):
    import pandas as pd

    @F.pandas_udf("int")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.fillna("").str.len()

    d = spark.createDataFrame([("a", "abc"), ("a", "abcde"), ("b", None)], "source string, text string")
    assert {(r.source, r.n, r.p50, r.longest) for r in M.len_profile(d, "text", ["source"], pieces).collect()} == {("a", 2, 4.0, 5), ("b", 1, 0.0, 0)}


# identity, groups, leaks across languages, glossary, versions, cases once


def test_dedup_and_leaks_by_content(spark):
    """Null and repeated ids lose no row, report no other one, and repeated rows count once."""
    from tarazu.functions.text import text_key
    from tarazu.operators import prep, records

    long = " ".join(f"w{k}" for k in range(40))
    d = spark.createDataFrame([(None, "only"), (None, "Twice"), (2, "twice!"), (1, "twice"), (3, "x"), (3, "y"), (4, "z"), (4, "z"), (None, None), (9, "")], "id long, state string")
    got = records.dedup_exact(d, text_key(F.col("state"))).collect()
    assert sorted((r.id or 0, r.state or "") for r in got) == [(0, "only"), (1, "twice"), (3, "x"), (3, "y"), (4, "z"), (9, "")]
    train = spark.createDataFrame([(None, "a", "same"), (7, "b", "same"), (7, "c", "clean"), (8, "t", "other"), (8, None, "else")], "id long, source_id string, state string")
    test = spark.createDataFrame([(1, "t", "Same!"), (2, None, "no")], "id long, source_id string, state string")
    assert sorted((r.source_id, r.state) for r in prep.leak_exact(train, test).collect()) == [("a", "same"), ("b", "same"), ("t", "other")]
    train = spark.createDataFrame([(1, long), (1, long), (1, long), (None, long), (2, long + " and more")], "id long, state string")
    test = spark.createDataFrame([(5, long), (5, long), (None, long)], "id long, state string")
    near = sorted((r.test_id or 0, r.train_id or 0, r.shared, round(r.jaccard, 3), r.containment) for r in prep.leak_near_dup(train, test).collect())
    assert near == sorted((t, i, 36, j, 1.0) for t in (0, 5) for i, j in ((0, 1.0), (1, 1.0), (2, round(36 / 38, 3))))
    assert sorted((r.test_id or 0, r.train_id or 0) for r in prep.leak_minhash(train, test).collect()) == [(t, i) for t in (0, 5) for i in (0, 1, 2)]


def test_no_link_crosses_the_split(spark):
    """Near copies over several steps are on one side; exact links against all pairs, components against union-find, also of a long chain."""
    import random

    from tarazu.operators import groups

    rng, rows = random.Random(8), []
    for g in range(12):
        w = [f"g{g}w{rng.randrange(300)}" for _ in range(rng.randrange(30, 120))]
        for _ in range(8):
            rows.append((f"c{len(rows)}", " ".join(w)))
            w[rng.randrange(len(w))] = f"new{len(rows)}"
    rows += [("c1", "the second field of a case"), ("c90x", "The second field, of a case"), ("empty", ""), ("none", None), (None, rows[0][1]), ("few", "two words"), ("few2", "Two words")]
    d = spark.createDataFrame(rows, "source_id string, state string")
    sets = [(i, slow_shingles(t)) for i, t in rows if i and slow_shingles(t)]
    want = {tuple(sorted((a, b))) for a, x in sets for b, y in sets if a != b and len(x & y) >= 0.8 * len(x | y)}
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in want:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    out = groups.split_by_group(d, groups.near_copy_links(d)).collect()
    assert len(out) == len(rows) and len(want) > 60
    assert all(r.group == (r.source_id and root(r.source_id)) for r in out)
    side = {r.source_id: r.split for r in out}
    assert all(side[a] == side[b] for a, b in want)
    chain = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("a"), ((F.col("id") + 1) * 7919 % 10_007).alias("b"))
    found = groups.connected(chain)
    assert found.count() == 10_001 and {r.root for r in found.select("root").distinct().collect()} == {0}
    assert groups.connected(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_leaks_across_languages(spark):
    from tarazu.operators import prep

    test = spark.createDataFrame([(1, "Pay 1,200 to a@b.com by 2024-05-01, order ZX-991"), (2, "In 2024 we met 3 times"), (3, None), (None, "call 555 and 777 at x@y.org")], "id long, state string")
    train = spark.createDataFrame([(10, "سفارش ZX-991: تا ۲۰۲۴-۰۵-۰۱ مبلغ ۱,۲۰۰ به a@b.com"), (11, "2024: 3 and 4"), (12, "only 2024"), (13, "777 x@y.org 555"), (13, "777 x@y.org 555"), (None, "555 777 x@y.org")] + [(100 + k, f"in 2024, {k + 50} and 3") for k in range(30)], "id long, state string")
    got = {(r.test_id, r.train_id): (r.shared, round(r.overlap, 6)) for r in prep.leak_translated(train, test).collect()}
    tokens = {k: v for k, v in got.items() if k[1] in (10, 13, None)}
    assert set(tokens) == {(1, 10), (None, 13), (None, None)} and all(v[1] == 1.0 for v in tokens.values())
    assert (2, 11) not in got and all(i != 12 for _, i in got)


def test_glossary_phrases(spark):
    """Leftmost and longest terms, against a walk over the words."""
    import random

    from tarazu.operators import prep, qa

    terms = ["a", "a b", "b a b", "c", "c  A", "b b b b", "Ünï d"]
    glossary = spark.createDataFrame([(t, t.upper()) for t in terms], "en_term string, fa_term string")
    known = {tuple(t.lower().split()): t for t in terms}
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["a", "b", "c", "A,", "ünï", "d", "x"]) for _ in range(rng.randrange(0, 25)))) for k in range(150)] + [(900, None), (901, ""), (3, "a b a"), (None, "a b")]
    want = []
    for i, t in rows:
        w, k = [x.strip(",").lower() for x in (t or "").split()], 0
        while k < len(w):
            n = next((n for n in range(min(5, len(w) - k), 0, -1) if tuple(w[k : k + n]) in known), 0)
            if n:
                want.append((i, known[tuple(w[k : k + n])]))
            k += n or 1
    d = spark.createDataFrame(rows, "id long, state string")
    got = [(r.id, r.en_term) for r in prep.glossary_terms(d, glossary).collect() for _ in range(r.n)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 400
    pairs = spark.createDataFrame([("p", "x a b x", "say A B"), ("p", "b a b", "no"), ("q", "c a", "C  A")], "source_id string, source_text string, target_text string")
    assert sorted((r.source_id, r.en_term, r.ok) for r in qa.glossary_match(pairs, glossary).collect()) == [("p", "a b", True), ("p", "b a b", False), ("q", "c  A", True)]
    assert prep.glossary_terms(d, glossary.limit(0)).count() == 0


def test_versions_tell_tables_apart(spark):
    from tarazu.operators import records

    frame = lambda rows: spark.createDataFrame(rows, "id long, t string, u string")
    version = lambda rows: tuple(records.dataset_version_hash(frame(rows), ["id", "t", "u"]).first())
    a, b = (1, "a", "b"), (2, "c", None)
    assert version([a, a]) != version([b, b]) and version([a, b]) == version([b, a]) and version([a]) != version([a, a, a])
    assert version([(1, "a|b", "")]) != version([(1, "a", "b|")]) and version([(1, None, "")]) != version([(1, "", None)])
    old = [(k, f"t{k}", "u") for k in range(500)] + [(7, "t7", "u"), (None, "n", "u")]
    new = [(k, f"t{k}", "u") for k in range(1, 503)] + [(None, "m", "u")]
    diff = {(r.id, r.change) for r in records.version_diff(frame(old), frame(new), ["id", "t", "u"], buckets=64).collect()}
    assert diff == {(0, "removed"), (7, "changed"), (500, "added"), (501, "added"), (502, "added"), (None, "changed")}
    whole = version(old)[1]
    assert sum(r.version for r in records.version_buckets(frame(old), ["id", "t", "u"]).collect()) % records.PRIME == whole


def test_each_case_is_resumed_once(spark, tmp_path):
    """A case in two files, a batch killed half-way, a restart: each case once."""
    from tarazu.streaming.resume import process_available

    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    schema = "case string, n long"
    write = lambda *ids: spark.createDataFrame([(c, 1) for c in ids], schema).coalesce(1).write.mode("append").parquet(src)
    write("a", "b", "b")
    write("b", "c")

    def dies(batch):
        batch.limit(1).write.mode("overwrite").parquet(str(tmp_path / "half"))
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        process_available(spark, src, out, ckpt, spark.read.parquet(src).schema, dies, case=["case"])
    for more in ((), ("a", "d"), ("d", "c")):
        if more:
            write(*more)
        process_available(spark, src, out, ckpt, spark.read.parquet(src).schema, lambda b: b, max_files=1, case=["case"])
    assert sorted(r.case for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d"]


def test_transcripts_take_linear_time(spark):
    import time

    from tarazu.operators.mix import scrub

    t = time.time()
    text = spark.createDataFrame([("a" * 400_000,), ("a@b-" * 50_000,), ("mail a.b@c.de now +1 555 123 4567",)], "t string")
    got = [r.t for r in text.select(scrub(F.col("t")).alias("t")).collect()]
    assert got[2] == "mail <email> now <phone>" and time.time() - t < 20
