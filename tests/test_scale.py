"""What keeps tasks and shuffles small: held against plans, beside the results."""

import hashlib

from pyspark.sql import functions as F

from tarazu.operators import compare, mix, prep, qa
from tarazu.plans import data, evaluation  # noqa: F401
from tarazu.plans.registry import QUERIES


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString() + "\n" + df._jdf.queryExecution().executedPlan().toString()


def test_glossary_texts_move_once(spark):
    pairs = spark.createDataFrame([("a", "one two two", "EINS zwei"), ("a", "two", "drei"), ("b", "one two two", "eins"), ("b", None, "eins"), ("c", "one", None)], "source_id string, source_text string, target_text string")
    glossary = spark.createDataFrame([("one", "eins"), ("two", "Zwei")], "en_term string, fa_term string")
    out = qa.glossary_match(pairs, glossary)
    assert sorted(map(tuple, out.collect())) == [("a", "one", True), ("a", "two", False), ("b", "one", True), ("b", "two", False), ("c", "one", False)]
    assert not [x for x in plan(out).splitlines() if "keys=[row#" in x and " t#" in x]


def test_intents_without_a_sort(spark, sf):
    assert "SortAggregate" not in plan(QUERIES["mon_intents_behind"](spark, sf))


def test_options_are_sorted_once_dealt(spark, sf):
    out = QUERIES["opt_cap"](spark, sf)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.rfind("Exchange hashpartitioning") > text.rfind("Sort [") > 0
    long = spark.createDataFrame([(q, str(o), o, float(o == 7)) for q in range(5) for o in range(9)], "id int, option_id string, idx int, g double")
    kept = mix.opt_cap(long, 4).groupBy("id").agg(F.count("*").alias("n"), F.max("g").alias("g")).collect()
    assert len(kept) == 5 and all(r.n == 4 and r.g == 1 for r in kept)


def test_balanced_sample_sorts_few_rows(spark):
    d = spark.range(30000).select("id", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("s"))
    out = prep.sample_balanced(d, ["s"], 50, 7)
    assert "LeftSemi" in plan(out) and out.columns == d.columns
    rows = d.select("s", "id", prep.h32(F.lit(7), F.col("id")).alias("h")).collect()
    want = {(s, r.id) for s in (None, "1", "2") for r in sorted((r for r in rows if r.s == s), key=lambda r: (r.h, r.id))[:50]}
    assert {(r.s, r.id) for r in out.collect()} == want
    assert prep.sample_balanced(d.limit(5), ["s"], 50, 7).count() == 5


def test_answers_carry_the_way_back(spark, sf):
    answers = spark.createDataFrame([(0, 1, "rename", "opt_2", {"opt_1": "a", "opt_2": "b"}), (0, 1, "distractor", "distractor", {"a": "a", "distractor": None})], "run int, id int, kind string, pred string, back map<string,string>")
    assert sorted(map(tuple, compare.answers_back(answers).collect())) == [(0, 1, "distractor", None), (0, 1, "rename", "b")]
    assert QUERIES["robust_all"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 6


def test_minhash_in_arrow(spark):
    sets = [[5], [1 << 59, 7, 3], list(range(10**12, 10**12 + 9000))]
    got = {(r.set, r.band): r.key for r in prep.minhash_bands(spark.createDataFrame(list(enumerate(sets)), "set int, s array<long>")).collect()}
    p, key = 2147483647, lambda s, b: ",".join(str(min((x % p * ((k * 1103515245 + 12345) % (1 << 30) + 1) + k * 97531 + 7) % p for x in s)) for k in range(4 * b, 4 * b + 4))
    assert got == {(i, b): hashlib.md5(key(s, b).encode()).hexdigest() for i, s in enumerate(sets) for b in range(16)}
    assert "ArrowEvalPython" in plan(prep.minhash_bands(spark.createDataFrame([(1, [1])], "set int, s array<long>")))


def test_a_case_is_read_once_for_its_links(spark, sf, monkeypatch):
    seen, links = [], data.GR.near_copy_links
    monkeypatch.setattr(data.GR, "near_copy_links", lambda d: (seen.append(d.groupBy("source_id").count().agg(F.max("count")).first()[0]), links(d))[1])
    assert QUERIES["split_by_group"](spark, sf).count() > 0 and seen == [1]
