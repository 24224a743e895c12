"""Six perturbations in one table, answers mapped back, and the exact test, by hand and brute force."""

from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from tarazu.operators import compare as C


def test_mcnemar_against_exact_binomials():
    for a in range(0, 30):
        for b in range(0, 30):
            n, k = a + b, min(a, b)
            exact = min(Fraction(1), Fraction(2 * sum(comb(n, i) for i in range(k + 1)), 2**n))
            assert C.mcnemar_p(a, b) == pytest.approx(float(exact), rel=1e-9)
    n, k = 3000, 1400
    assert C.mcnemar_p(k, n - k) == pytest.approx(float(Fraction(2 * sum(comb(n, i) for i in range(k + 1)), 2**n)), rel=1e-8)
    assert C.mcnemar_p(10**9, 10**9) == 1.0 and C.mcnemar_p(10**9, 10**9 + 10**6) < 1e-6


ROWS = [("a", "in 19 days", "q1", "t", "fa", [("y", "Yes"), ("n", "No")]), ("b", "no digit", "q", "t", "en", [("y", "Ja"), ("n", "Nein")]), ("c", None, "q", None, None, [("only", "One")]), ("d", "x", "q", "u", "fa", [])]
SCHEMA = "id string, state string, question_text string, question_type string, question_lang string, options array<struct<id:string,text:string>>"


def test_kinds_and_ways_back(spark):
    r = spark.createDataFrame(ROWS, SCHEMA).withColumn("gold", F.map_from_arrays(F.transform("options", lambda o: o["id"]), F.transform("options", lambda o: F.lit(0.0))))
    said = spark.createDataFrame([("a", "in 19 days, eh"), ("a", "in 19 days, you know"), ("b", "no digit"), ("c", "said")], "id string, state string")
    asked = spark.createDataFrame([("t", "Which?"), ("t", "Zhich?")], "question_type string, question_text string")
    got = {(x.id, x.kind): x for x in C.perturbed(r, said, asked).collect()}
    kinds = lambda i: {k for j, k in got if j == i} - {"distractor"}
    assert kinds("a") == {"shuffle", "rename", "digits", "register", "english"} and kinds("b") == {"shuffle", "rename"} and kinds("c") == {"rename"} and kinds("d") == set()
    assert got["a", "digits"].state == "in ۱۹ days" and got["a", "digits"].question_text == "q۱"
    assert got["a", "register"].state == "in 19 days, eh" and got["a", "english"].question_text == "Which?"
    for (i, kind), x in got.items():
        was = {o[0]: o[1] for row in ROWS if row[0] == i for o in row[5]}
        for o in x.options:
            assert was[x.back[o.id]] == o.text if o.id != "distractor" else (x.back[o.id] is None and o.text not in was.values())
        assert len(x.options) == len(was) + (kind == "distractor")
    assert any(k == "distractor" for _, k in got)
    assert C.perturbed(r).where("kind in ('register', 'english')").count() == 0 and C.perturbed(r.limit(0), said, asked).count() == 0


def test_flips_by_hand(spark):
    changed = spark.createDataFrame([("a", "rename", {"opt_1": "y", "opt_2": "n"}), ("b", "rename", {"opt_1": "y", "opt_2": "n"}), ("c", "rename", {"opt_1": "y"})], "id string, kind string, back map<string,string>")
    answers = spark.createDataFrame([(0, "a", "rename", "opt_2"), (0, "b", "rename", "opt_2"), (0, "c", "rename", "huh")], "run int, id string, kind string, pred string")
    base = spark.createDataFrame([(0, "a", "y", "y"), (0, "b", "y", "n"), (0, "c", None, "y")], "run int, id string, pred string, gold string")
    x = C.flip_tests(base, C.answers_back(answers, changed), ["run", "kind"]).first()
    assert (x.n, x.flips, x.lost, x.won, x.p) == (3, 0.666667, 1, 1, 1.0)
