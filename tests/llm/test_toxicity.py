"""op12: segments against brute force, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarazu.llm import queries, toxicity

INSULTS = ["zonk", "blarg", "fleep", "grunx"]


def corpus(n, seed=0):
    """(id, text, label): toxic texts hold insults densely in a passage; some clean ones hold a single one."""
    rng = np.random.default_rng(seed)
    syllables = ["an", "er", "ti", "on", "the", "ou", "ing", "ed", "re", "st"]
    out = []
    for k in range(n):
        words = ["".join(rng.choice(syllables, int(rng.integers(1, 4)))) for _ in range(int(rng.integers(40, 200)))]
        label = int(rng.random() < 0.15)
        if label:
            at = int(rng.integers(0, len(words) - 20))
            for _ in range(6):
                words[at + int(rng.integers(0, 20))] = str(rng.choice(INSULTS)).upper()
        elif rng.random() < 0.1:
            words[int(rng.integers(0, len(words)))] = str(rng.choice(INSULTS))
        out.append((k, " ".join(words), label))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic long")


def slow_segments(scores):
    """All maximal scoring segments by their definition: the best segment, then those of what lies left and right of it."""
    if not scores:
        return []
    sums = np.cumsum([0, *scores])
    best = max((round(sums[b] - sums[a], 9), a - b, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))
    if best[0] <= 0:
        return []
    _, _, a, b = best
    return [*slow_segments(scores[:a]), (a, b - 1, best[0]), *[(x + b, y + b, s) for x, y, s in slow_segments(scores[b:])]]


def test_segments_against_definition():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 30))
        odds = {k: float(rng.random() * 5) + 0.6 for k in range(n) if rng.random() < 0.3}
        price = float(rng.choice([0.11, 0.37, 1.13]))
        got = sorted(toxicity.segments(sorted(odds.items()), price))
        want = slow_segments([odds.get(k, 0.0) - price for k in range(n)])
        assert [(a, b, pytest.approx(s)) for a, b, s in want] == got


def test_segments_are_linear():
    rng = np.random.default_rng(4)
    many = [(k, float(x)) for k, x in enumerate(rng.random(300_000) * 2)]
    assert sum(s for *_, s in toxicity.segments(many, 1.0)) > 0
    assert len(toxicity.segments([(2 * k, 1.0) for k in range(200_000)], 0.7)) == 200_000


def test_held_out_accuracy_and_passages(spark):
    rows = corpus(1500)
    copies = [(10_000 + k, rows[3][1].replace("ou", "ow", k % 7), rows[3][2]) for k in range(400)]  # near copies of one text
    docs, labels = frames(spark, rows + copies)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    held = [(y, got[i].predicted) for i, _, y in rows if got[i].held_out]
    assert np.mean([y == p for y, p in held]) > 0.99 and len(held) > 300
    for i, text, y in rows:
        if y and got[i].predicted:
            inside = " ".join(text[p.start : p.end] for p in got[i].passages)
            assert sum(w.isupper() for w in inside.split()) >= 0.8 * sum(w.isupper() for w in text.split()) and all(p.expected < 0.05 for p in got[i].passages)
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs.repartition(7), labels.repartition(3)).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())


def test_labels_are_no_input(spark):
    """Labels of held-out rows, and ids, change no score."""
    rows = corpus(600, 1)
    docs, labels = frames(spark, rows)
    base = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.score_toxicity(docs, other).collect()} == base


def test_edges(spark):
    long = "an er " * 300_000 + "zonk blarg zonk fleep grunx zonk " + "the ou " * 200_000
    rows = corpus(500, 2)
    docs, labels = frames(spark, rows)
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n12 !"), (None, "zonk blarg fleep grunx zonk"), (-5, long), (-6, "İ zonk İ blarg fleep zonk grunx"), (-7, rows[0][1]), (-7, rows[0][1])], "doc_id long, text string")
    odd = spark.createDataFrame([(None, 1), (0, None), (1, 7), (99_999, 1), (2, 0), (2, 0)], "doc_id long, toxic long")
    table = docs.unionByName(more).withColumns({"score": F.lit("own"), "found": F.lit("own"), "row": F.lit(3), "label": F.lit("own")})
    got = toxicity.score_toxicity(table, labels.unionByName(odd)).where("doc_id < 0 or doc_id is null").collect()
    assert {r.row for r in got} == {3} and {r.found for r in got} == {"own"} and len(got) == 8
    by = {r.doc_id: r for r in got}
    assert by[-1].score == by[-2].score == by[-3].score < 0.5 and by[-1].predicted == 0 and by[-1].passages == []
    assert by[None].predicted == 1 and by[-6].predicted == 1
    (p,) = by[-5].passages
    assert long[p.start : p.end] == "zonk blarg zonk fleep grunx zonk"
    assert "İ zonk İ blarg fleep zonk grunx"[by[-6].passages[0].start :].startswith("zonk")


def test_nothing_to_learn(spark):
    docs, labels = frames(spark, [(k, "some text", 0) for k in range(20)])
    assert {(r.score, r.predicted) for r in toxicity.score_toxicity(docs, labels).collect()} == {(0.0, 0)}
    assert toxicity.score_toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_table_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op12_toxic_segments(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    (right,) = out.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()
    assert right > 0.9 and out.count() == 1000
