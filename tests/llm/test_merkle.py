"""op13 against a tree made in plain Python."""

import collections
import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tarazu.llm import merkle, oracle, queries

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields):
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def siblings(levels, at):
    for nodes in levels[:-1]:
        run = range(at // 3 * 3, min(at // 3 * 3 + 3, len(nodes)))
        yield [nodes[k] for k in run if k < at], [nodes[k] for k in run if k > at]
        at //= 3


def brute(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (*_, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            proof = [*siblings(trees[s], at), *siblings(top, k)]
            even = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0
            now = leaf_of((*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]))
            for left, right in proof:
                now = h(*left, now, *right)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], h(*(x for left, right in proof for x in (*left, *right))), now, now == top[-1][0]))
    return out


def found(spark, rows, tmp_path):
    spark.createDataFrame(rows, KIND).withColumn("tree", F.lit("clash")).withColumn("h", F.lit("clash")).withColumn("pos", F.lit(1)).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()]


# 244 and 730 need one level more than a power of three; 81 is just one kept level; a lone source's root is its subroot
@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2, None: 1}, {"a": 81}, {"a": 82, "b": 3}, {"a": 730, "ü": 244, "Z": 9, "": 10, None: 28}, {f"s{k}": k % 5 + 1 for k in range(100)}])
def test_manifest_sizes(spark, tmp_path, sizes):
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            k += 7
            rows.append((k * 1000003 % 100003, s, "en" if k % 3 else None, k, f"text {k}\n{'é' * (k % 4)}\nline"))
    assert sorted(found(spark, rows, tmp_path)) == sorted(brute(rows))


def test_manifest_edges(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "a", "en", 0, ""), (None, "a", "en", 0, "x\n"), (5, "a", None, 3, "one"), (5, "a", None, 3, "one"), (5, "a", None, 3, "two"), (-4, "a", "fr", 1, "\n"), (6, "", "-", 9, "l\nong " * 100_000), (7, "=", "", 2, "日本\n語"), (8, "-", "en", 1, None)]
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(found(spark, rows, tmp_path), key=key) == sorted(brute(rows), key=key)


def test_manifest_empty(spark, tmp_path):
    assert found(spark, [], tmp_path) == []


def test_hot_source_spreads(spark):
    """A source with all rows is ranked and built by several tasks."""
    rows = spark.range(3000).select(F.lit("=a").alias("tree"), F.col("id").alias("doc_id"))
    got = merkle.ranked(rows, "tree", ["doc_id"], "test")
    assert got.where(F.col("pos") != F.col("doc_id")).count() == 0 and got.where("n = 3000").count() == 3000


def test_manifest_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = duck.execute(oracle.ORACLES["op13_merkle_manifest"])
    names = [d[0] for d in cur.description]
    mine = queries.op13_merkle_manifest(spark, sf).select(*names)
    theirs = cur.fetchall()
    assert sorted(tuple(r) for r in mine.collect()) == sorted(theirs) and {r[names.index("verified")] for r in theirs} == {True, False}
