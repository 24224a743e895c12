"""Every query of the library against its DuckDB SQL on the smallest tables."""

import collections
import math
import os

import duckdb
import pytest

from tarazu.plans import data, evaluation  # noqa: F401
from tarazu.plans.registry import ORACLES, QUERIES, TABLES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    mine = collections.Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = collections.Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert mine == theirs


def test_entry_without_the_llm_folder(spark):
    import importlib
    import sys

    hidden = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith(("tarazu.llm", "corpus_pipeline", "__spark_entry__"))}
    sys.modules["tarazu.llm"] = None
    try:
        entry = importlib.import_module("__spark_entry__")
        assert set(entry.queries()) == set(QUERIES) and entry.entry(spark).count() > 0
    finally:
        for k in ("tarazu.llm", "__spark_entry__"):
            sys.modules.pop(k, None)
        sys.modules.update(hidden)
