"""Shares, floors and totals at once, against every level there is."""

import random
from collections import Counter

import pytest

from tarazu.operators import mix as M


def brute(counts, share, floor, least, most):
    """(targets, or the bound that can't hold): the highest common level, tried one by one."""
    w = {s: max(n, floor) for s, n in counts.items()}
    if len(w) * share < 1 - 1e-9:
        return "share"
    if most is not None and len(w) * floor > most:
        return "most"
    best = None
    for level in range(floor, max(w.values()) + 1):
        whole = sum(min(x, level) for x in w.values())
        if level <= share * whole + 1e-9 and (most is None or whole <= most):
            best = level
    got = {s: min(x, best) for s, x in w.items()}
    return got if sum(got.values()) >= least else "least"


def test_plans_against_every_level(spark):
    rnd = random.Random(5)
    seen = Counter()
    for k in range(14):
        counts = {(None if i == 0 and k % 2 else f"s{i}"): rnd.choice([1, 3, 40, 200, 1000, 5000]) for i in range(rnd.randrange(2, 9))}
        share, floor, least, most = rnd.choice([0.2, 0.3, 0.5]), rnd.choice([1, 20, 150]), rnd.choice([0, 0, 500]), rnd.choice([None, 300, 2000])
        want = brute(counts, share, floor, least, most)
        c = spark.createDataFrame([*counts.items(), ("empty", 0)], "source string, n long")
        if isinstance(want, str):
            with pytest.raises(ValueError, match=f"^{want}:"):
                M.balance_plan(c, share, floor, least, most)
        else:
            got = {r.source: r.target for r in M.balance_plan(c, share, floor, least, most, ways=rnd.choice([2, 3, 32])).collect()}
            assert got == want
            whole = sum(got.values())
            assert all(floor <= x <= share * whole + 1e-6 for x in got.values()) and whole >= least and (most is None or whole <= most)
        seen[want if isinstance(want, str) else "plan"] += 1
    assert len(seen) >= 3 and seen["plan"] >= 3


def test_rows_of_a_balanced_mix(spark):
    rows = [(f"big{i}", "big", 7) for i in range(300)] + [(f"m{i}", "mid", 8) for i in range(60)] + [(f"n{i}", None, 9) for i in range(10)] + [("same", "four", 1)] * 3
    d = spark.createDataFrame(rows, "id string, source string, n int")
    out = M.mix_balance(d, share=0.4, floor=25, most=180)
    assert out.columns == ["id", "source", "n", "copy"]
    got = out.collect()
    plan = brute({"big": 300, "mid": 60, None: 10, "four": 3}, 0.4, 25, 0, 180)
    assert Counter(r.source for r in got) == plan
    times = Counter(r.id for r in got if r.source is None)
    assert len(times) == 10 and set(times.values()) == {2, 3}
    again = M.mix_balance(d.repartition(5), share=0.4, floor=25, most=180).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert M.mix_balance(d.limit(0)).count() == 0
