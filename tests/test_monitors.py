"""Intents behind scenarios, and tasks held out, by hand."""

from pyspark.sql import functions as F

from tarazu.operators import compare as C


def test_intents_behind_scenarios(spark):
    top = spark.createDataFrame([(0, "a", "a"), (0, "b", "a"), (0, "c", "a"), (0, None, "b"), (0, "z", "z"), (1, "a", None)], "run int, pred string, gold string")
    options = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t")], "option_id string, scenario string")
    got = {r.run: (r.n, r.intent, r.scenario, r.scenario_gap) for r in C.scenario_gap(top, options, ["run"]).collect()}
    # z is right as an option, but belongs to no scenario
    assert got == {0: (5, 0.4, 0.4, 0.0), 1: (1, 0.0, 0.0, 0.0)}
    more = C.scenario_gap(top.where("gold = 'a'"), options, ["run"]).first()
    assert (more.intent, more.scenario, more.scenario_gap) == (0.333333, 0.666667, 0.333333)
    assert C.scenario_gap(top.limit(0), options, ["run"]).count() == 0


def test_transfer(spark):
    rows = [("rote", h, i % 10 < (5 if h else 9)) for h in (True, False) for i in range(100)] + [("sound", h, i % 10 < 8) for h in (True, False) for i in range(100)] + [("chance", h, i % 2 == 0) for h in (True, False) for i in range(100)] + [("alone", None, True), ("alone", False, None)]
    top = spark.createDataFrame(rows, "run string, out boolean, correct boolean")
    got = {r.run: tuple(r)[1:] for r in C.transfer_gap(top, ["run"], F.col("out"), F.lit(0.5)).collect()}
    assert got["rote"] == (100, 100, 0.9, 0.5, 0.4, True) and got["sound"] == (100, 100, 0.8, 0.8, 0.0, False) and got["chance"][-1] is False
    assert got["alone"][:5] == (2, 0, 0.5, None, None) and not got["alone"][5]
    assert C.transfer_gap(top.limit(0), ["run"], F.col("out"), F.lit(0.5)).count() == 0
