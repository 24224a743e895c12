"""Scores to probabilities, calibration, baselines; metrics over the long form.

Long form: a row per question and option with run, id, idx, option_id, g (gold probability), and score or p.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarazu.functions.seeded import h32
from tarazu.sources.shared import written

QUESTION = ["run", "id"]
#: Temperatures tried, in steps of 0.05.
GRID = (5, 80)


def softmax_options(long: DataFrame, key: list[str] = QUESTION, score: str = "score", temperature: Column | None = None) -> DataFrame:
    """p per option: the exponential of the score over the temperature, less the question's largest, over their sum."""
    w = W.partitionBy(*key)
    s = F.col(score) if temperature is None else F.col(score) / temperature
    e = long.withColumn("__s", s).withColumn("__e", F.exp(F.col("__s") - F.max("__s").over(w)))
    return e.withColumn("p", F.col("__e") / F.sum("__e").over(w)).drop("__s", "__e")


def letter_probs(offered: DataFrame, letters: DataFrame, key: list[str] = QUESTION) -> DataFrame:
    """Option letters' probabilities made to sum to 1 over the letters that a question offers; a letter without any counts 0."""
    d = offered.withColumn("letter", F.char(F.col("idx") + 65)).join(letters, [*key, "letter"], "left").withColumn("lp", F.coalesce("lp", F.lit(0.0)))
    return d.withColumn("p", F.try_divide(F.col("lp"), F.sum("lp").over(W.partitionBy(*key)))).drop("lp")


def top1(long: DataFrame, keep: list[str] = QUESTION) -> DataFrame:
    """A row per question: predicted and gold option, confidence, correct. Ties go to the lowest index. One aggregation, no window.

    A task sorts what it has by question. Where rows of one task make many options each, as in a cross join, top1_in_row needs no sort.
    """
    best = lambda c, what: F.max_by(what, F.struct(F.col(c), -F.col("idx")))
    d = long.groupBy(*keep).agg(best("p", "option_id").alias("pred"), F.max("p").alias("conf"), best("g", "option_id").alias("gold"), best("p", "idx").alias("pred_idx"), best("g", "idx").alias("gold_idx"))
    return d.withColumn("correct", F.col("pred") == F.col("gold"))


def top1_in_row(df: DataFrame, options: Column, keep: list[str] = QUESTION) -> DataFrame:
    """top1 of rows that hold a question each, its options as an array of (idx, option_id, p, g): nothing is sorted or moved."""
    best = lambda c: F.array_max(F.transform("__o", lambda o: F.struct(o[c].alias("v"), (-o["idx"]).alias("i"), o["option_id"].alias("option_id"))))
    d = df.select(*keep, options.alias("__o")).select(*keep, best("p").alias("__p"), best("g").alias("__g"))
    d = d.select(*keep, F.col("__p.option_id").alias("pred"), F.col("__p.v").alias("conf"), F.col("__g.option_id").alias("gold"), (-F.col("__p.i")).alias("pred_idx"), (-F.col("__g.i")).alias("gold_idx"))
    return d.withColumn("correct", F.col("pred") == F.col("gold"))


def nll(g: Column, p: Column) -> Column:
    return -F.sum(F.when(g > 0, g * F.ln(F.greatest(p, F.lit(1e-12)))).otherwise(0.0))


def temperature_grid(long: DataFrame, by: list[str], key: list[str] = QUESTION) -> DataFrame:
    """(by, t, loss), in one pass: the temperature of GRID with the least log-loss in each group; ties go to the smallest.

    Log-loss at a temperature needs, per question, the scores' log-sum-exp and gold mean: each question is
    gathered once as its options (their number is small), and the grid runs over that row.
    """
    lists = long.groupBy(*dict.fromkeys([*by, *key])).agg(F.collect_list(F.struct(F.col("score").alias("s"), F.col("g").alias("g"))).alias("o"), F.max("score").alias("m"))
    grid = F.transform(F.sequence(F.lit(GRID[0]), F.lit(GRID[1])), lambda k: k / F.lit(20.0))
    d = lists.withColumn("t", F.explode(grid))
    z = F.aggregate("o", F.lit(0.0), lambda a, x: a + F.exp((x["s"] - F.col("m")) / F.col("t")))
    d = d.withColumn("lse", F.ln(z))
    loss = F.aggregate("o", F.lit(0.0), lambda a, x: a - F.when(x["g"] > 0, x["g"] * F.greatest((x["s"] - F.col("m")) / F.col("t") - F.col("lse"), F.lit(-27.631021115928547))).otherwise(0.0))
    losses = d.groupBy(*by, "t").agg(F.avg(loss).alias("loss"))
    return losses.groupBy(*by).agg(F.min_by("t", F.struct(F.round("loss", 9), F.col("t"))).alias("t"), F.round(F.min("loss"), 6).alias("loss"))


def temperature_fit(long: DataFrame, by: list[str], key: list[str] = QUESTION, span: tuple[float, float] = (0.01, 100.0), tol: float = 1e-5, passes: int = 40) -> DataFrame:
    """(by, t, loss): the temperature in `span` with the least mean log-loss in each group, by a safeguarded Newton search. temperature_grid is the coarse form in one pass.

    The loss is convex in b = 1 / t: its slope is the mean of E_p[score] - E_g[score], its curvature that of Var_p[score].
    Questions are written once as arrays of their options. A first pass takes the slope at 65 points over the span, which
    brackets each group's root; each further pass gives slope and curvature at the group's own b, and a Newton step that
    leaves the bracket or is over half the last one becomes a bisection. A group rests behind a Newton step of less than `tol`
    of b, whose own error is of the order of its square, or a bisection of less than tol². A few passes do. The driver sees only the number of
    groups still moving; states are written after each pass but the first two.

    Null scores or gold values leave their option out; questions without gold count for nothing; gold is rescaled to sum to
    1. A group whose loss falls up to an end of the span gets that end, one whose scores say nothing 1.
    """
    o = F.struct(F.col("score").alias("s"), F.col("g").alias("g"))
    q = long.where("score is not null and g is not null").groupBy(*dict.fromkeys([*by, *key])).agg(F.collect_list(o).alias("__o"), F.max("score").alias("__m"), F.sum("g").alias("__w"))
    q = written(q.where("__w > 0").select(*by, F.transform("__o", lambda x: F.struct((x["s"] - F.col("__m")).alias("s"), (x["g"] / F.col("__w")).alias("g"))).alias("__o")), "questions")
    add = lambda f: F.aggregate("__o", F.lit(0.0), lambda a, x: a + f(x))
    e = lambda x: F.exp(x["s"] * F.col("__b"))

    def slopes(at: DataFrame) -> DataFrame:
        """at, whose rows have each a group and a __b, with the loss there, its slope and its curvature."""
        names = {k: f"__k{i}" for i, k in enumerate(by)}
        d = q.join(at.withColumnsRenamed(names), [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]).withColumn("__z", add(e)).withColumn("__e", add(lambda x: x["s"] * e(x)) / F.col("__z"))
        var = add(lambda x: (x["s"] - F.col("__e")) * (x["s"] - F.col("__e")) * e(x)) / F.col("__z")
        gold = add(lambda x: x["s"] * x["g"])
        return d.groupBy(*at.columns).agg(F.avg(F.col("__e") - gold).alias("__slope"), F.avg(var).alias("__curve"), F.avg(F.ln("__z") - F.col("__b") * gold).alias("__loss"))

    def step(state: DataFrame) -> DataFrame:
        s = slopes(state)
        s = s.withColumn("__lo", F.when(F.col("__slope") < 0, F.col("__b")).otherwise(F.col("__lo"))).withColumn("__hi", F.when(F.col("__slope") >= 0, F.col("__b")).otherwise(F.col("__hi")))
        newton = F.col("__b") - F.try_divide(F.col("__slope"), F.col("__curve"))
        good = newton.between(F.col("__lo"), F.col("__hi")) & (F.abs(newton - F.col("__b")) <= F.col("__step") / 2)
        s = s.withColumn("__good", F.coalesce(good, F.lit(False)))
        n = F.when(F.col("__done"), F.col("__b")).when(F.col("__good"), newton).otherwise((F.col("__lo") + F.col("__hi")) / 2)
        s = s.withColumn("__n", n).withColumn("__step", F.abs(F.col("__n") - F.col("__b")))
        rests = F.col("__done") | (F.col("__step") <= F.col("__n") * F.when(F.col("__good"), tol).otherwise(tol * tol))
        return s.select(*by, "__lo", "__hi", F.col("__n").alias("__b"), "__step", rests.alias("__done"))

    low, high = 1.0 / span[1], 1.0 / span[0]
    points = F.explode(F.array(*[F.lit(low * (high / low) ** (i / 64)) for i in range(64)], F.lit(high)))
    first = slopes(q.select(*by).distinct().select(*by, points.alias("__b")))
    lo, hi = F.max(F.when(F.col("__slope") < 0, F.struct("__b", "__slope"))), F.min(F.when(F.col("__slope") >= 0, F.struct("__b", "__slope")))
    state = first.groupBy(*by).agg(lo.alias("__lo"), hi.alias("__hi"), F.max(F.abs("__slope")).alias("__most"))
    settled = F.when(F.col("__most") == 0, 1.0).when(F.col("__lo").isNull(), F.lit(low)).when(F.col("__hi").isNull(), F.lit(high))
    lo, hi = F.col("__lo"), F.col("__hi")
    chord = lo["__b"] - lo["__slope"] * (hi["__b"] - lo["__b"]) / (hi["__slope"] - lo["__slope"])
    b = F.coalesce(settled, chord)
    state = state.select(*by, F.coalesce(lo["__b"], b).alias("__lo"), F.coalesce(hi["__b"], b).alias("__hi"), b.alias("__b"), F.coalesce(hi["__b"] - lo["__b"], F.lit(0.0)).alias("__step"), settled.isNotNull().alias("__done"))
    state = written(step(step(state)), "temperatures")
    for _ in range(passes):
        if not state.where("not __done").count():
            break
        state = written(state.where("__done").unionByName(step(state.where("not __done"))), "temperatures")
    return slopes(state).select(*by, F.round(1.0 / F.col("__b"), 6).alias("t"), F.round("__loss", 6).alias("loss"))


def temperature_apply(long: DataFrame, temperatures: DataFrame, by: list[str]) -> DataFrame:
    """p from scores rescaled by each group's temperature; groups without one keep 1."""
    d = long.join(temperatures.select(*by, "t"), by, "left").withColumn("t", F.coalesce("t", F.lit(1.0)))
    return softmax_options(d, temperature=F.col("t"))


def baseline_random(long: DataFrame, seed: int = 0, key: list[str] = ["id"]) -> DataFrame:  # noqa: B006
    """p = 1 / options, and pick: the option whose index is a seeded hash modulo the number of options."""
    d = long.withColumn("__n", F.count("*").over(W.partitionBy(*key)))
    return d.withColumn("p", 1.0 / F.col("__n")).withColumn("pick", h32(F.lit(seed), *[F.col(k) for k in key]) % F.col("__n") == F.col("idx")).drop("__n")


def baseline_majority(train: DataFrame, test: DataFrame, task: str = "task") -> DataFrame:
    """test with pred, the label most frequent in train for its task; ties go to the first label in order."""
    n = train.groupBy(task, "label").agg(F.count("*").alias("n"))
    best = n.groupBy(task).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("pred"))
    return test.join(best, task, "left")


def two_step_choice(scenario: DataFrame, intent: DataFrame, of: DataFrame) -> DataFrame:
    """(run, id, option_id, p): the best intent by P(scenario) · P(intent), renormalised. of: (option_id of the intent, scenario)."""
    d = intent.join(of, "option_id").join(scenario.select("run", "id", F.col("option_id").alias("scenario"), F.col("p").alias("ps")), ["run", "id", "scenario"])
    d = d.withColumn("q", F.col("p") * F.col("ps")).groupBy("run", "id").agg(F.max_by("option_id", F.struct("q", -F.col("idx"))).alias("option_id"), (F.max("q") / F.sum("q")).alias("p"))
    return d


# Metrics. top: rows of top1() with whatever columns `by` names; long: the long form.


def r6(c: Column) -> Column:
    return F.round(c, 6)


def m_accuracy(top: DataFrame, by: list[str]) -> DataFrame:
    return top.groupBy(*by).agg(F.count("*").alias("n"), r6(F.avg(F.col("correct").cast("double"))).alias("accuracy"))


def m_confusion(top: DataFrame, by: list[str]) -> DataFrame:
    return top.groupBy(*by, "gold", "pred").agg(F.count("*").alias("n"))


def m_macro_f1(top: DataFrame, by: list[str]) -> DataFrame:
    """Mean F1 over the classes found in gold or predictions; 0 for a class without a hit."""
    c = m_confusion(top, by)
    sides = c.select(*by, "n", (F.col("gold") == F.col("pred")).alias("hit"), F.explode(F.array_distinct(F.array("gold", "pred"))).alias("cls"))
    f = sides.groupBy(*by, "cls").agg(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~F.col("hit"), F.col("n")).otherwise(0)).alias("wrong"))
    return f.groupBy(*by).agg(F.count("*").alias("classes"), r6(F.avg(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("wrong")))).alias("macro_f1"))


def conf_bin(bins: int = 10) -> Column:
    return F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).cast("int")


def m_ece(top: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    b = top.withColumn("bin", conf_bin(bins)).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("acc"), F.avg("conf").alias("conf"))
    return b.groupBy(*by).agg(r6(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def m_reliability(top: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """A row per group and bin, empty bins too."""
    b = top.withColumn("bin", conf_bin(bins)).groupBy(*by, "bin").agg(F.count("*").alias("n"), r6(F.avg(F.col("correct").cast("double"))).alias("accuracy"), r6(F.avg("conf")).alias("confidence"))
    every = top.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(b, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _per_question(long: DataFrame, by: list[str], value: Column, name: str, key: list[str] = QUESTION) -> DataFrame:
    q = long.groupBy(*dict.fromkeys([*by, *key])).agg(value.alias("v"))
    return q.groupBy(*by).agg(r6(F.avg("v")).alias(name))


def m_brier(long: DataFrame, by: list[str]) -> DataFrame:
    return _per_question(long, by, F.sum((F.col("p") - F.col("g")) * (F.col("p") - F.col("g"))), "brier")


def m_log_loss(long: DataFrame, by: list[str]) -> DataFrame:
    return _per_question(long, by, nll(F.col("g"), F.col("p")), "log_loss")


def m_total_variation(long: DataFrame, by: list[str]) -> DataFrame:
    return _per_question(long, by, 0.5 * F.sum(F.abs(F.col("p") - F.col("g"))), "tv")


def m_jensen_shannon(long: DataFrame, by: list[str]) -> DataFrame:
    m = (F.col("p") + F.col("g")) / 2
    half = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    return _per_question(long, by, F.sum(0.5 * half(F.col("p")) + 0.5 * half(F.col("g"))), "js")


def m_acc_coverage(top: DataFrame, by: list[str], step: int = 5) -> DataFrame:
    """(by, threshold in %, coverage, accuracy): answers with at least that confidence. One aggregation per threshold over partial sums, no window."""
    cut = F.floor(F.col("conf") * 100 / step + 1e-9).cast("int")
    have = top.withColumn("cut", cut).groupBy(*by, "cut").agg(F.count("*").alias("m"), F.sum(F.col("correct").cast("long")).alias("hit"))
    grid = have.withColumn("threshold", F.explode(F.transform(F.sequence(F.lit(0), F.lit(100 // step)), lambda k: k * step)))
    ok = F.col("cut") * step >= F.col("threshold")
    out = grid.groupBy(*by, "threshold").agg(F.sum("m").alias("n"), F.sum(F.when(ok, F.col("m")).otherwise(0)).alias("kept"), F.sum(F.when(ok, F.col("hit")).otherwise(0)).alias("hits"))
    return out.select(*by, "threshold", r6(F.col("kept") / F.col("n")).alias("coverage"), r6(F.try_divide(F.col("hits").cast("double"), F.col("kept").cast("double"))).alias("accuracy"))


def m_gate(curve: DataFrame, by: list[str], target: float) -> DataFrame:
    """(by, threshold, coverage): the lowest threshold that reaches the accuracy, null where none does."""
    ok = F.when(F.col("accuracy") >= target, F.col("threshold"))
    return curve.groupBy(*by).agg(F.min(ok).alias("threshold"), F.min_by("coverage", ok).alias("coverage"))


def m_within_one(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(r6(F.avg((F.abs(F.col("pred") - F.col("gold")) <= 1).cast("double"))).alias("within_one"))


def m_mae(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(r6(F.avg(F.abs(F.col("pred") - F.col("gold")).cast("double"))).alias("mae"))


def m_language_gap(top: DataFrame, by: list[str], first: str = "en", second: str = "fa") -> DataFrame:
    """(by, n, gap): accuracy in the first language less that in the second, over questions asked in both."""
    a = top.where(F.col("lang") == first).select(*by, "qid", F.col("correct").cast("int").alias("a"))
    b = top.where(F.col("lang") == second).select(*by, "qid", F.col("correct").cast("int").alias("b"))
    return a.join(b, [*by, "qid"]).groupBy(*by).agg(F.count("*").alias("n"), r6(F.avg((F.col("a") - F.col("b")).cast("double"))).alias("gap"))


def m_latency(df: DataFrame, by: list[str], ms: str) -> DataFrame:
    return df.groupBy(*by).agg(r6(F.percentile(ms, F.lit(0.5))).alias("p50"), r6(F.percentile(ms, F.lit(0.95))).alias("p95"))


def latency_sketch(df: DataFrame, by: list[str], ms: str, k: int = 400) -> DataFrame:
    """(by, n, sketch): a KLL sketch of the values, a few kB however many there are, to be stored per run and day and merged later; nulls and NaN aren't counted.

    The rank of a quantile read from it is off by at most about 2.3 / k^0.9 of n (99 % of the time).
    """
    v = F.when(~F.isnan(ms), F.col(ms))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def latency_quantiles(sketches: DataFrame, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """(by, n, a column per quantile) from stored sketches, those of a group merged; null for a group without values."""
    m = sketches.where("n > 0").groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    m = sketches.select(*by).distinct().alias("a").join(m.alias("m"), [F.col(f"a.{x}").eqNullSafe(F.col(f"m.{x}")) for x in by], "left")
    return m.select(*[F.col(f"a.{x}").alias(x) for x in by], F.coalesce("n", F.lit(0)).alias("n"), *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in quantiles.items()])


def m_memory(df: DataFrame, by: list[str], mb: str) -> DataFrame:
    return df.groupBy(*by).agg(r6(F.max(mb)).alias("peak"))


def m_by_slice(top: DataFrame, run: str, dims: list[str]) -> DataFrame:
    """Accuracy by run and every prefix of the dimensions, down to the run alone."""
    sets = [[run, *dims[:k]] for k in range(len(dims), -1, -1)]
    return top.groupingSets(sets, run, *dims).agg(F.count("*").alias("n"), r6(F.avg(F.col("correct").cast("double"))).alias("accuracy"), F.grouping_id(run, *dims).cast("long").alias("level"))
