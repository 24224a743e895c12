"""Run logs, paired comparison, robustness, gates, monitors and report tables."""

import math
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarazu.functions.seeded import h32
from tarazu.functions.text import swap_digits

#: Cumulative Poisson(1) probabilities of 0 to 12: a uniform number below the k-th means weight k. One in 2^32 can't tell more apart.
POISSON = tuple(accumulate(math.exp(-1) / math.factorial(k) for k in range(13)))
#: Replicates whose weights come from one MD5.
LANES = 4


# Run logs


def run_registry(rows: DataFrame) -> DataFrame:
    """The latest row of each run (by date, then all else)."""
    return rows.groupBy("run_id").agg(F.max(F.struct("date", *[c for c in rows.columns if c not in ("run_id", "date")])).alias("r")).select("run_id", "r.*")


def run_config_diff(runs: DataFrame, a: str, b: str) -> DataFrame:
    """(key, a, b) of the settings in which two runs differ; a missing key is null. runs: (run_id, settings map)."""
    side = lambda run, name: runs.where(F.col("run_id") == run).select(F.explode("settings").alias("key", name))
    return side(a, "a").join(side(b, "b"), "key", "full").where("not (a <=> b)")


def curve_summary(curve: DataFrame, k: int = 3) -> DataFrame:
    """(run_id, metric, first, last, least, last_avg): last_avg is the mean of the last k values."""
    w = W.partitionBy("run_id", "metric").orderBy("step").rowsBetween(-(k - 1), 0)
    d = curve.withColumn("avg", F.avg("value").over(w))
    return d.groupBy("run_id", "metric").agg(F.min_by("value", "step").alias("first"), F.max_by("value", "step").alias("last"), F.min("value").alias("least"), F.round(F.max_by("avg", "step"), 6).alias("last_avg"))


def early_stop(curve: DataFrame, patience: int = 3) -> DataFrame:
    """(run_id, best_step, best, stop_step): the step with the least value before `patience` values in a row fail to beat the best so far; stop_step null if it never stops."""
    w = W.partitionBy("run_id").orderBy("step")
    d = curve.where("not isnan(value)").withColumn("before", F.min("value").over(w.rowsBetween(W.unboundedPreceding, -1)))
    d = d.withColumn("n", F.row_number().over(w)).withColumn("better", F.col("before").isNull() | (F.col("value") < F.col("before")))
    d = d.withColumn("since", F.col("n") - F.max(F.when(F.col("better"), F.col("n"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("stop", F.min(F.when(F.col("since") >= patience, F.col("step"))).over(W.partitionBy("run_id"))).where("stop is null or step <= stop")
    return d.groupBy("run_id").agg(F.min_by("step", F.struct("value", "step")).alias("best_step"), F.min("value").alias("best"), F.min("stop").alias("stop_step"))


def run_health(curve: DataFrame, budget: float) -> DataFrame:
    """(run_id, nan_steps, falls, over_budget) from metrics `loss` and `runtime`: falls where the last loss is below the first."""
    loss, ok = F.col("metric") == "loss", ~F.isnan("value")
    step = F.when(loss & ok, F.col("step"))
    d = curve.groupBy("run_id").agg(F.sum((loss & ~ok).cast("long")).alias("nan_steps"), F.min_by("value", step).alias("a"), F.max_by("value", step).alias("b"), F.max(F.when(F.col("metric") == "runtime", F.col("value"))).alias("t"))
    return d.select("run_id", "nan_steps", (F.col("b") < F.col("a")).alias("falls"), F.coalesce(F.col("t") > budget, F.lit(False)).alias("over_budget"))


def error_sample(top: DataFrame, n: int = 50, seed: int = 0) -> DataFrame:
    """(run, id, rn): n wrong answers of each run by seeded hash."""
    w = W.partitionBy("run").orderBy(h32(F.lit(seed), F.col("run"), F.col("id")), "id")
    return top.where("not correct").select("run", "id", F.row_number().over(w).alias("rn")).where(F.col("rn") <= n)


#: The tags of wrong answers.
TAGS = ("translation", "ambiguous", "truncated", "number", "colloquial", "label_noise")


def error_tags(tags: DataFrame) -> DataFrame:
    """Shares of the tags by run."""
    n = F.count("*")
    return tags.groupBy("run").agg(*[F.round(F.sum((F.col("tag") == t).cast("double")) / n, 6).alias(t) for t in TAGS])


def artifact_check(runs: DataFrame, artifacts: DataFrame, required: tuple[str, ...] = ("checkpoint", "tokenizer", "temperature", "mix_version", "card")) -> DataFrame:
    """(run_id, kind): what each run lacks."""
    need = runs.select("run_id", F.explode(F.array(*[F.lit(k) for k in required])).alias("kind"))
    return need.join(artifacts.select("run_id", "kind"), ["run_id", "kind"], "left_anti")


# Comparison


def align_items(items: DataFrame) -> DataFrame:
    """Rows (run, id, …) of the items that all runs have."""
    runs = items.select("run").distinct().agg(F.count("*").alias("__all"))
    full = items.groupBy("id").agg(F.countDistinct("run").alias("__n")).crossJoin(F.broadcast(runs)).where("__n = __all").select("id")
    return items.join(full, "id", "left_semi")


def poisson_weight(digest: Column, lane: int) -> Column:
    """A Poisson(1) weight from the lane-th 8 hex digits of an MD5."""
    u = F.conv(F.substring(digest, 1 + 8 * lane, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    w = F.when(u < POISSON[0], 0)
    for k, cut in enumerate(POISSON[1:], 1):
        w = w.when(u < cut, k)
    return w.otherwise(len(POISSON))


def boot_sums(items: DataFrame, by: list[str], values: list[str], replicates: int = 1000, unit: str = "id") -> DataFrame:
    """(by, r, w, values): for each replicate the sum of weights and the weighted sums of the values; r = 0 has all weights 1.

    A unit (an item, or a case with its decisions) has one weight in a replicate, the same in every group, run and engine: the MD5 of
    unit and block of LANES replicates. It is worked out once for a unit's values together, and partial sums leave the task, one row
    per group and block; resampled items are never materialised or shuffled. A unit's values are gathered once (they are few).
    """
    held = items.groupBy(F.col(unit).alias("__u")).agg(F.collect_list(F.struct(*by, *[F.col(v).cast("double").alias(v) for v in values])).alias("__items"))
    d = held.withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // LANES) - 1))))
    digest = F.md5(F.concat(F.col("__q").cast("string"), F.lit(":"), F.col("__u").cast("string")))
    d = d.withColumn("__d", digest).select("*", *[poisson_weight(F.col("__d"), k).alias(f"__w{k}") for k in range(LANES)])
    d = d.select("__q", *[f"__w{k}" for k in range(LANES)], F.explode("__items").alias("__i")).select("__q", *[f"__w{k}" for k in range(LANES)], "__i.*")
    lane = lambda k: F.struct((F.col("__q") * LANES + k + 1).alias("r"), F.col(f"__s{k}").alias("w"), *[F.col(f"__{v}_{k}").alias(v) for v in values])
    sums = [x for k in range(LANES) for x in (F.sum(f"__w{k}").alias(f"__s{k}"), *[F.sum(F.col(f"__w{k}") * F.col(v)).alias(f"__{v}_{k}") for v in values])]
    out = d.groupBy(*by, "__q").agg(*sums).select(*by, F.explode(F.array(*[lane(k) for k in range(LANES)])).alias("__x")).select(*by, "__x.*").where(F.col("r") <= replicates)
    whole = items.groupBy(*by).agg(F.count("*").alias("w"), *[F.sum(F.col(v).cast("double")).alias(v) for v in values]).select(*by, F.lit(0).alias("r"), "w", *values)
    return out.unionByName(whole)


def boot_stat(items: DataFrame, by: list[str], values: list[str], stat: str, name: str, replicates: int = 1000, unit: str = "id") -> DataFrame:
    """(by, name, low, high): 95 % interval, by Poisson bootstrap, of any expression of the weighted sums: `stat` is SQL over w (the sum of weights) and the values.

    So intervals of means, of differences of means (a language gap), of ratios (F1) and of sums over bins (ECE) are the same work.
    """
    d = boot_sums(items, by, values, replicates, unit).withColumn("__m", F.expr(stat))
    q = lambda x: F.round(F.percentile(F.when(F.col("r") > 0, F.col("__m")), F.lit(x)), 6)
    return d.groupBy(*by).agg(F.round(F.max(F.when(F.col("r") == 0, F.col("__m"))), 6).alias(name), q(0.025).alias("low"), q(0.975).alias("high"))


def boot_ci(items: DataFrame, by: list[str], value: str, replicates: int = 1000, unit: str = "id") -> DataFrame:
    """(by, mean, low, high): 95 % interval of a mean by Poisson bootstrap; pass the case as unit where a case has several items."""
    return boot_stat(items, by, [value], f"try_divide(`{value}`, w)", "mean", replicates, unit)


def boot_ece(top: DataFrame, by: list[str], replicates: int = 1000, unit: str = "id", bins: int = 10) -> DataFrame:
    """(by, ece, low, high): interval of the expected calibration error."""
    at = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1))
    gap = F.col("correct").cast("double") - F.col("conf")
    d = top.select("*", *[F.when(at == k, gap).otherwise(0.0).alias(f"gap{k}") for k in range(bins)])
    return boot_stat(d, by, [f"gap{k}" for k in range(bins)], "try_divide(" + " + ".join(f"abs(gap{k})" for k in range(bins)) + ", w)", "ece", replicates, unit)


def boot_gap(top: DataFrame, by: list[str], first: Column, second: Column, replicates: int = 1000, unit: str = "id") -> DataFrame:
    """(by, gap, low, high): interval of the accuracy where `first` holds less that where `second` does."""
    c = F.col("correct").cast("double")
    d = top.select("*", *[F.when(x, v).otherwise(0.0).alias(n) for n, x, v in (("n1", first, F.lit(1.0)), ("c1", first, c), ("n2", second, F.lit(1.0)), ("c2", second, c))])
    return boot_stat(d, by, ["n1", "c1", "n2", "c2"], "try_divide(c1, n1) - try_divide(c2, n2)", "gap", replicates, unit)


def paired(items: DataFrame, value: str, unit: str = "id") -> DataFrame:
    """(a, b, id, d and the unit): for every two runs a < b the difference value(b) - value(a) on the items that both have."""
    x = items.select(F.col("run").alias("a"), *dict.fromkeys(["id", unit]), F.col(value).cast("double").alias("x"))
    y = items.select(F.col("run").alias("b"), "id", F.col(value).cast("double").alias("y"))
    return x.join(y, "id").where("a < b").select("a", "b", *dict.fromkeys(["id", unit]), (F.col("y") - F.col("x")).alias("d"))


def boot_paired(items: DataFrame, value: str, replicates: int = 1000, unit: str = "id") -> DataFrame:
    """(a, b, diff, low, high, verdict): paired intervals on the same items; a tie where 0 is inside."""
    d = boot_ci(paired(items, value, unit), ["a", "b"], "d", replicates, unit).withColumnRenamed("mean", "diff")
    return d.withColumn("verdict", F.when(F.col("low") > 0, "win").when(F.col("high") < 0, "loss").otherwise("tie"))


def compare_temperature(before: DataFrame, after: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, before, after) of two metric tables."""
    long = lambda df, name: df.unpivot(by, metrics, "metric", name)
    return long(before, "before").join(long(after, "after"), [*by, "metric"])


def vs_ceiling(metrics: DataFrame, ceiling: float) -> DataFrame:
    """accuracy beside the ceiling of its labels."""
    return metrics.withColumn("ceiling", F.lit(ceiling)).withColumn("of_ceiling", F.round(F.col("accuracy") / ceiling, 6))


# Robustness


def pert_digits(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(text, swap_digits(F.col(text)))


def pert_distractor(records: DataFrame, seed: int = 0, group_rows: int = 1024) -> DataFrame:
    """records with one more option, `distractor`: the first option text of another record of the same hash group that isn't among its own; unchanged without one.

    Only ids and first options are numbered, in groups of about `group_rows`.
    """
    r = records.select("id", F.get("options", F.lit(0))["text"].alias("__first"))
    r = r.withColumn("__g", h32(F.lit("g"), F.lit(seed), F.col("id")) % max(1, records.count() // group_rows))
    w = W.partitionBy("__g").orderBy(h32(F.lit(seed), F.col("id")), "id")
    t = r.select(F.col("id").alias("__id"), F.coalesce(F.lead("__first").over(w), F.first("__first").over(w)).alias("__t"))
    r = records.join(t, records.id == t["__id"], "left").drop("__id")
    own = F.coalesce(F.exists("options", lambda o: o["text"] == F.col("__t")), F.lit(True)) | F.col("__t").isNull()
    more = F.concat("options", F.array(F.struct(F.lit("distractor").alias("id"), F.col("__t").alias("text"))))
    gold = F.map_concat("gold", F.create_map(F.lit("distractor"), F.lit(0.0)))
    return r.withColumn("__own", own).withColumn("gold", F.when(F.col("__own"), F.col("gold")).otherwise(gold)).withColumn("options", F.when(F.col("__own"), F.col("options")).otherwise(more)).drop("__t", "__own")


def pert_register(formal: DataFrame, colloquial: DataFrame) -> DataFrame:
    """(source_id, formal, colloquial): both wordings of a case."""
    return formal.select("source_id", F.col("state").alias("formal")).join(colloquial.select("source_id", F.col("state").alias("colloquial")), "source_id")


def robust_flip(base: DataFrame, changed: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, flips): share of questions whose answer is another option than before. Both: (run, id, pred as original option id), changed also `by`."""
    d = base.select("run", "id", F.col("pred").alias("was")).join(changed, ["run", "id"])
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg((~F.col("pred").eqNullSafe(F.col("was"))).cast("double")), 6).alias("flips"))


def perturbed(records: DataFrame, colloquial: DataFrame | None = None, asked: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(id, kind, state, question_text, options, back): a row per record and kind of change, worked out in one pass over the records; back maps each option id shown to the one it was.

    Kinds: shuffle (options in a seeded order), rename (other option ids), distractor (a wrong option of another record, which
    maps back to nothing), digits (Latin and Persian ones swapped in state and question), register (the state in its
    other wording, from colloquial: id, state), english (the question from asked: question_type, question_text, where it
    isn't in English). A kind that changes nothing in a record has no row: no digits, one option, no other wording.
    records: one row per id. asked is one row per question type; where a type repeats, the first text in order counts.
    """
    d = records.select("id", "state", "question_text", "question_type", "question_lang", "options", "gold", F.col("options").alias("__was"))
    d = pert_distractor(d, seed).withColumnRenamed("options", "__more").withColumnRenamed("__was", "options").drop("gold", "__own")
    if colloquial is None:
        d = d.withColumn("__said", F.lit(None).cast("string"))
    else:
        d = d.join(colloquial.groupBy("id").agg(F.min("state").alias("__said")), "id", "left")
    if asked is None:
        d = d.withColumn("__ask", F.lit(None).cast("string"))
    else:
        d = d.join(asked.groupBy("question_type").agg(F.min("question_text").alias("__ask")), "question_type", "left")
    ids = F.transform("options", lambda o: o["id"])
    same, none = F.map_from_arrays(ids, ids), F.lit(None).cast("string")
    tagged = F.transform("options", lambda o: F.struct(h32(F.lit(seed), F.col("id"), o["id"]).alias("h"), o["id"].alias("id"), o.alias("o")))
    renamed = F.transform("options", lambda o, i: F.struct(F.concat(F.lit("opt_"), (i + 1).cast("string")).alias("id"), o["text"].alias("text")))

    def change(kind: str, when: Column, state: Column | str = "state", question: Column | str = "question_text", options: Column | str = "options", back: Column = same) -> Column:
        cols = [(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in ((state, "state"), (question, "question_text"), (options, "options"))]
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), *cols, back.alias("back")))

    kinds = F.array(
        change("shuffle", F.size("options") > 1, options=F.transform(F.array_sort(tagged), lambda x: x["o"])),
        change("rename", F.size("options") > 0, options=renamed, back=F.map_from_arrays(F.transform(renamed, lambda o: o["id"]), ids)),
        change("distractor", F.size("__more") > F.size("options"), options="__more", back=F.map_concat(same, F.create_map(F.lit("distractor"), none))),
        change("digits", ~swap_digits(F.col("state")).eqNullSafe(F.col("state")) | ~swap_digits(F.col("question_text")).eqNullSafe(F.col("question_text")), swap_digits(F.col("state")), swap_digits(F.col("question_text"))),
        change("register", F.col("__said") != F.col("state"), state=F.col("__said")),
        change("english", (F.col("question_lang") != "en") & F.col("__ask").isNotNull(), question=F.col("__ask")),
    )
    return d.select("id", F.explode(F.array_compact(kinds)).alias("__c")).select("id", "__c.*")


def answers_back(answers: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """answers (run, id, kind, pred as shown) with pred as the original option's id, null for a distractor or an unknown id. Answers that carry `back` need no changed questions, which are then not worked out again."""
    d = answers if changed is None else answers.join(changed.select("id", "kind", "back"), ["id", "kind"])
    return d.withColumn("pred", F.try_element_at("back", F.col("pred"))).select("run", "id", "kind", "pred")


def mcnemar_p(lost: int, won: int) -> float:
    """Two-sided exact McNemar test: how likely lost and won would differ so far if each were as likely as the other. About the root of their sum in steps."""
    n, k = lost + won, min(lost, won)
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    total = term = 1.0
    for i in range(k, 0, -1):
        term *= i / (n - i + 1)
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, 2 * math.exp(top) * total)


def flip_tests(base: DataFrame, changed: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, flips, lost, won, p): share of answers that became another option; answers right before and wrong after and the reverse; the exact McNemar test of these two.

    base: (run, id, pred, gold); changed: (run, id, pred as original option id, and what `by` names besides). A null answer equals a null answer only, and is never right.
    """
    d = base.select("run", "id", F.col("pred").alias("was"), "gold").join(changed, ["run", "id"])
    before, after = F.coalesce(F.col("was") == F.col("gold"), F.lit(False)), F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))
    n = d.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg((~F.col("pred").eqNullSafe(F.col("was"))).cast("double")), 6).alias("flips"), F.sum((before & ~after).cast("long")).alias("lost"), F.sum((~before & after).cast("long")).alias("won"))

    @F.pandas_udf("double")
    def p(lost: pd.Series, won: pd.Series) -> pd.Series:
        return pd.Series([mcnemar_p(int(a), int(b)) for a, b in zip(lost, won)], dtype="float64")

    return n.withColumn("p", F.round(p("lost", "won"), 6))


# Gates and monitors


def gate_criteria(metrics: DataFrame, thresholds: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, criterion, value, threshold, passed, fair): passed by the threshold's direction (`min` or `max`); fair where it was set before the run."""
    d = metrics.join(thresholds, "criterion").join(runs.select("run_id", "date"), "run_id")
    passed = F.when(F.col("direction") == "min", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return d.select("run_id", "criterion", "value", "threshold", passed.alias("passed"), (F.col("set_on") < F.col("date")).alias("fair"))


def gate_values(top: DataFrame, run: str, unit: str, first: Column, second: Column, bins: int = 10) -> DataFrame:
    """(run, unit, n1, c1, n2, c2, gap0 …): what accuracy, language gap and calibration error need of each case: answers and right ones where `first` and where `second` holds, and by bin of confidence the sum of right less confidence where `second` does.

    One row per run and case, so that replicates weigh cases and not answers. A null condition holds nowhere; a null answer is wrong.
    """
    c, at = F.coalesce(F.col("correct").cast("double"), F.lit(0.0)), F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1))
    put = lambda when, what, name: F.sum(F.when(when, what).otherwise(0.0)).alias(name)
    gaps = [put(second & (at == k), c - F.col("conf"), f"gap{k}") for k in range(bins)]
    return top.groupBy(F.col(run).alias("run"), F.col(unit).alias("unit")).agg(put(first, F.lit(1.0), "n1"), put(first, c, "c1"), put(second, F.lit(1.0), "n2"), put(second, c, "c2"), *gaps)


#: Criteria over gate_values, each the better the larger: accuracy, calibration error and language gap.
CRITERIA = {
    "accuracy": "try_divide(c2, n2)",
    "ece": "-try_divide(" + " + ".join(f"abs(gap{k})" for k in range(10)) + ", n2)",
    "language_gap": "try_divide(c2, n2) - try_divide(c1, n1)",
}


def boot_leads(items: DataFrame, values: list[str], stats: dict[str, str], baselines: list, by: tuple[str, ...] = (), replicates: int = 1000, unit: str = "id", level: float = 0.95) -> DataFrame:
    """(by, run, baseline, metric, lead, low, high, verdict): how far each run is ahead of every baseline in every metric, with intervals that hold for all of a run's leads at once.

    stats: SQL over the weighted sums for each metric, the better the larger. A case has the same weight in every run, so leads
    are paired. In each replicate the largest distance of a lead from its mean, in standard deviations, is taken over all
    baselines and metrics of the run; every interval is as wide as that maximum's quantile at `level`. So a run that is no
    better than its baselines is called better in any of them with a chance of 1 - level at most, however many there are
    (approximately: as near as the bootstrap comes), where single intervals would err more with each comparison.

    The sums are worked out once; what follows are runs × baselines × metrics × replicates numbers, and one row gathers the
    runs of a replicate. A metric that is undefined (no items of a slice) has a null lead and verdict and widens nothing; one
    that never varies has the interval of its lead alone. Rows with a null run, and a family without a baseline, give none.
    """
    by, names = list(by), list(stats)
    each = F.struct("run", *[F.expr(x).cast("double").alias(f"m{i}") for i, x in enumerate(stats.values())])
    held = boot_sums(items, [*by, "run"], values, replicates, unit).groupBy(*by, "r").agg(F.collect_list(each).alias("__all"))
    known = lambda x: x["run"].isin(baselines)
    d = held.select(*by, "r", F.filter("__all", known).alias("__b"), F.explode(F.filter("__all", lambda x: ~known(x))).alias("__x"))
    d = d.select(*by, "r", "__x", F.explode("__b").alias("__y"))
    leads = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col("__x")[f"m{i}"] - F.col("__y")[f"m{i}"]).alias("lead")) for i, m in enumerate(names)])
    d = d.select(*by, "r", F.col("__x.run").alias("run"), F.col("__y.run").alias("baseline"), F.explode(leads).alias("__l")).select(*by, "r", "run", "baseline", "__l.*")
    w, drawn = W.partitionBy(*by, "run", "baseline", "metric"), F.when(F.col("r") > 0, F.col("lead"))
    d = d.withColumn("__mean", F.avg(drawn).over(w)).withColumn("__sd", F.stddev_pop(drawn).over(w))
    far = F.when((F.col("r") > 0) & (F.col("__sd") > 1e-9), F.abs(F.col("lead") - F.col("__mean")) / F.col("__sd"))
    whole = F.when(F.col("r") == 0, F.struct("baseline", "metric", "lead", F.when(F.col("__sd") > 1e-9, F.col("__sd")).otherwise(F.when(F.col("__sd").isNotNull(), 0.0)).alias("sd")))
    m = d.groupBy(*by, "run", "r").agg(F.max(far).alias("__far"), F.collect_list(whole).alias("__whole"))
    m = m.groupBy(*by, "run").agg(F.coalesce(F.percentile("__far", F.lit(level)), F.lit(0.0)).alias("__q"), F.flatten(F.collect_list("__whole")).alias("__whole"))
    m = m.select(*by, "run", "__q", F.explode("__whole").alias("__w")).select(*by, "run", "__w.*", (F.col("__q") * F.col("__w.sd")).alias("__half"))
    m = m.select(*by, "run", "baseline", "metric", *[F.round(x, 6).alias(n) for n, x in (("lead", F.col("lead")), ("low", F.col("lead") - F.col("__half")), ("high", F.col("lead") + F.col("__half")))])
    return m.withColumn("verdict", F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").when(F.col("low").isNotNull(), "tie"))


def gate_leads(leads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, run, metric, baselines, beaten, nearest, passed) of boot_leads: a criterion is met where a run is better than every baseline; nearest is the least lower end, null where a lead is undefined, which also fails."""
    n, beaten = F.count("*"), F.coalesce(F.sum((F.col("verdict") == "better").cast("long")), F.lit(0))
    d = leads.groupBy(*by, "run", "metric").agg(n.alias("baselines"), beaten.alias("beaten"), F.when(F.count("low") == n, F.min("low")).alias("nearest"))
    return d.withColumn("passed", F.col("beaten") == F.col("baselines"))


def slice_gap(top: DataFrame, by: list[str], first: Column, second: Column, name: str) -> DataFrame:
    """(by, gap): accuracy where `first` holds less that where `second` does."""
    c = F.col("correct").cast("double")
    return top.groupBy(*by).agg(F.round(F.avg(F.when(first, c)) - F.avg(F.when(second, c)), 6).alias(name))


def scenario_gap(top: DataFrame, options: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, intent, scenario, scenario_gap): accuracy over options, accuracy over the scenarios that the options belong to, and how far the first falls behind the second.

    top: (by, pred, gold) as option ids; options: (option_id, scenario), one row per option. A null or unlisted answer is wrong in both.
    """
    side = lambda name: options.select(F.col("option_id").alias(name), F.col("scenario").alias(f"__{name}"))
    d = top.join(side("pred"), "pred", "left").join(side("gold"), "gold", "left")
    share = lambda a, b: F.avg(F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("double"))
    i, s = share("pred", "gold"), share("__pred", "__gold")
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.round(i, 6).alias("intent"), F.round(s, 6).alias("scenario"), F.round(s - i, 6).alias("scenario_gap"))


def transfer_gap(top: DataFrame, by: list[str], held_out: Column, chance: Column) -> DataFrame:
    """(by, n_learned, n_held_out, learned, held_out, transfer_gap, templates_only): accuracy on learned tasks or templates and on those held out, and the first less the second.

    templates_only flags a classifier in disguise: above chance by over 1.96 standard errors where it has learned, not so where it hasn't.
    chance: what guessing gets in each row. A null condition counts as learned, a null `correct` as wrong; a side without rows has null figures and no flag.
    """
    out = F.coalesce(held_out, F.lit(False))
    d = top.select(*by, out.alias("__out"), F.coalesce(F.col("correct").cast("double"), F.lit(0.0)).alias("__c"), chance.alias("__chance"))
    on = lambda side, what: F.when(F.col("__out") == side, F.col(what))
    sides = [x for side, k in ((False, "i"), (True, "o")) for x in (F.count(on(side, "__c")).alias(f"__n{k}"), F.avg(on(side, "__c")).alias(f"__a{k}"), F.avg(on(side, "__chance")).alias(f"__e{k}"))]
    d = d.groupBy(*by).agg(*sides)
    above = lambda k: F.col(f"__a{k}") - F.col(f"__e{k}") > 1.96 * F.sqrt(F.col(f"__e{k}") * (1 - F.col(f"__e{k}")) / F.col(f"__n{k}"))
    figures = [F.round(x, 6).alias(n) for n, x in (("learned", F.col("__ai")), ("held_out", F.col("__ao")), ("transfer_gap", F.col("__ai") - F.col("__ao")))]
    return d.select(*by, F.col("__ni").alias("n_learned"), F.col("__no").alias("n_held_out"), *figures, (above("i") & ~above("o")).alias("templates_only"))


def mon_truncation(df: DataFrame, by: list[str], tokens: Column, most: int, cut: Column) -> DataFrame:
    """(by, n, at_max, answers_cut): share of records at the maximal length, and of answers cut off."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg((tokens >= most).cast("double")), 6).alias("at_max"), F.round(F.avg(cut.cast("double")), 6).alias("answers_cut"))


def mon_overconfident(top: DataFrame, by: list[str], least: float = 0.99) -> DataFrame:
    return top.groupBy(*by).agg(F.sum((~F.col("correct") & (F.col("conf") >= least)).cast("long")).alias("overconfident"))


def mon_translationese(by_slice: DataFrame, full: str, without: str) -> DataFrame:
    """(test_set, full, without, flag) on native tests: flag where the run without translated data is ahead."""
    d = by_slice.where(F.col("origin") == "native").groupBy("test_set").agg(F.max(F.when(F.col("run") == full, F.col("accuracy"))).alias("full"), F.max(F.when(F.col("run") == without, F.col("accuracy"))).alias("without"))
    return d.withColumn("flag", F.col("without") > F.col("full"))


def mon_too_good(metrics: DataFrame, baseline: str, margin: float) -> DataFrame:
    """(run, accuracy, baseline): runs more than the margin above the baseline run."""
    b = metrics.where(F.col("run") == baseline).select(F.col("accuracy").alias("baseline"))
    return metrics.crossJoin(F.broadcast(b)).where(F.col("accuracy") > F.col("baseline") + margin).select("run", "accuracy", "baseline")


def rpt_headline(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A row per run, a column per metric, from (run, metric, value)."""
    return metrics.groupBy("run").pivot("metric", names).agg(F.first("value"))


def rpt_language_gap(gaps: DataFrame) -> DataFrame:
    """(run, gap, place): the runs by their gap, smallest first."""
    return gaps.select("run", "gap", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("gap", "run")).alias("place"))
