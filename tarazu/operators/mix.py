"""The training mix: converters, options, negatives, lengths, shares, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarazu.functions.seeded import h32, unit
from tarazu.operators.records import one_hot, option_array
from tarazu.sources.shared import written

YES_NO = (("yes", "Yes"), ("no", "No"))


def labelled(df: DataFrame, kind: str, question: Column | str, options: Column, label: Column) -> DataFrame:
    """df with question_type, question_text, options and a one-hot gold."""
    q = F.lit(question) if isinstance(question, str) else question
    return df.withColumn("question_type", F.lit(kind)).withColumn("question_text", q).withColumn("options", options).withColumn("gold", one_hot(options, label))


def conv_intent(df: DataFrame, descriptions: DataFrame, label: str) -> DataFrame:
    """A label as a choice among all described labels, in order of their ids. The description table is small and becomes one array."""
    opts = descriptions.agg(F.sort_array(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), "text"))).alias("options"))
    out = df.crossJoin(F.broadcast(opts))
    return labelled(out, "choice", "Which intent is it?", F.col("options"), F.col(label).cast("string"))


def conv_entailment(df: DataFrame, label: str, as_noul: bool = False) -> DataFrame:
    """Three-way entailment, or whether it is entailed."""
    if as_noul:
        return labelled(df, "noul", "Does the second text follow from the first?", option_array(*YES_NO), F.when(F.col(label) == "entailment", "yes").otherwise("no"))
    return labelled(df, "choice", "How does the second text relate to the first?", option_array(("entailment", "follows"), ("neutral", "is open"), ("contradiction", "contradicts")), F.col(label))


def conv_answerable(df: DataFrame, flag: str) -> DataFrame:
    return labelled(df, "noul", "Does the passage answer the question?", option_array(*YES_NO), F.when(F.col(flag), "yes").otherwise("no"))


def conv_multichoice(df: DataFrame, choices: str, answer_ix: str) -> DataFrame:
    """An array of choices and the index of the right one."""
    opts = F.transform(F.col(choices), lambda c, i: F.struct(i.cast("string").alias("id"), c.alias("text")))
    return labelled(df, "choice", "Which answer is right?", opts, F.col(answer_ix).cast("string"))


def conv_paraphrase(df: DataFrame, same: str) -> DataFrame:
    return labelled(df, "noul", "Do both texts say the same?", option_array(*YES_NO), F.when(F.col(same), "yes").otherwise("no"))


def conv_sentiment(df: DataFrame, level: str, levels: int = 5) -> DataFrame:
    """A level from 1 up as a score question."""
    return labelled(df, "score", "How positive is the text?", option_array(*[(str(k), str(k)) for k in range(1, levels + 1)]), F.col(level).cast("string"))


#: Private data in transcripts and what stands for it. Fixed values, applied in order.
#: An address is tried at the start of a run of its characters only, so work is linear in the text.
PRIVATE = ((r"(?<![\w.+-])[\w.+-]++@[\w-]++\.[\w.]++", "<email>"), (r"\+\d[\d ().-]{6,}\d", "<phone>"), (r"\d{6,}", "<number>"))


def scrub(c: Column) -> Column:
    for pattern, name in PRIVATE:
        c = F.regexp_replace(c, pattern, name)
    return c


def conv_transcript(df: DataFrame, text: str, label: str, descriptions: DataFrame) -> DataFrame:
    """Transcripts as a choice of intents, with private data replaced."""
    return conv_intent(df.withColumn(text, scrub(F.col(text))), descriptions, label)


def neg_wrong_passage(qa: DataFrame, seed: int = 0, shift: int = 1, group_rows: int = 1024) -> DataFrame:
    """(id, question, from_id, passage): each question with the passage of another question, left out where that passage holds the answer.

    Ids alone are numbered by a seeded hash within hash groups of about `group_rows`, and each group is rotated;
    then the passages are fetched. A group of one row gives no negative.
    """
    r = in_groups(qa.select("id"), seed, group_rows)
    order = W.partitionBy("grp").orderBy(h32(F.lit(seed), F.col("id")), "id")
    r = r.withColumn("r", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(W.partitionBy("grp")))
    pairs = r.select("id", "grp", ((F.col("r") + shift) % F.col("n")).alias("to")).join(r.select("grp", F.col("r").alias("to"), F.col("id").alias("from_id")), ["grp", "to"]).where("from_id <> id")
    q = pairs.select("id", "from_id").join(qa.select("id", "question", "answer"), "id")
    return q.join(qa.select(F.col("id").alias("from_id"), "passage"), "from_id").where("not contains(passage, answer)").select("id", "question", "from_id", "passage")


def in_groups(ids: DataFrame, seed: int, group_rows: int) -> DataFrame:
    """ids (id) with grp, a seeded hash into as many groups as keep about `group_rows` in each."""
    return ids.withColumn("grp", h32(F.lit("g"), F.lit(seed), F.col("id")) % max(1, ids.count() // group_rows))


def truncate_keep_answer(passage: Column, answer: Column, budget: int) -> Column:
    """At most `budget` characters of the passage around the first place of the answer; its start if it has none."""
    at, size, room = F.position(answer, passage), F.length(answer), F.lit(budget)
    start = F.greatest(F.lit(1), F.least(at - ((room - size) / 2).cast("int"), F.length(passage) - room + 1))
    return F.substr(passage, F.when(at > 0, start).otherwise(F.lit(1)), room)


def template_assign(df: DataFrame, templates: DataFrame, seed: int = 0) -> DataFrame:
    """df with a template_id of its task: the seeded hash modulo the number of templates that aren't held out; null for a task without one."""
    usable = templates.where("not held_out").groupBy("task").agg(F.sort_array(F.collect_list("template_id")).alias("__t"))
    out = df.join(usable, "task", "left")
    return out.withColumn("template_id", F.try_element_at("__t", (h32(F.lit(seed), F.col("id")) % F.size("__t")).cast("int") + 1)).drop("__t")


def template_holdout(templates: DataFrame, k: int = 2, seed: int = 0) -> DataFrame:
    """templates with held_out: the k of each task with the least seeded hash are for tests only."""
    order = W.partitionBy("task").orderBy(h32(F.lit(seed), F.col("template_id")), "template_id")
    return templates.withColumn("held_out", F.row_number().over(order) <= k)


def opt_shuffle(records: DataFrame, seed: int = 0) -> DataFrame:
    """Options in a seeded order; gold is a map by option id and stays right."""
    tagged = F.transform("options", lambda o: F.struct(h32(F.lit(seed), F.col("id"), o["id"]).alias("h"), o["id"].alias("id"), o.alias("o")))
    return records.withColumn("options", F.transform(F.array_sort(tagged), lambda x: x["o"]))


def opt_rename(records: DataFrame, share: float = 0.3, seed: int = 0, prefix: str = "opt_") -> DataFrame:
    """A seeded share of records gets new option ids by place; gold follows."""
    hit = unit(F.lit(seed), F.col("id")) < share
    names = F.map_from_arrays(F.transform("options", lambda o: o["id"]), F.transform("options", lambda o, i: F.concat(F.lit(prefix), (i + 1).cast("string"))))
    out = records.withColumn("__names", names).withColumn("__hit", hit)
    gold = F.transform_keys("gold", lambda k, v: F.element_at("__names", k))
    opts = F.transform("options", lambda o: F.struct(F.element_at("__names", o["id"]).alias("id"), o["text"].alias("text")))
    return out.withColumn("gold", F.when(F.col("__hit"), gold).otherwise(F.col("gold"))).withColumn("options", F.when(F.col("__hit"), opts).otherwise(F.col("options"))).drop("__names", "__hit")


def opt_none_of_these(records: DataFrame, share: float = 0.2, drop_share: float = 0.5, seed: int = 0) -> DataFrame:
    """A seeded share of records gets the option `none`; a share of those loses its best option, whose probability goes to `none`."""
    add, drop = unit(F.lit(seed), F.lit("add"), F.col("id")) < share, unit(F.lit(seed), F.lit("drop"), F.col("id")) < drop_share
    best = F.element_at(F.transform(F.array_sort(F.transform("options", lambda o, i: F.struct((-F.element_at("gold", o["id"])).alias("p"), i.alias("i"), o["id"].alias("id")))), lambda x: x["id"]), 1)
    out = records.withColumn("__add", add).withColumn("__drop", add & drop).withColumn("__best", best)
    none = F.array(F.struct(F.lit("none").alias("id"), F.lit("None of these").alias("text")))
    left = F.filter("options", lambda o: ~(F.col("__drop") & (o["id"] == F.col("__best"))))
    opts = F.when(F.col("__add"), F.concat(left, none)).otherwise(F.col("options"))
    out = out.withColumn("__mass", F.when(F.col("__drop"), F.element_at("gold", F.col("__best"))).otherwise(0.0)).withColumn("options", opts)
    ids = F.transform("options", lambda o: o["id"])
    gold = F.map_from_arrays(ids, F.transform(ids, lambda i: F.when(i == "none", F.col("__mass")).otherwise(F.try_element_at("gold", i))))
    return out.withColumn("gold", F.when(F.col("__add"), gold).otherwise(F.col("gold"))).drop("__add", "__drop", "__best", "__mass")


def _first_options(long: DataFrame, n: int, seed: int) -> DataFrame:
    order = W.partitionBy("id").orderBy(F.desc(F.col("g") > 0), h32(F.lit(seed), F.col("id"), F.col("option_id")), "idx")
    # dealt by question first: otherwise Spark sorts all that a task has before it is dealt, to drop what is over n early, and hardly any is
    return long.repartition("id").withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= n).drop("rk")


def opt_sample_negatives(long: DataFrame, over: int = 8, wrong: int = 7, seed: int = 0) -> DataFrame:
    """Long form: questions with more than `over` options keep those with gold and `wrong` seeded others."""
    sized = long.withColumn("n", F.count("*").over(W.partitionBy("id"))).withColumn("golds", F.sum((F.col("g") > 0).cast("int")).over(W.partitionBy("id")))
    order = W.partitionBy("id").orderBy(F.desc(F.col("g") > 0), h32(F.lit(seed), F.col("id"), F.col("option_id")), "idx")
    return sized.withColumn("rk", F.row_number().over(order)).where((F.col("n") <= over) | (F.col("rk") <= F.col("golds") + wrong)).drop("n", "golds", "rk")


def opt_cap(long: DataFrame, most: int = 20, seed: int = 0) -> DataFrame:
    """Long form: at most `most` options of a question, those with gold first."""
    return _first_options(long, most, seed)


def lang_slice(records: DataFrame, lang: str = "en") -> DataFrame:
    """Records in the language, and those of another language with the question put in it."""
    same = records.where(F.col("state_lang") == lang).withColumn("slice", F.lit("same"))
    ask = records.where(F.col("state_lang") == lang).select("source_id", "question_type", F.col("question_text").alias("__q")).distinct()
    cross = records.where(F.col("state_lang") != lang).join(ask, ["source_id", "question_type"])
    cross = cross.withColumn("question_text", F.col("__q")).withColumn("question_lang", F.lit(lang)).withColumn("slice", F.lit("cross")).drop("__q")
    return same.unionByName(cross.select(*same.columns))


def token_length(text: Column) -> Column:
    """Default length: words between white space. Pass a pandas_udf of a tokenizer instead where one is at hand."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def len_profile(df: DataFrame, text: str, by: list[str], length=token_length) -> DataFrame:
    """Quantiles of the length by group."""
    p = lambda q: F.percentile("__n", F.lit(q)).cast("double")
    return df.withColumn("__n", length(F.col(text))).groupBy(*by).agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max("__n").alias("longest"))


def len_cap(df: DataFrame, text: str, most: int, truncate: bool = True) -> DataFrame:
    """Texts over `most` words cut behind that word (over = true), or dropped."""
    n = token_length(F.col(text))
    if not truncate:
        return df.where(n <= most).withColumn("over", F.lit(False))
    cut = F.array_join(F.slice(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""), 1, most), " ")
    return df.withColumn("over", n > most).withColumn(text, F.when(n > most, cut).otherwise(F.col(text)))


def share_caps(counts: DataFrame, share: float = 0.3, source: str = "source") -> DataFrame:
    """(source, n, cap) from (source, n): with j sources capped the total is the rest over (1 - j share); the least j that leaves no other source above its share.

    Raises where that is impossible: fewer than 1/share sources.
    """
    one = W.partitionBy(F.lit(0)).orderBy(F.desc("n"), source)  # one row per source
    c = counts.withColumn("j", F.row_number().over(one) - 1).withColumn("above", F.coalesce(F.sum("n").over(one.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("total", (F.sum("n").over(W.partitionBy(F.lit(0))) - F.col("above")) / F.when(1 - F.col("j") * share > 1e-9, 1 - F.col("j") * share))
    fits = F.col("total").isNotNull() & (F.col("n") <= F.lit(share) * F.col("total"))
    total = F.min_by("total", F.when(fits, F.col("j"))).over(W.partitionBy(F.lit(0)))
    c = c.withColumn("cap", F.floor(F.lit(share) * total)).withColumn("cap", F.when(F.col("cap").isNull(), F.raise_error(F.lit("too few sources for the share"))).otherwise(F.least("n", "cap")))
    return c.select(source, "n", F.col("cap").cast("long").alias("cap"))


def _bucketed(df: DataFrame, seed: int, source: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """df with its rows' seeded hash and one of 4096 buckets of it, and the rows of each source and bucket."""
    d = df.withColumn("__h", h32(F.lit(seed), F.col(id_col))).withColumn("__b", (F.col("__h") / F.lit(1 << 20)).cast("int"))
    return d, d.groupBy(source, "__b").agg(F.count("*").alias("__m"))


def _ranked(d: DataFrame, buckets: DataFrame, per_source: DataFrame, source: str, id_col: str, *columns: str) -> DataFrame:
    """d with per_source's columns and __rn, the row's rank in its source: that within its bucket plus the rows of lower buckets, so that many tasks rank a source with a third of all rows."""
    below = buckets.withColumn("__below", F.coalesce(F.sum("__m").over(W.partitionBy(source).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    known = below.join(per_source.select(F.col(source).alias("__s"), *columns), F.col(source).eqNullSafe(F.col("__s"))).select("__s", F.col("__b").alias("__kb"), "__below", *columns)
    return d.join(known, F.col(source).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__kb"))).withColumn("__rn", F.row_number().over(W.partitionBy(source, "__b").orderBy("__h", id_col)) + F.col("__below"))


def mix_cap_share(df: DataFrame, share: float = 0.3, seed: int = 0, source: str = "source", id_col: str = "id") -> DataFrame:
    """No source above the share (a null source is one too): each source keeps its rows with the least seeded hashes."""
    d, buckets = _bucketed(df, seed, source, id_col)
    caps = share_caps(buckets.groupBy(source).agg(F.sum("__m").alias("n")), share, source)
    return _ranked(d, buckets, caps, source, id_col, "cap").where("__rn <= cap").select(*df.columns)


def mix_upsample(df: DataFrame, floor: int, source: str = "source") -> DataFrame:
    """Rows of sources under `floor` rows repeated whole times until it is reached (copy: 1 up). A null source is one too."""
    n = df.groupBy(F.col(source).alias("__s")).agg(F.count("*").alias("__n"))
    out = df.join(n, F.col(source).eqNullSafe(F.col("__s")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.lit(floor) / F.greatest(F.col("__n"), F.lit(1))).cast("int")))).drop("__n", "__s")


def balance_plan(counts: DataFrame, share: float = 0.3, floor: int = 1, least: int = 0, most: int | None = None, source: str = "source", ways: int = 32) -> DataFrame:
    """(source, n, target) from (source, n): how many rows of each source make a mix that holds every bound at once. No source above `share` of the whole, none below `floor`, the whole between `least` and `most`.

    A source counts as greatest(n, floor) rows and gets at most a common level, the highest that the share and `most` allow:
    the whole is sum(least(rows, level)), which grows with the level but slower than it, so both bounds hold up to one
    level and none above. Each pass sums at `ways` levels, and the driver sees these sums alone. A ValueError names the
    bound that nothing can meet. A null source is one too; sources without rows get none; the whole may stay below `most` by less than one row a source.
    """
    if floor < 1:
        raise ValueError("floor: at least 1")
    c = written(counts.where("n > 0").select(source, F.col("n").cast("long").alias("n"), F.greatest(F.col("n"), F.lit(floor)).cast("long").alias("__w")), "sources")
    top = c.agg(F.count("*").alias("k"), F.max("__w").alias("w")).first()
    if not top.k:
        return c.select(source, "n", F.lit(0).cast("long").alias("target"))
    fits = lambda level, whole: level <= share * whole + 1e-9 and (most is None or whole <= most)
    if top.k * floor > share * top.k * top.k * floor + 1e-9:
        raise ValueError(f"share: {top.k} sources can't each be at most {share} of the whole")
    if most is not None and top.k * floor > most:
        raise ValueError(f"most: {top.k} sources of at least {floor} rows are over {most}")
    level, whole, above = floor, top.k * floor, top.w + 1
    while above - level > 1:
        tried = sorted({level + max(1, (above - level) * i // ways) for i in range(1, ways)} - {above})
        sums = c.agg(*[F.sum(F.least("__w", F.lit(t))).alias(f"s{i}") for i, t in enumerate(tried)]).first()
        good = [(t, x) for t, x in zip(tried, sums) if fits(t, x)]
        bad = [t for t, x in zip(tried, sums) if not fits(t, x)]
        (level, whole), above = good[-1] if good else (level, whole), bad[0] if bad else above
    if whole < least:
        raise ValueError(f"least: the whole is {whole} rows at most, under {least}")
    return c.select(source, "n", F.least("__w", F.lit(level)).cast("long").alias("target"))


def mix_balance(df: DataFrame, share: float = 0.3, floor: int = 1, least: int = 0, most: int | None = None, seed: int = 0, source: str = "source", id_col: str = "id") -> DataFrame:
    """df with copy (1 up): each source's rows as often as balance_plan says, all of them equally often but for those with the least seeded hashes, which come once more. Ranks are taken in buckets, as in mix_cap_share."""
    d, buckets = _bucketed(df, seed, source, id_col)
    plan = balance_plan(buckets.groupBy(source).agg(F.sum("__m").alias("n")), share, floor, least, most, source)
    ranked = _ranked(d, buckets, plan.select(source, F.col("n").alias("__n"), F.col("target").alias("__target")), source, id_col, "__n", "__target")
    times = F.floor(F.col("__target") / F.col("__n")).cast("int") + (F.col("__rn") <= F.col("__target") % F.col("__n")).cast("int")
    return ranked.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).select(*df.columns, "copy")


def mix_ablate(df: DataFrame, without: str) -> DataFrame:
    """The mix without an origin, or without a language of states or questions."""
    gone = F.coalesce(F.col("origin") == without, F.lit(False)) | F.coalesce(F.col("state_lang") == without, F.lit(False)) | F.coalesce(F.col("question_lang") == without, F.lit(False))
    return df.where(~gone)


def mix_size_gate(df: DataFrame, least: int = 30_000, most: int = 60_000, share: float = 0.3) -> DataFrame:
    """(source, n, share, share_ok, total, total_ok)."""
    c = df.groupBy("source").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(W.partitionBy(F.lit(0))))
    return c.select("source", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("n") <= share * F.col("total")).alias("share_ok"), "total", F.col("total").between(least, most).alias("total_ok"))


def fmt_encoder(records: DataFrame) -> DataFrame:
    """(id, idx, input, g): one input per option."""
    out = records.select("id", "state", "question_text", "gold", F.posexplode("options").alias("idx", "o"))
    text = F.concat_ws("\n", F.coalesce("state", F.lit("")), F.coalesce("question_text", F.lit("")), F.col("o.text"))
    return out.select("id", "idx", text.alias("input"), F.coalesce(F.try_element_at("gold", "o.id"), F.lit(0.0)).alias("g"))


def fmt_decoder(records: DataFrame) -> DataFrame:
    """(id, prompt, answer): one prompt with lettered options and the letter of the best."""
    lines = F.array_join(F.transform("options", lambda o, i: F.concat(F.char(i + 65), F.lit(") "), o["text"])), "\n")
    rank = F.array_sort(F.transform("options", lambda o, i: F.struct((-F.element_at("gold", o["id"])).alias("p"), i.alias("i"))))
    prompt = F.concat_ws("\n", F.coalesce("state", F.lit("")), F.coalesce("question_text", F.lit("")), lines, F.lit("Answer:"))
    return records.select("id", prompt.alias("prompt"), F.char(F.element_at(rank, 1)["i"] + 65).alias("answer"))
