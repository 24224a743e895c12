"""Code-labelled items: every label is a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarazu.functions.seeded import h32
from tarazu.functions.text import ARABIC, LATIN, PERSIAN, fold_digits
from tarazu.operators.prep import sample_balanced

#: The leap years of the 33-year cycle, a start of a cycle's year 1 in Gregorian days, weekdays from Saturday.
LEAP = (1, 5, 9, 13, 17, 22, 26, 30)
WEEKDAYS = ("شنبه", "یکشنبه", "دوشنبه", "سه‌شنبه", "چهارشنبه", "پنجشنبه", "جمعه")


def jalali_dim(spark, first: int = 1300, last: int = 1450) -> DataFrame:
    """(jdate, jy, jm, jd, gdate, weekday 1 to 7 from Saturday): the Jalali calendar by the 33-year leap rule, 1399-01-01 being 2020-03-20.

    Year lengths are summed from the anchor in closed form, so every row stands for itself.
    """
    y = spark.range(first, last + 1).select(F.col("id").cast("int").alias("jy"))
    d = y.select("jy", F.explode(F.sequence(F.lit(0), F.lit(364) + is_leap(F.col("jy")).cast("int"))).alias("n"))
    jm = F.when(F.col("n") < 186, (F.col("n") / 31).cast("int") + 1).otherwise(((F.col("n") - 186) / 30).cast("int") + 7)
    jd = F.when(F.col("n") < 186, F.col("n") % 31 + 1).otherwise((F.col("n") - 186) % 30 + 1)
    g = F.date_add(F.lit("2020-03-20").cast("date"), (year_start(F.col("jy")) - year_start(F.lit(1399)) + F.col("n")).cast("int"))
    text = F.concat(F.lpad("jy", 4, "0"), F.lit("/"), F.lpad(jm.cast("string"), 2, "0"), F.lit("/"), F.lpad(jd.cast("string"), 2, "0"))
    return d.select(text.alias("jdate"), "jy", jm.alias("jm"), jd.alias("jd"), g.alias("gdate"), weekday(g).alias("weekday"))


def is_leap(y: Column) -> Column:
    return (y % 33).isin(*LEAP)


def year_start(y: Column) -> Column:
    """Days from the start of year 0 to that of year y: 365 a year and one for each leap year before."""
    r = y % 33
    leaps = sum((r > k).cast("long") for k in LEAP)
    return y.cast("long") * 365 + F.floor(y / 33) * len(LEAP) + leaps


def weekday(g: Column) -> Column:
    """1 Saturday to 7 Friday."""
    return F.dayofweek(g) % 7 + 1


def compare_dates(pairs: DataFrame, a: str, b: str, dim: DataFrame) -> DataFrame:
    """Pairs of Gregorian dates as the Jalali question whether the first is before the second; a pair with a date outside the calendar stays, its question null."""
    one = dim.select(F.col("gdate").alias(a), F.col("jdate").alias("ja"))
    two = dim.select(F.col("gdate").alias(b), F.col("jdate").alias("jb"))
    out = pairs.join(F.broadcast(one), a, "left").join(F.broadcast(two), b, "left")
    return out.withColumn("question", F.concat(F.lit("آیا "), "ja", F.lit(" پیش از "), "jb", F.lit(" است؟"))).withColumn("label", F.when(F.col(a) < F.col(b), "yes").otherwise("no"))


def weekday_items(dates: DataFrame, g: str, dim: DataFrame) -> DataFrame:
    """Gregorian dates as the question which weekday a Jalali date is; label: the option's number. A date outside the calendar stays, with nulls."""
    return dates.join(F.broadcast(dim.select(F.col("gdate").alias(g), "jdate", "weekday")), g, "left").withColumn("label", F.col("weekday").cast("string"))


def digit_forms(df: DataFrame, amount: str, other: str) -> DataFrame:
    """(…, persian, arabic, same): an amount in two digit systems, the second that of `other`; same: whether they are equal once folded."""
    text = lambda c: F.col(c).cast("string")
    out = df.withColumn("persian", F.translate(text(amount), LATIN, PERSIAN)).withColumn("arabic", F.translate(text(other), LATIN, ARABIC))
    return out.withColumn("same", fold_digits(F.col("persian")) == fold_digits(F.col("arabic")))


def toman_rial(df: DataFrame, rial: str, toman: str) -> DataFrame:
    """(…, more, choice): whether the Rial amount is above the Toman amount (10 Rial each), and which is larger."""
    tomans = F.col(toman).cast("bigint") * 10
    larger = F.when(F.col(rial) > tomans, "rial").when(F.col(rial) < tomans, "toman").otherwise("equal")
    return df.withColumn("more", F.when(F.col(rial) > tomans, "yes").otherwise("no")).withColumn("choice", larger)


def business_hours(times: DataFrame, ts: str, hours: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, day, minute, open): whether the shop is open; hours is (day, from_min, to_min), to_min at or below from_min meaning past midnight."""
    t = times.select(id_col, weekday(F.col(ts)).alias("day"), (F.hour(ts) * 60 + F.minute(ts)).alias("minute"))
    same = hours.select("day", "from_min", F.when(F.col("to_min") > F.col("from_min"), F.col("to_min")).otherwise(1440).alias("to_min"))
    late = hours.where("to_min <= from_min").select((F.col("day") % 7 + 1).alias("day"), F.lit(0).alias("from_min"), "to_min")
    spans = same.unionByName(late).withColumnRenamed("day", "__day")
    hit = t.join(spans, (t.day == spans["__day"]) & (t.minute >= spans["from_min"]) & (t.minute < spans["to_min"]), "left")
    return hit.groupBy(id_col, "day", "minute").agg(F.when(F.count("__day") > 0, "yes").otherwise("no").alias("open"))


def mobile_valid(c: Column) -> Column:
    return fold_digits(c).rlike(r"^(\+98|0098|0)9[0-9]{9}$")


def postal_valid(c: Column) -> Column:
    return fold_digits(c).rlike(r"^[0-9]{10}$")


def template_expand(facts: DataFrame, templates: DataFrame, slots: dict[str, str]) -> DataFrame:
    """facts × the templates of their task, with each {slot} replaced by a column. Spark broadcasts the templates if it finds them small."""
    out = facts.join(templates, "task")
    text = F.col("pattern")
    for slot, column in slots.items():
        text = F.replace(text, F.lit("{" + slot + "}"), F.col(column).cast("string"))
    return out.withColumn("question_text", text)


def gen_mix(parts: list[DataFrame], target: int, seed: int, by: str = "generator") -> DataFrame:
    """All generators' items, each capped to its equal share of the target."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return sample_balanced(out, [by], target // len(parts), seed)


def gen_reproduce(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (only_a, only_b): rows that two builds don't share, counted with repetition."""
    one = a.exceptAll(b).agg(F.count("*").alias("only_a"))
    return one.crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_b")))


def pick(c: Column, n: int, seed: str) -> Column:
    return h32(F.lit(seed), c) % n
