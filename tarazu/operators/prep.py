"""Preparation: samples, overlaps, field rules, glossary; splits and leakage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarazu.functions.seeded import h32
from tarazu.functions.text import fold_digits, text_key, words
from tarazu.operators.records import ranked
from tarazu.sources.shared import written


def sample_balanced(df: DataFrame, by: list[str], n: int, seed: int, id_col: str = "id") -> DataFrame:
    """The n rows of each stratum with the least seeded hash.

    Rows are counted by stratum and 2^16 ranges of the hash first; only ranges that start within the n least are sorted, so no task
    sorts all its rows. A null stratum is one too.
    """
    d = df.withColumn("__h", h32(F.lit(seed), F.col(id_col))).withColumn("__b", F.shiftright("__h", 16))
    counts = d.groupBy(*by, "__b").agg(F.count("*").alias("__m"))
    before = F.sum("__m").over(W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    low = counts.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") < n).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__b").alias("__low"))
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)]
    few = d.join(low, [*on, F.col("__b") == F.col("__low")], "left_semi")
    return ranked(few, by, [F.col("__h"), F.col(id_col)], "__rn").where(F.col("__rn") <= n).select(*df.columns)


def sample_fixed(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """The n rows with the least seeded hash: a top-k, never a full sort."""
    return df.orderBy(h32(F.lit(seed), F.col(id_col)), F.col(id_col)).limit(n)


def overlap_check(a: DataFrame, b: DataFrame, text: str = "state") -> DataFrame:
    """Rows of a whose normalised text is in b's test split."""
    keys = b.where("split = 'test'").select(text_key(F.col(text)).alias("__k"))
    return a.withColumn("__k", text_key(F.col(text))).join(keys, "__k", "left_semi").drop("__k")


#: Text that must stay as it is, by kind. Fixed values.
KEEP = {"email": r"^[\w.+-]+@[\w-]+\.[\w.]+$", "url": r"^https?://\S+$", "log": r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d", "code": r"[{};]\s*$|^\s*(def|class|import|return)\b", "number": r"^[#A-Z-]*\d[\d,.-]*$"}


def field_class(value: Column) -> Column:
    """The first kind of KEEP that the value is, or `text`."""
    out = None
    for kind, pattern in KEEP.items():
        out = F.when(value.rlike(pattern), F.lit(kind)) if out is None else out.when(value.rlike(pattern), F.lit(kind))
    return out.otherwise(F.lit("text"))


def field_rules(df: DataFrame, fields: list[str], rules: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, field, value, class, action): every field as a row; `keep` by a rule of its name or by what it looks like, else `translate`."""
    long = df.select(id_col, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([id_col], fields, "field", "value")
    long = long.withColumn("class", field_class(F.coalesce("value", F.lit("")))).join(rules.select("field", "action"), "field", "left")
    return long.select(id_col, "field", "value", "class", F.coalesce("action", F.when(F.col("class") == "text", "translate").otherwise("keep")).alias("action"))


def register_rule(fields: DataFrame, rules: DataFrame, default: str = "formal") -> DataFrame:
    """The fields with their register, by kind of field."""
    return fields.join(rules.select("field", "register"), "field", "left").withColumn("register", F.coalesce("register", F.lit(default)))


#: Money, dates and thresholds in text. Fixed values.
NUMERIC = r"[$€£]\s?\d|\d{4}-\d\d-\d\d|\d+\s?%|(?:over|under|above|below|more than|less than|at least)\s+\d"


def flag_numeric_cases(records: DataFrame, text: str = "state") -> DataFrame:
    """(source_id, numeric): whether any record of a case names money, dates or a threshold."""
    return records.groupBy("source_id").agg(F.bool_or(fold_digits(F.coalesce(F.col(text), F.lit(""))).rlike(NUMERIC)).alias("numeric"))


def phrase(c: Column) -> Column:
    """A term as its words with single spaces, as words() makes them of texts."""
    return F.array_join(words(c), " ")


def glossary_hits(df: DataFrame, glossary: DataFrame, text: str, by: list[str]) -> DataFrame:
    """(the columns of `by`, terms): each row's glossary terms in the order of the text, phrases of any number of words, leftmost first and of these the longest, none over another.

    A text's word runs of the lengths that the glossary has are joined with its terms; only places that match leave the
    join, and a row's places are walked once. Lengths are distinct word counts of a curated list; texts don't move but as runs of words.
    """
    terms = glossary.select(phrase(F.col("en_term")).alias("run"), "en_term").where("run <> ''").groupBy("run").agg(F.min("en_term").alias("en_term"))
    lengths = sorted(r.n for r in terms.select(F.size(F.split("run", " ")).alias("n")).distinct().collect())

    def runs_of(w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.struct(k.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(w, k, n), " ").alias("run")))

    if not lengths:
        return df.select(*by, F.array().cast("array<string>").alias("terms")).limit(0)
    d = df.select(F.monotonically_increasing_id().alias("row"), *by, F.element_at(F.transform(F.array(words(F.col(text))), lambda w: F.flatten(F.array(*[runs_of(w, n) for n in lengths]))), 1).alias("runs"))
    found = d.select("row", *by, F.explode("runs").alias("x")).select("row", *by, "x.*").join(terms, "run")
    placed = found.groupBy("row", *by).agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("n"), "en_term"))).alias("places"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("terms"))
    walked = F.aggregate("places", start, lambda acc, p: F.when(p["at"] <= acc["end"], acc).otherwise(F.struct((p["at"] - p["n"] - 1).alias("end"), F.concat(acc["terms"], F.array(p["en_term"])).alias("terms"))), lambda acc: acc["terms"])
    return placed.select(*by, walked.alias("terms"))


def glossary_terms(df: DataFrame, glossary: DataFrame, text: str = "state", id_col: str = "id") -> DataFrame:
    """(id, en_term, n): glossary terms, of one word or more, and how often each occurs in a record; where terms overlap the leftmost and longest counts."""
    hits = glossary_hits(df, glossary, text, [id_col])
    return hits.select(id_col, F.explode("terms").alias("en_term")).groupBy(id_col, "en_term").agg(F.count("*").alias("n"))


def split_by_source(df: DataFrame, seed: int = 0, key: str = "source_id") -> DataFrame:
    """80/8/4/8 train/validation/calibration/test by a hash of the case, so a case is on one side in every language."""
    b = h32(F.lit(seed), F.col(key)) % 100
    return df.withColumn("split", F.when(b < 80, "train").when(b < 88, "validation").when(b < 92, "calibration").otherwise("test"))


def split_integrity(df: DataFrame) -> DataFrame:
    """(source_id, splits): cases on more than one side."""
    return df.groupBy("source_id").agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def leak_exact(train: DataFrame, test: DataFrame, text: str = "state") -> DataFrame:
    """Train rows that share a test row's text, or its case in any language.

    Rows are judged by their text and case alone, never by an id, so null and repeated ids report no other row and lose none; a null case is nobody's.
    """
    by_text = test.select(text_key(F.col(text)).alias("__k"), F.lit(True).alias("__same")).distinct()
    by_case = test.where("source_id is not null").select("source_id", F.lit(True).alias("__case")).distinct()
    t = train.withColumn("__k", text_key(F.col(text))).join(by_text, "__k", "left").join(by_case, "source_id", "left")
    return t.where("__same or __case").select(*train.columns)


def shingle_array(text: Column, n: int = 5) -> Column:
    """The distinct word n-grams of a text as 60-bit hashes, made within the row; a text of fewer words has its whole word sequence as one, apart from all n-grams; none without a word."""
    number = lambda g: F.conv(F.substring(F.md5(g), 1, 15), 16, 10).cast("bigint")
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
    grams = lambda w: F.transform(starts(w), lambda k: number(F.array_join(F.slice(w, k, n), " ")))
    few = lambda w: F.array(number(F.concat(F.lit(" "), F.array_join(w, " "))))
    made = F.transform(F.array(words(text)), lambda w: F.when(F.size(w) >= n, grams(w)).when(F.size(w) > 0, few(w)).otherwise(F.array().cast("array<bigint>")))
    return F.array_distinct(F.element_at(made, 1))


def set_name(s: Column) -> Column:
    """A name that only equal sets of shingles share: MD5 of them in order."""
    return F.md5(F.array_join(F.array_sort(s), ","))


def shingles(df: DataFrame, id_col: str, text: str, n: int = 5) -> DataFrame:
    """(id, set, size, sh): a row for each distinct shingle of a text, with the set's name and their number."""
    d = df.select(F.col(id_col).alias("id"), shingle_array(F.col(text), n).alias("s"))
    d = d.select("id", set_name(F.col("s")).alias("set"), F.size("s").alias("size"), "s")  # apart from the explosion, which would name the set once for each row
    # the outer form, as the plain one infers a filter that makes all shingles a second time
    return d.select("id", "set", "size", F.explode_outer("s").alias("sh")).where("sh is not null")


def leak_near_dup(train: DataFrame, test: DataFrame, text: str = "state", n: int = 5, jaccard: float = 0.8, containment: float = 0.5, id_col: str = "id") -> DataFrame:
    """(test_id, train_id, shared, jaccard, containment): exact set similarities across the splits, one row per pair at or over a threshold.

    A pair at a threshold shares at least a part of the test text's shingles, so it shares one of the rarest of them, as
    many as are left without that part and one more: only these are joined to find pairs, and what all texts have finds
    none. Train shingles that no test text has are dropped first. Texts under n words pair where their whole word sequences are equal.

    Each side is read once: the test side's shingles and what train texts share with them are written. Pairs are those of
    sets, whose texts' ids follow at the end, so repeated rows count once and null ids are reported.
    """
    b = written(shingles(test, id_col, text, n).select(F.col("id").alias("test_id"), F.col("set").alias("test_set"), F.col("size").alias("nb"), "sh"), "test-shingles")
    a = shingles(train, id_col, text, n).join(b.select("sh").distinct(), "sh", "left_semi")
    a = written(a.select(F.col("id").alias("train_id"), F.col("set").alias("train_set"), F.col("size").alias("na"), "sh"), "shared-shingles")
    tests, trains = b.select("test_id", "test_set").distinct(), a.select("train_id", "train_set").distinct()
    b, a = b.select("test_set", "nb", "sh").distinct(), a.select("train_set", "na", "sh").distinct()
    times = a.groupBy("sh").agg(F.count("*").alias("times"))
    rare = W.partitionBy("test_set").orderBy(F.coalesce("times", F.lit(0)), "sh")
    least = F.ceil(F.lit(min(jaccard, containment)) * F.col("nb") - 1e-9)
    first = b.join(times, "sh", "left").withColumn("k", F.row_number().over(rare)).where(F.col("k") <= F.col("nb") - least + 1)
    found = first.join(a, "sh").select("test_set", "train_set").distinct()
    pairs = found.join(b, "test_set").join(a, ["train_set", "sh"]).groupBy("test_set", "train_set").agg(F.count("*").alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    pairs = pairs.withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).withColumn("containment", F.col("shared") / F.col("nb"))
    pairs = pairs.where((F.col("jaccard") >= jaccard) | (F.col("containment") >= containment))
    return pairs.join(tests, "test_set").join(trains, "train_set").select("test_id", "train_id", "shared", "jaccard", "containment")


def minhash_udf(hashes: int):
    """The least of each of so many hashes over a set of 60-bit shingle hashes; hash k is an affine map of them modulo a prime."""
    p, k = 2147483647, np.arange(hashes, dtype=np.int64)
    times, plus = (k * 1103515245 + 12345) % (1 << 30) + 1, k * 97531 + 7

    @F.arrow_udf("array<long>")
    def of(sets: pa.Array) -> pa.Array:
        least = np.full((len(sets), hashes), p, np.int64)
        for i, s in enumerate(sets):
            x = s.values.to_numpy(zero_copy_only=False) % p
            for at in range(0, len(x), 4096):
                np.minimum(least[i], ((x[at : at + 4096, None] * times + plus) % p).min(0), out=least[i])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * hashes), pa.array(least.ravel()))

    return of


def minhash_bands(sets: DataFrame, bands: int = 16, rows: int = 4) -> DataFrame:
    """(set, band, key) of sets (set, s): banded MinHash signatures, made within the row."""
    least = sets.select("set", minhash_udf(bands * rows)("s").alias("m"))
    keys = [F.struct(F.lit(b).alias("band"), F.md5(F.array_join(F.slice("m", b * rows + 1, rows).cast("array<string>"), ",")).alias("key")) for b in range(bands)]
    return least.select("set", F.explode(F.array(*keys)).alias("x")).select("set", "x.band", "x.key")


def leak_minhash(train: DataFrame, test: DataFrame, text: str = "state", n: int = 5, jaccard: float = 0.8, bands: int = 16, rows: int = 4, id_col: str = "id") -> DataFrame:
    """(test_id, train_id, jaccard): pairs that share a MinHash band, verified by their exact shingle sets.

    Each side's sets are made once and written; pairs are those of sets, whose texts' ids follow at the end, so repeated rows count once and null ids are reported.
    """
    made = {}
    for side, df in (("train", train), ("test", test)):
        d = df.select(F.col(id_col).alias(f"{side}_id"), shingle_array(F.col(text), n).alias("s")).where(F.size("s") > 0)
        made[side] = written(d.select(f"{side}_id", set_name(F.col("s")).alias("set"), "s"), f"{side}-sets")
    sets = {side: written(d.groupBy("set").agg(F.first("s").alias("s")), f"{side}-distinct") for side, d in made.items()}
    of = {side: minhash_bands(d, bands, rows).withColumnRenamed("set", f"{side}_set") for side, d in sets.items()}
    found = written(of["test"].join(of["train"], ["band", "key"]).select("test_set", "train_set").distinct(), "found")
    for side, d in sets.items():
        found = found.join(d.select(F.col("set").alias(f"{side}_set"), F.col("s").alias(f"s_{side}")), f"{side}_set")
    both = F.size(F.array_intersect("s_train", "s_test"))
    found = found.select("test_set", "train_set", (both / (F.size("s_train") + F.size("s_test") - both)).alias("jaccard")).where(F.col("jaccard") >= jaccard)
    for side, d in made.items():
        found = found.join(d.select(F.col("set").alias(f"{side}_set"), f"{side}_id").distinct(), f"{side}_set")
    return found.select("test_id", "train_id", "jaccard")


#: What a translation keeps: addresses, codes and numbers. Fixed value.
KEPT = r"https?://[^ \t\n]+|[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+|[A-Z]+-?[0-9][A-Za-z0-9-]*|[0-9]+(?:[.,][0-9]+)*"


def leak_translated(train: DataFrame, test: DataFrame, text: str = "state", overlap: float = 0.8, least: int = 2, id_col: str = "id") -> DataFrame:
    """(test_id, train_id, shared, overlap): pairs of texts whose kept tokens agree, in whatever languages.

    A text's fingerprint is the set of its web and e-mail addresses, codes and numbers after digit folding. A token weighs
    ln(1 + texts / texts that have it), over both sides; overlap is the weight of the shared tokens over that of all tokens of
    both, and at least `least` must be shared. A pair at the threshold shares one of the test text's heaviest tokens, those that
    come before what weighs under `overlap` of the text's whole: pairs are found by these alone, so what most texts
    hold finds none. Equal fingerprints are one set, so repeated rows count once and null ids are reported.
    """
    def tokens(df: DataFrame, side: str) -> DataFrame:
        s = F.array_sort(F.array_distinct(F.regexp_extract_all(fold_digits(F.coalesce(F.col(text), F.lit(""))), F.lit(KEPT), F.lit(0))))
        d = df.select(F.col(id_col).alias(f"{side}_id"), s.alias("s")).where(F.size("s") >= least)
        return written(d.withColumn(f"{side}_set", F.md5(F.array_join("s", "\n"))), f"{side}-kept")

    a, b = tokens(train, "train"), tokens(test, "test")
    texts = a.count() + b.count()
    times = a.select(F.explode("s").alias("t")).union(b.select(F.explode("s").alias("t"))).groupBy("t").agg(F.log(1 + texts / F.count("*")).alias("w"))
    sides = []
    for side, d in (("train", a), ("test", b)):
        each = d.select(f"{side}_set", F.explode("s").alias("t")).distinct().join(times, "t")
        sides.append(each.withColumn(f"{side}_all", F.sum("w").over(W.partitionBy(f"{side}_set"))))
    x, y = sides
    before = W.partitionBy("test_set").orderBy(F.desc("w"), "t").rowsBetween(W.unboundedPreceding, -1)
    heavy = y.withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0.0))).where(F.col("before") <= (1 - overlap) * F.col("test_all") + 1e-9)
    found = heavy.select("test_set", "t").join(x.select("train_set", "t"), "t").select("test_set", "train_set").distinct()
    both = found.join(y, "test_set").join(x.drop("w"), ["train_set", "t"]).groupBy("test_set", "train_set").agg(F.count("*").alias("shared"), F.sum("w").alias("w"), F.max("test_all").alias("test_all"), F.max("train_all").alias("train_all"))
    both = both.withColumn("overlap", F.col("w") / (F.col("test_all") + F.col("train_all") - F.col("w"))).where((F.col("shared") >= least) & (F.col("overlap") >= overlap - 1e-9))
    return both.join(b.select("test_id", "test_set").distinct(), "test_set").join(a.select("train_id", "train_set").distinct(), "train_set").select("test_id", "train_id", "shared", "overlap")
