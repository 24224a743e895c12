"""Toxic passages: maximum-scoring segments of token log-odds, judged by extreme values."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A token is a run of letters, lower-cased.
TOKEN = re.compile(r"[^\W\d_]+")
#: Code points looked at together, up to the next white space; bounds the memory of one very long text.
SLICE = 1 << 20
_BLANK = re.compile(r"\s")
#: Prices of a token without evidence that are tried; a segment needs one hit of log-odds d for each d / price other tokens.
PRICES = (0.1, 0.2, 0.4, 0.8)


def slices(text: str) -> Iterator[tuple[int, str]]:
    """The text in parts that end at white space, with their places."""
    at = 0
    while at < len(text):
        cut = _BLANK.search(text, at + SLICE) if len(text) - at > SLICE else None
        end = cut.start() if cut else len(text)
        yield at, text[at:end]
        at = end


def lowered(text: str) -> str:
    """Lower-cased, each code point in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def hits(text: str, odds: dict[str, float]) -> tuple[int, list[tuple[int, str]]]:
    """Number of tokens, and the (number, token) of those in odds."""
    n, found = 0, []
    for _, part in slices(text):
        words = TOKEN.findall(lowered(part))
        found += [(n + k, w) for k, w in enumerate(words) if w in odds]
        n += len(words)
    return n, found


def spans(text: str, wanted: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points (start, end) of runs of tokens, given by the numbers of their first and last tokens in order."""
    ends: dict[int, tuple[int, int]] = dict.fromkeys(k for pair in wanted for k in pair)
    k = 0
    for at, part in slices(text):
        for m in TOKEN.finditer(part):
            if k in ends:
                ends[k] = (at + m.start(), at + m.end())
            k += 1
    return [(ends[a][0], ends[b][1]) for a, b in wanted]


def segments(scored: list[tuple[int, float]], price: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), by Ruzzo and Tompa's linear scan.

    scored: (number, log-odds) of the tokens with evidence; every token costs `price`, so those between two hits count as one step down.
    The stack holds candidates with the running total before (low) and after (high) each.
    """
    stack: list[list] = []  # first, last, low, high, the candidate to look at next on the way down
    total, last = 0.0, -1
    for at, odds in scored:
        total -= (at - last - 1) * price
        last = at
        low, total = total, total + odds - price
        if total <= low:
            continue
        now = [at, at, low, total]
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= now[2]:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= now[3]:
                stack.append([*now, k])
                break
            now = [stack[k][0], now[1], stack[k][2], now[3]]
            del stack[k:]
    return [(a, b, high - low) for a, b, low, high, _ in stack]


@dataclass
class Model:
    """odds: log-odds of tokens with evidence. rate, scale: lambda and ln K of chance segments. weights: of evidence() to the label's log-odds."""

    odds: dict[str, float]
    price: float
    rate: float
    scale: float
    weights: np.ndarray

    def excess(self, score: float, n: int) -> float:
        """-ln of how many segments of this score or more n tokens without toxicity hold by chance."""
        return self.rate * score - self.scale - float(np.log(max(n, 1)))

    def judge(self, n: int, found: list[tuple[int, str]]) -> tuple[float, list[tuple[int, int, float, float]]]:
        """The label's probability, and the significant segments (first token, last token, score, expected number by chance)."""
        segs = segments([(k, self.odds[w]) for k, w in found], self.price)
        z = float(evidence(n, [(a, b, self.excess(s, n)) for a, b, s in segs]) @ self.weights)
        passages = [(a, b, s, float(np.exp(-x))) for a, b, s in segs if (x := self.excess(s, n)) > SIGNIFICANT]
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700)))), passages


#: -ln of the number of chance segments below which a segment is significant: e^-3, about 0.05.
SIGNIFICANT = 3.0


def evidence(n: int, segs: list[tuple[int, int, float]]) -> np.ndarray:
    """What a document's segments (first, last, excess) say: the best one's excess, the sum of the significant ones, their share of the tokens, and 1."""
    best = max([0.0, *(x for *_, x in segs)])
    held = [(b - a + 1, x) for a, b, x in segs if x > SIGNIFICANT]
    return np.array([np.log1p(best), np.log1p(sum(x for _, x in held)), np.sqrt(sum(m for m, _ in held) / max(n, 1)), 1.0])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression by Newton steps (the last column, 1, is not shrunk), and the log-loss."""
    w, shrink = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-9]) * weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + shrink, x.T @ (weight * (p - y)) + shrink @ w)
        w = w - step * min(1.0, 5 / max(float(np.abs(step).max()), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return w, float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())


def calibrated(rows: list[tuple[int, int, list[tuple[int, str]]]], weight: np.ndarray, odds: dict[str, float]) -> Model:
    """The model whose price, chance distribution and weights explain the labels of rows (label, tokens, hits) best.

    For each price: lambda solves sum p(token) exp(lambda * score) = 1 over the tokens of label 0 (Karlin and Altschul), K makes
    the number of their segments of at least the median score equal to K N exp(-lambda * score); a logistic regression takes the rest.
    """
    y = np.array([label for label, *_ in rows], float)
    clean = [(n, found) for label, n, found in rows if label == 0]
    tokens = max(sum(n for n, _ in clean), 1)
    counts: dict[str, float] = defaultdict(float)
    for _, found in clean:
        for _, w in found:
            counts[w] += 1
    value, share = np.array([odds[w] for w in counts] or [0.0]), np.array(list(counts.values()) or [0.0]) / tokens
    best: tuple[float, Model] | None = None
    for price in PRICES:
        chance = lambda r: float((share * np.exp(r * (value - price))).sum() + (1 - share.sum()) * np.exp(-r * price)) - 1  # noqa: B023,E731
        low, high = 1e-6, 5.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if chance(mid) < 0 else (low, mid)
        rate = min(low, 1.0)  # over 1 a segment would say more than its own log-odds
        scores = np.sort([s for n, found in clean for *_, s in segments([(k, odds[w]) for k, w in found], price)] or [0.0])
        mid = float(scores[len(scores) // 2])
        scale = float(np.log(max(np.sum(scores >= mid), 1) / tokens)) + rate * mid
        model = Model(odds, price, rate, scale, np.zeros(4))
        x = np.array([evidence(n, [(a, b, model.excess(s, n)) for a, b, s in segments([(k, odds[w]) for k, w in found], price)]) for _, n, found in rows]).reshape(-1, 4)
        model.weights, loss = logistic(x, y, weight)
        if best is None or loss < best[0]:
            best = (loss, model)
    return best[1]


def log_odds(sample: DataFrame, prior: float, least_z: float, most: int) -> dict[str, float]:
    """Log-odds of tokens in texts of label 1 against 0, with a Dirichlet prior in proportion to each token's share of all; only positive ones whose signed root of the likelihood ratio is least_z or more, the `most` strongest.

    A token counts once for each text, texts whose 3-word shingles have the same least hash being one: copies and near copies speak once.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                seen, least = set(), 1 << 64
                for _, part in slices(text):
                    words = TOKEN.findall(lowered(part))
                    seen.update(words)
                    least = min([least, *(xxhash.xxh3_64_intdigest(" ".join(words[k : k + 3])) for k in range(max(len(words) - 2, 1)))])
                yield pa.RecordBatch.from_pydict({"text": pa.array([least - (1 << 63)] * len(seen), pa.int64()), "token": pa.array(list(seen), pa.string()), "label": pa.array([label] * len(seen), pa.int32())})

    once = sample.select("text", "label").mapInArrow(tokens, "text long, token string, label int").groupBy("text", "token", "label").agg(F.lit(1).alias("one"))
    per = once.groupBy("token").agg(F.count_if(F.col("label") == 1).alias("y1"), F.count_if(F.col("label") == 0).alias("y0"))
    n1, n0 = per.agg(F.sum("y1"), F.sum("y0")).first()
    if not n1 or not n0:
        return {}
    own = F.lit(0.5) + F.lit(float(prior)) * (F.col("y1") + F.col("y0")) / F.lit(float(n1 + n0))
    a, b = F.col("y1") + own, F.col("y0") + own
    odds = F.log(a / (F.lit(float(n1 + prior)) - a)) - F.log(b / (F.lit(float(n0 + prior)) - b))
    part = lambda y, n: F.when(y > 0, y * F.log(y / ((F.col("y1") + F.col("y0")) * F.lit(n / (n1 + n0))))).otherwise(0.0)
    ratio = 2 * (part(F.col("y1"), n1) + part(F.col("y0"), n0))
    strong = per.select("token", odds.alias("odds"), ratio.alias("ratio")).where((F.col("ratio") >= least_z**2) & (F.col("odds") >= 1))
    return {r.token: r.odds for r in strong.orderBy(F.desc("ratio"), "token").limit(most).collect()}


def train(docs: DataFrame, labels: DataFrame, per_label: int = 8000, prior: float = 10.0, least_z: float = 5.0, most: int = 1 << 15, seed: int = 0) -> Model | None:
    """Fit on docs (id, text) and labels (id, label 0 or 1, one row an id); None unless both labels have a text.

    The fit sees about `per_label` labelled ids of each label, drawn by a hash; that bounds what is counted and what reaches the
    driver (places of known tokens, never texts). A row of a label weighs as many as it stands for.
    """
    sizes = {r.label: r.n for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return None
    rates = {k: min(1.0, per_label / n) for k, n in sizes.items()}
    drawn = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = labels.where(drawn < F.when(F.col("label") == 1, rates[1]).otherwise(rates[0]))
    sample = docs.where("text is not null").join(F.broadcast(few), "id").select("text", "label")  # at most about twice per_label ids
    odds = log_odds(sample, prior, least_z, most)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(xxhash.xxh3_64_intdigest(t) - (1 << 63), *hits(t, odds)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"of": pa.array([h for h, *_ in rows], pa.int64()), "label": batch.column("label"), "n": pa.array([n for _, n, _ in rows], pa.int64()), "at": pa.array([[k for k, _ in f] for *_, f in rows], pa.list_(pa.int64())), "tokens": pa.array([[w for _, w in f] for *_, f in rows], pa.list_(pa.string()))})

    rows = sample.mapInArrow(found, "of long, label int, n long, at array<long>, tokens array<string>").dropDuplicates(["of", "label"]).collect()
    rows = [(r.label, r.n, list(zip(r.at, r.tokens))) for r in sorted(rows, key=lambda r: (r.of, r.label))]
    if {label for label, *_ in rows} != {0, 1}:
        return None
    return calibrated(rows, np.array([1 / rates[label] for label, *_ in rows]), odds)


def scores_udf(model: Model, passages: bool):
    kind = "struct<score:double,passages:array<struct<start:long,end:long,score:double,expected:double>>>"

    @F.arrow_udf(kind)
    def of(texts: pa.Array) -> pa.Array:
        found = []
        for t in texts:
            text = t.as_py() or ""
            score, segs = model.judge(*hits(text, model.odds))
            where = spans(text, [(a, b) for a, b, *_ in segs]) if passages and segs else []
            found.append({"score": score, "passages": [{"start": a, "end": b, "score": s, "expected": e} for (a, b), (_, _, s, e) in zip(where, segs)]})
        inner = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        return pa.array(found, pa.struct([("score", pa.float64()), ("passages", inner)]))

    return of


def held_out(id_col: str):
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, passages: bool = True, **training) -> DataFrame:
    """docs with held_out, score, predicted and passages added (columns of these names are replaced).

    Learns from labels whose id isn't held out; an id labelled twice has its higher label; labels other than 0 and 1 and null ids are left out.
    score is the probability of label 1 from the whole text alone, predicted whether it reaches the threshold. passages: the
    significant toxic segments as (start, end) in code points, score and how many such segments chance would give; empty unless `passages`.
    Null, empty and letterless texts have no token and get the score of a text without evidence. Where nothing can be learned all scores are 0.
    Repeated rows and null ids are scored like others; long texts are read whole, in slices; an empty table stays empty.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(~held_out("id") & F.col("id").isNotNull() & F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    model = train(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), known, **training)
    none = F.array().cast("array<struct<start:long,end:long,score:double,expected:double>>")
    if model is None:
        found = F.struct(F.lit(0.0).alias("score"), none.alias("passages"))
    else:
        found = scores_udf(model, passages)(F.col(text_col))
    own = {c: F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted", "passages")}
    out = docs.select(F.struct(*own.values()).alias("row"), held_out(id_col).alias("held_out"), found.alias("found"))
    return out.select("row.*", "held_out", F.col("found.score").alias("score"), (F.col("found.score") >= threshold).cast("int").alias("predicted"), F.col("found.passages").alias("passages"))
