"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.llm.common import unused

#: Hashed n-gram slots and n-gram lengths.
SLOTS, ORDERS = 1 << 15, (1, 2, 3)
#: Code points looked at together; bounds the memory of one very long text.
SLICE = 1 << 18
_MIX = [np.uint32(m) for m in (2654435761, 2246822519, 3266489917)]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the text's lower-cased character n-grams and how often each occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    total = np.zeros(SLOTS, np.int64)
    for at in range(0, max(len(points), 1), SLICE):
        part = points[at : at + SLICE + max(ORDERS) - 1]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            h = (h[: len(part) - n + 1] ^ part[n - 1 :]) * _MIX[n - 1] + np.uint32(n)
            h ^= h >> np.uint32(15)
            if n in ORDERS:
                total += np.bincount((h[:SLICE] * _MIX[0]) >> np.uint32(17), minlength=SLOTS)
    slots = np.flatnonzero(total)
    return slots, total[slots]


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray  # slot x class, the last row is the bias
    temperature: float

    def logits(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[slots]
        return x @ self.weights[slots] / max(float(np.sqrt(x @ x)), 1e-12) + self.weights[-1]

    def predict(self, text: str) -> tuple[int, float]:
        z = self.logits(*ngram_counts(text)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return k, float(p[k] / p.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """Weights by follow-the-regularised-leader: per-coordinate rates, elastic net (l1 makes unused weights exactly 0)."""
    z, n = np.zeros((SLOTS + 1, classes)), np.zeros((SLOTS + 1, classes))

    def solved(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for slots, values, label in rows:
            at, x = np.append(slots, SLOTS), np.append(values, 1.0)
            w = solved(z[at], n[at])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    return solved(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log-loss, by a grid of ratios 2^(1/8)."""
    best = (np.inf, 1.0)
    for t in 2.0 ** (np.arange(-48, 25) / 8):
        z = logits / t
        z = z - z.max(1, keepdims=True)
        best = min(best, (float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), labels])), float(t)))
    return best[1]


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and for each slot the number of texts that have it, over all of them. Each task adds up its own and sends SLOTS rows at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(SLOTS + 1, np.int64)
        for batch in batches:
            for t in batch.column(0):
                df[ngram_counts(t.as_py())[0]] += 1
                df[SLOTS] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], ["slot", "n"])

    rows = texts.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # SLOTS + 1 rows at most
    df = np.zeros(SLOTS + 1, np.int64)
    for r in rows:
        df[r.slot] = r.n
    return int(df[SLOTS]), df[:SLOTS]


def train(labelled: DataFrame, per_language: int = 750, seed: int = 0, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 2) -> Model | None:
    """Fit on labelled (id, text, lang), none of them null; None without a row.

    Document frequencies and class counts cover all rows. The weights are fitted on a sample of about
    `per_language` rows of each language, drawn by a hash of id and text; each fifth row of the sample in a hashed
    order only sets the temperature (fewer than 5 rows leave it at 1). `per_language` bounds what reaches the
    driver: n-gram counts, never texts. Equal rows share their hash and count once.
    """
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    classes = sorted(sizes)
    total, df = document_frequencies(labelled.select("text"))
    idf = np.log((1 + total) / (1 + df)) + 1
    rate = F.create_map(*[F.lit(x) for c in classes for x in (c, min(1.0, per_language / sizes[c]))])
    drawn = F.pmod(F.xxhash64(F.lit(seed), "id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [ngram_counts(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("drawn"), batch.column("lang"), pa.array([s.astype("<u2").tobytes() for s, _ in pairs], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in pairs], pa.binary())], ["drawn", "lang", "slots", "counts"])

    sample = labelled.withColumn("drawn", drawn).where(F.col("drawn") < rate[F.col("lang")]).select("drawn", "lang", "text").mapInArrow(counted, "drawn double, lang string, slots binary, counts binary").distinct().collect()
    rows = []
    for r in sorted(sample, key=lambda r: ((r.drawn * 7919) % 1, r.lang, bytes(r.slots))):
        slots, counts = np.frombuffer(r.slots, "<u2").astype(np.int64), np.frombuffer(r.counts, "<u4").astype(float)
        x = (1 + np.log(counts)) * idf[slots]
        rows.append((slots, x / max(float(np.sqrt(x @ x)), 1e-12), classes.index(r.lang)))
    held, fit = rows[4::5], [r for k, r in enumerate(rows) if k % 5 != 4]
    weights = ftrl(fit, len(classes), alpha, beta, l1, l2, epochs)
    logits = np.array([x @ weights[s] + weights[-1] for s, x, _ in held]).reshape(len(held), len(classes))
    t = temperature(logits, np.array([k for *_, k in held], int)) if held else 1.0
    return Model(classes, idf, weights, t)


def predictions_udf(model: Model):
    @F.arrow_udf("k int, score double")
    def predict(texts: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) if t.is_valid else (None, None) for t in texts]
        return pa.StructArray.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([s for _, s in found], pa.float64())], ["k", "score"])

    return predict


def held_out(id_col: str):
    """Whether crc32 of the id as text leaves 0 modulo 5; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **training) -> DataFrame:
    """docs with held_out, lang_pred and score added (columns of these names are replaced).

    Learns from rows that aren't held out and have both language and text; see train() for its bound.
    Predicts every row from its whole text alone. Null texts and those without a letter get `und` and
    score 0, as do all rows where nothing could be learned. Repeated rows, null ids and very long texts
    are treated like any other; of equally probable languages the first by name is taken; an empty table stays empty.
    """
    labelled = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    model = train(labelled, **training)
    out = docs.withColumn("held_out", held_out(id_col))
    if model is None:
        return out.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    found = predictions_udf(model)(F.when(letters, F.col(text_col)))
    names = F.array(*[F.lit(c) for c in model.classes])
    (of,) = unused(out, "found")
    out = out.withColumn(of, found)
    return out.withColumn("lang_pred", F.coalesce(F.get(names, F.col(of)["k"]), F.lit("und"))).withColumn("score", F.coalesce(F.col(of)["score"], F.lit(0.0))).drop(of)
