"""Quality rules: repetition coverage by rolling hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes hashed at once, and bytes of documents looked at together.
BLOCK, TOGETHER = 1 << 17, 1 << 21
#: Bytes up to which spans are hashed side by side.
SHORT = 24
#: Largest share of a text's word characters that may lie in word n-grams found twice or more in it.
MAX_NGRAM = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
#: The same for lines found twice or more.
MAX_LINES = 0.30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_HEAD = (np.arange(256) & 0xC0) != 0x80
_LETTER = _HEAD & ~_SPACE  # a character of a word, by its first byte
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _before(data: np.ndarray, kind: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of the kind stand before each of the ascending places, block by block."""
    out, done, lo = np.empty(len(at), np.int64), 0, 0
    for start in range(0, len(data) + 1, BLOCK):
        block = kind[data[start : start + BLOCK]]
        hi = np.searchsorted(at, start + BLOCK)
        if hi > lo:
            out[lo:hi] = done + np.concatenate([[0], np.cumsum(block)])[at[lo:hi] - start]
        done, lo = done + int(np.count_nonzero(block)), hi
    return out


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end]: of up to SHORT bytes by a mixing step a byte, all spans of a block at once; longer ones by XXH3.

    A plain polynomial modulo 2^64 would not do: its values collide on texts such as Thue and Morse's, whatever the base.
    """
    out, view = np.empty(len(starts), np.uint64), memoryview(data)
    for at in range(0, len(starts), BLOCK):
        begin, size = starts[at : at + BLOCK], (ends[at : at + BLOCK] - starts[at : at + BLOCK]).astype(np.int32)
        h = _mixed(size.astype(np.uint64) + np.uint64(_P))
        for k in range(min(int(size.max()), SHORT)):
            live = np.flatnonzero((size > k) & (size <= SHORT)) if k else np.flatnonzero(size <= SHORT)
            h[live] = _mixed((h[live] ^ _BYTE[data[begin[live] + k]]) * np.uint64(_P))
        for k in np.flatnonzero(size > SHORT).tolist():
            h[k] = xxhash.xxh3_64_intdigest(view[begin[k] : begin[k] + size[k]])
        out[at : at + BLOCK] = h
    return out


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    kind, edges, last = np.int32 if len(data) < 2**31 else np.int64, [], True
    for start in range(0, len(data), BLOCK):
        space = _SPACE[data[start : start + BLOCK]]
        edges.append((np.flatnonzero(np.diff(space, prepend=last)) + start).astype(kind))
        last = space[-1]
    edge = np.concatenate(edges) if edges else np.zeros(0, kind)
    return edge[::2].copy(), edge[1::2].copy()


def _repeated(keys) -> np.ndarray:
    """Whether each key occurs twice or more; keys() gives some of them by their places, so that only a sorted copy is held."""
    n = keys(None)
    order = np.empty(n, np.uint64)
    for at in range(0, n, BLOCK):
        order[at : at + BLOCK] = keys(slice(at, min(at + BLOCK, n)))
    order.sort()
    same = np.flatnonzero(order[1:] == order[:-1])
    twice, order = order[same], None
    twice = twice[np.flatnonzero(np.diff(twice, prepend=~twice[:1]))]
    out = np.zeros(n, bool)
    if len(twice):
        for at in range(0, n, BLOCK):
            some = keys(slice(at, min(at + BLOCK, n)))
            out[at : at + BLOCK] = twice[np.minimum(np.searchsorted(twice, some), len(twice) - 1)] == some
    return out


def _per(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between the ascending bounds, block by block."""
    out = np.zeros(len(bounds) - 1, np.int64)
    for at in range(0, len(values), BLOCK):
        total = np.concatenate([[0], np.cumsum(values[at : at + BLOCK], dtype=np.int64)])
        within = np.clip(bounds - at, 0, len(total) - 1)
        out += total[within[1:]] - total[within[:-1]]
    return out


@np.errstate(over="ignore")
def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS, dup_line_chars and dup_{n}gram_chars of each UTF-8 text, all texts at once.

    Beside the bytes themselves this takes about 35 bytes for each word and 20 for each line with a word.
    """
    n = len(texts)
    data = np.frombuffer(texts[0] + b"\n" if n == 1 else b"\n".join([*texts, b""]), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    out = {"word_chars": np.diff(_before(data, _LETTER, first)), "n_symbols": np.diff(_before(data, _SYMBOL, first))}
    salt = _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def salted(keys: np.ndarray, doc: np.ndarray):
        return lambda at: len(keys) if at is None else keys[at] ^ salt[doc[at]]

    last = np.concatenate([np.flatnonzero(data[at : at + BLOCK] == 10) + at for at in range(0, len(data), BLOCK)] or [np.zeros(0, np.int64)])
    begin = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)[: len(last)]
    size = _before(data, _LETTER, last) - _before(data, _LETTER, begin)
    begin, last, size = (x[size > 0] for x in (begin, last, size))
    bounds = np.searchsorted(begin, first)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
    keys = salted(_spans(data, begin, last), doc)
    places = np.argsort(keys(slice(None)), kind="stable")
    again = np.zeros(len(places), bool)
    again[places[1:]] = keys(places[1:]) == keys(places[:-1])
    out["n_dup_lines"] = _per(again, bounds)
    out["dup_line_chars"] = _per(size * _repeated(keys), bounds)
    del begin, last, size, doc, keys, places, again

    starts, ends = _words(data)
    rolled = _spans(data, starts, ends)
    size = (_before(data, _LETTER, ends) - _before(data, _LETTER, starts)).astype(np.int32)
    bounds = np.searchsorted(starts, first)
    del starts, ends
    words, out["n_words"] = rolled.copy(), np.diff(bounds)
    doc = np.repeat(np.arange(n, dtype=np.int32), out["n_words"])
    for width in range(2, max(MAX_NGRAM) + 1):
        rolled = rolled[:-1]
        rolled *= np.uint64(_P)
        rolled += words[width - 1 :][: len(rolled)]
        if width != 3 and width not in MAX_NGRAM:
            continue
        hit = _repeated(lambda at, r=rolled, w=width: max(len(words) - w + 1, 0) if at is None else _mixed(r[at]) ^ salt[doc[at]] ^ _across(doc, at, w))
        hit &= doc[: len(hit)] == doc[width - 1 :][: len(hit)]
        covered = np.zeros(len(words), bool)
        for k in range(width):
            covered[k : k + len(hit)] |= hit
        out["n_repeat_words" if width == 3 else f"dup_{width}gram_chars"] = _per(covered if width == 3 else size * covered, bounds)
    return out


def _across(doc: np.ndarray, at: slice, width: int) -> np.ndarray:
    """A mask unlike any other for windows that reach into the next document, so that they repeat nothing; 0 for the others."""
    places = np.arange(at.start, at.stop, dtype=np.uint64)
    return np.where(doc[at] == doc[at.start + width - 1 : at.stop + width - 1], np.uint64(0), _mixed((places + np.uint64(1)) * np.uint64(0xA24BAED4963EE407)))


MEASURES = (*COUNTS, "dup_line_chars", *(f"dup_{k}gram_chars" for k in MAX_NGRAM))


def measures(texts: pa.Array) -> pa.Array:
    rows, group, size = {m: [] for m in MEASURES}, [], 0

    def flush():
        found = measure(group)
        for m in MEASURES:
            rows[m].append(found[m])

    for t in texts:
        b = t.as_py() or b""
        if group and size + len(b) > TOGETHER:
            flush()
            group, size = [], 0
        group.append(b)
        size += len(b)
    if group:
        flush()
    return pa.StructArray.from_arrays([pa.array(np.concatenate(rows[m]) if rows[m] else [], pa.int64()) for m in MEASURES], list(MEASURES))


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_ngram: dict[int, float] | None = None, max_lines: float = MAX_LINES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row per input row: id, COUNTS, base_failed, dup_line_chars, dup_{n}gram_chars, kept.

    kept is false where base_failed (under `min_words` words, or over `max_repeat_percent` % of the
    words in 3-word windows found twice or more), or where lines or n-grams found twice or more hold
    a larger share of the word characters than allowed. Null, empty and blank texts count 0 everywhere
    and are not kept. Rows with a null id or repeated rows are treated like any other; other columns
    are neither read nor returned; an empty table gives no rows. A very long text is taken whole, its bytes in
    blocks (see measure() for the memory it takes). Narrow: no shuffle.
    """
    limits = MAX_NGRAM if max_ngram is None else max_ngram
    m = docs.select(F.col(id_col).alias("id"), F.arrow_udf(measures, ", ".join(f"{m} long" for m in MEASURES))(F.col(text_col).cast("binary")).alias("m")).select(F.col("id").alias(id_col), "m.*")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    over = F.col("dup_line_chars") > max_lines * F.col("word_chars")
    for k, share in limits.items():
        over |= F.col(f"dup_{k}gram_chars") > share * F.col("word_chars")
    return m.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)
