"""Packing: first-fit decreasing by a tournament tree, in random groups of documents."""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens, and other chunks, whose ids a Python worker remembers, none of over LONGEST bytes; at this number it forgets all and starts anew.
REMEMBERED, LONGEST = 150_000, 64
#: Bytes of a text looked at together, up to the next white space; bounds the memory of one very long text.
SLICE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Text of these characters needs no Unicode normalisation, and lower-casing is one to one.
PLAIN = re.compile(r"[\x09-\x0d\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: Pre-tokens of a lower-cased plain text, as the vocabulary's own pattern splits it; white space is dropped.
PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\x09-\x0d\x20]+")


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 and up in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(rest)}


class Ids:
    """Ids of texts as little-endian bytes.

    The vocabulary drops white space, so the ids of a text are those of its pieces between white space in
    order. A plain piece is split into pre-tokens here and only new ones go to the model; of another piece
    each chunk without white space is treated so by itself, and chunks that aren't plain are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.letters = self.whole.model, byte_letters()
        self.parts, self.chunks = Remembered(self.part), Remembered(self.chunk)

    def part(self, token: str) -> bytes:
        mapped = token if token.isascii() else token.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def plain(self, text: str) -> bytes | None:
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.parts.__getitem__, PRE.findall(text.lower())))

    def chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        ids = self.plain(text)
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes() if ids is None else ids

    def of(self, text: bytes | None) -> bytes:
        text, at, out = text or b"", 0, []
        while at < len(text):
            space = _SPACE.search(text, at + SLICE)
            end = space.end() if space else len(text)
            piece = text[at:end]
            ids = self.plain(piece.decode("utf-8", "replace"))
            out.append(b"".join(map(self.chunks.__getitem__, piece.split())) if ids is None else ids)
            at = end
        return b"".join(out)


class Remembered(dict):
    """The results of a function of one text or chunk, up to REMEMBERED short ones."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key):
        out = self.function(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = out
        return out


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def tokens_map(path: str, end_id: int, length: int, groups: int):
    """Rows (id, h, text) to (id, grp, n, crcs): a document's group, its number of ids with the end id, and the CRC-32 of each run of `length` ids.

    The group is a hash of h, of the task and of how many rows with this h the task has seen, so rows that
    repeat are dealt over all groups. That number doesn't depend on the order of other rows.
    """
    end = array("I", [end_id]).tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen, task = ids_of(path), defaultdict(int), TaskContext.get().partitionId()
        for batch in batches:
            groups_of, n, crcs = [], [], []
            for h, t in zip(batch.column("h").to_pylist(), batch.column("text")):
                groups_of.append(xxhash.xxh64_intdigest(struct.pack("<qqq", h, task, seen[h])) % groups)
                seen[h] += 1
                b = ids.of(t.as_py()) + end
                n.append(len(b) // 4)
                crcs.append([zlib.crc32(memoryview(b)[k : k + 4 * length]) for k in range(0, len(b), 4 * length)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(groups_of, pa.int64()), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["id", "grp", "n", "crcs"])

    return count


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size. A tournament tree over the bins keeps the largest free capacity below
    every node; going left wherever that side still has room finds the first bin that fits in log time."""
    n = len(sizes)
    width = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * width)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in np.argsort(-sizes, kind="stable"):
        size, at = int(sizes[k]), 1
        while at < width:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[k], offsets[k] = at - width, capacity - tree[at]
        tree[at] -= size
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, end_id: int = 2, group_docs: int = 1000, seed: int = 0) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.

    A document is its ids and the end id, cut every `length` ids; whole pieces fill a sequence, the
    rests are packed first-fit decreasing within random groups of about `group_docs` documents.
    padded_length is the sequence's final length: `length`, or as it is where that is a power of two.
    A null or empty text is the end id alone. The group of a document is a hash of id, text, seed, task and
    its number among equal rows of the task: repeated rows and rows with a null id are packed like others, as
    often as they occur, in groups of their own. Reruns over equally partitioned input agree. An empty table
    gives no rows. Other columns are neither read nor returned, so their names don't matter. Texts stay where
    they are read; only lengths and checksums are shuffled, and a group never holds more than its documents'
    pieces. A very long text is looked at in slices up to a white space and takes 4 bytes for each of its ids;
    a chunk without white space goes to the tokenizer whole.
    """
    n_docs = docs.count()
    groups = max(1, -(-n_docs // group_docs))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), id_col, text_col).alias("h"), F.col(text_col).cast("binary").alias("text"))
    counted = rows.mapInArrow(tokens_map(tokenizer, end_id, length, groups), f"id {kind}, grp long, n long, crcs array<long>")

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(first=[c[0] for c in frame["crcs"]]).sort_values(["n", "id", "first"], kind="stable", na_position="last").reset_index(drop=True)
        n, pieces = frame["n"].to_numpy(), frame["crcs"].str.len().to_numpy()
        row = np.repeat(np.arange(len(frame)), pieces)
        start = length * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.minimum(length, n[row] - start)
        part = size < length
        seq, offset = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        bins, offset[part] = first_fit_decreasing(size[part], length)
        seq[part] = bins
        seq[~part] = len(frame) + np.arange((~part).sum())
        fill = np.bincount(np.unique(seq, return_inverse=True)[1], size)[np.unique(seq, return_inverse=True)[1]].astype(np.int64)
        return pd.DataFrame({
            id_col: frame["id"].iloc[row].array, "start": start, "length": size, "ids_crc32": np.concatenate(frame["crcs"].to_list()).astype(np.int64), "doc_tokens": n[row],
            "sequence_id": (int(frame["grp"].iloc[0]) << 32) + seq, "offset": offset, "padded_length": np.where(fill & (fill - 1), length, fill),
        })

    return counted.groupBy("grp").applyInPandas(packed, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long")
