"""Alignment of two tokenizers' tokens: inverted pair bitmaps."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.llm.common import materialise
from tarazu.llm.packing import byte_letters

#: Entries (pair and document) that a block of documents gathers before it ends, and documents of a block at most (16 bits).
ENTRIES, BLOCK = 1_000_000, 1 << 16
#: Chunks whose alignment a Python worker remembers, none of over LONGEST characters; past this number it forgets those not met lately.
REMEMBERED, LONGEST = 250_000, 200
SHIFT = 32


class Aligner:
    """Tokens of both vocabularies of a text's chunks, and how their byte ranges overlap.

    A text, with its space before it, is cut before a lone space or line end, and between a letter and a mark: the first
    vocabulary splits there before it looks for tokens, the second has no piece across (merges make pieces only), so
    a chunk's tokens are those of the whole text.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = {chr(c): b for b, c in byte_letters().items()}
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes_a = {i: bytes(letters[c] for c in w) for w, i in vocabulary.items() if all(c in letters for c in w)}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) or [self.b.id_to_piece(i) for i in self.b.encode("\na")[:2]] != ["▁", "<0x0A>"]:
            raise ValueError("this vocabulary has pieces with a space or line end after other characters; texts can't be cut there")
        joined = {p[k + 1] for p in pieces for k in range(len(p) - 1) if p[k].isalnum()}
        marks = "".join(c for c in ".,;:!?|$%&*#\"()[]{}<>/=+~" if c not in joined)
        self.cut = re.compile(r"(?<=\S)(?=[ \n]\S)" + (rf"|(?<=[^\W\d_])(?=[{re.escape(marks)}])" if marks else ""))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.known: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def _of(self, chunk: str, ids_a: list[int], ids_b: list[int]) -> tuple | None:
        """(number of a tokens, of b tokens, of groups, groups as text, pairs of the links); None where bytes are lost.

        One walk over both: the current tokens overlap, and the one that ends first makes way for its next.
        """
        a, b = [self.bytes_a[i] for i in ids_a], [self.bytes_b[i] for i in ids_b]
        if not b"".join(a) == b"".join(b) == chunk.encode():
            return None
        a, b = list(map(len, a)), list(map(len, b))
        if a == b:
            return len(a), len(b), len(a), ";".join([f"{x}|{y}" for x, y in zip(ids_a, ids_b)]).encode(), np.array([x << SHIFT | y for x, y in zip(ids_a, ids_b)])
        pairs, said, j, n = [], [], 0, 1
        id_b, left_b = ids_b[0], b[0]
        text_a, text_b = "", str(id_b)
        for id_a, left in zip(ids_a, a):
            text_a += f",{id_a}" if text_a else str(id_a)
            while True:
                pairs.append(id_a << SHIFT | id_b)
                if left < left_b:  # this token ends first
                    left_b -= left
                    break
                left -= left_b
                j += 1
                if j == len(b):
                    break
                id_b, left_b = ids_b[j], b[j]
                if not left:
                    said.append(f"{text_a}|{text_b}")
                    text_a, text_b, n = "", str(id_b), n + 1
                    break
                text_b += f",{id_b}"
        said.append(f"{text_a}|{text_b}")
        return len(a), len(b), n, ";".join(said).encode(), np.array(pairs)

    def chunks(self, texts: list[str]) -> list[list[tuple | None]]:
        """For each text what _of() says of its chunks in order; new chunks of all texts are encoded together."""
        cut = [self.cut.split(f" {t}") if t else [] for t in texts]
        known = self.known
        if new := list({c for chunk in cut for c in chunk}.difference(known)):
            met = [c for c in new if c in self.before]
            known.update(zip(met, map(self.before.__getitem__, met)))
            new = [c for c in new if c not in known]
            a = self.a.encode_batch_fast(new, add_special_tokens=False)
            b = self.b.encode([f"\n{c}" for c in new], num_threads=1)  # a space is put before a text, so the line end's two tokens go
            known.update(zip(new, map(self._of, new, (e.ids for e in a), (ids[2:] for ids in b))))
        out = [list(map(known.__getitem__, chunk)) for chunk in cut]
        for c in new:
            if len(c) > LONGEST:
                del known[c]
        if len(known) > REMEMBERED:
            self.known, self.before = {}, known
        return out


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for a worker, over its tasks."""
    return Aligner(path_a, path_b)


def planes(keys: np.ndarray, docs: np.ndarray, times: np.ndarray, size: int) -> dict:
    """Compressed bitmaps of a block's entries (pair, document in the block, multiplicity): for each pair and each bit of its multiplicities the documents that have the bit.

    A bitmap is its documents as 16-bit numbers, or `size` bits where that is shorter. pair, bit, kind and length are one number a bitmap; data holds them one after another.
    """
    bits = [(docs[has], keys[has], np.full(int(has.sum()), k, np.int8)) for k in range(int(times.max(initial=0)).bit_length()) if (has := (times >> k) & 1 > 0).any()]
    doc, key, bit = (np.concatenate(x) for x in zip(*bits)) if bits else (docs[:0], keys[:0], np.zeros(0, np.int8))
    order = np.lexsort((doc, bit, key))
    doc, key, bit = doc[order], key[order], bit[order]
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bit[1:] != bit[:-1])]) if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.r_[start, len(key)])
    width = -(-size // 8)
    dense = length * 2 > width
    data, at = [], 0
    for k in np.flatnonzero(dense).tolist():
        data.append(doc[at : start[k]].astype("<u2").tobytes())
        bitmap = np.zeros(size, bool)
        bitmap[doc[start[k] : (at := start[k] + length[k])]] = True
        data.append(np.packbits(bitmap).tobytes())
    data.append(doc[at:].astype("<u2").tobytes())
    return {"pair": key[start], "bit": bit[start], "dense": dense, "length": length.astype(np.int32), "data": b"".join(data)}


def opened(block: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap, document) of every entry of planes(), bitmap being the row of pair and bit."""
    width, at = -(-size // 8), 0
    index, docs = [], []
    for k, (dense, length) in enumerate(zip(block["dense"].tolist(), block["length"].tolist())):
        step = width if dense else 2 * length
        part = block["data"][at : at + step]
        docs.append(np.flatnonzero(np.unpackbits(np.frombuffer(part, np.uint8), count=size)) if dense else np.frombuffer(part, "<u2").astype(np.int64))
        index.append(k)
        at += step
    lengths = [len(d) for d in docs]
    return np.repeat(np.array(index, np.int64), lengths), (np.concatenate(docs) if docs else np.zeros(0, np.int64))


def popcounts(block: dict, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, documents, links): bits of the OR of each pair's planes, and of its planes times what each stands for."""
    index, docs = opened(block, size)
    pair, row = np.unique(block["pair"], return_inverse=True)
    links = np.zeros(len(pair), np.int64)
    np.add.at(links, row, block["length"].astype(np.int64) << block["bit"].astype(np.int64))
    united = np.unique(row[index] * size + docs) // max(size, 1)
    return pair, np.bincount(united, minlength=len(pair)).astype(np.int64), links


BLOCK_FIELDS = "block string, kind string, of long, rows long, n_a long, n_b long, n_groups long, n_links long, groups string, pair array<long>, bit array<tinyint>, dense array<boolean>, length array<int>, data binary, pairs array<long>, docs array<long>, links array<long>"
_SCHEMA = pa.schema([("block", pa.string()), ("kind", pa.string()), ("of", pa.int64()), ("rows", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("pair", pa.list_(pa.int64())), ("bit", pa.list_(pa.int8())), ("dense", pa.list_(pa.bool_())), ("length", pa.list_(pa.int32())), ("data", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64()))])


class Block:
    """Documents of a task in a row, with the entries of their pairs."""

    def __init__(self, name: str):
        self.name, self.rows, self.entries = name, [], 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, doc: int, chunks: list[tuple | None]) -> None:
        row = {"block": self.name, "kind": "doc", "of": doc, "rows": len(self.rows), "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": ""}
        if chunks and None not in chunks:
            n_a, n_b, n_groups, said, links = zip(*chunks)
            sha = hashlib.sha256(said[0])
            for k in range(1, len(said), 4096):
                sha.update(b";" + b";".join(said[k : k + 4096]))
            pairs, times = np.unique(np.concatenate(links), return_counts=True)
            row |= {"n_a": sum(n_a), "n_b": sum(n_b), "n_groups": sum(n_groups), "n_links": int(times.sum()), "groups": sha.hexdigest()}
            self.parts.append((pairs, np.full(len(pairs), len(self.rows)), times))
            self.entries += len(pairs)
        self.rows.append(row)

    @property
    def full(self) -> bool:
        return self.entries >= ENTRIES or len(self.rows) >= BLOCK

    def batch(self) -> pa.RecordBatch:
        """Its documents, and one row with its pairs' bitmaps and their popcounts."""
        none = np.zeros(0, np.int64)
        held = planes(*(np.concatenate(x) for x in zip(*self.parts, (none, none, none))), len(self.rows))
        pair, docs, links = popcounts(held, len(self.rows))
        whole = held | {"block": self.name, "kind": "pairs", "rows": len(self.rows), "pairs": pair, "docs": docs, "links": links}
        return pa.RecordBatch.from_pylist([*self.rows, whole], _SCHEMA)


def gather(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Blocks of docs (of, text) in the shared folder: a row for each document (kind doc) and one for each block's bitmaps (kind pairs)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, task, k = aligner(path_a, path_b), TaskContext.get().partitionId(), 0
        block = Block(f"{task}-0")
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc, chunks in zip(part.column("of").to_pylist(), both.chunks(part.column("text").to_pylist())):
                    block.add(doc, chunks)
                    if block.full:
                        yield block.batch()
                        k += 1
                        block = Block(f"{task}-{k}")
        if block.rows:
            yield block.batch()

    return materialise(docs.select("of", "text").mapInArrow(blocks, BLOCK_FIELDS), "alignment")[0]


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, docs, links, best): each pair's documents and links in all blocks, and whether no pair of its B id has more links; written to the shared folder.

    Blocks have no document in common, so the popcounts of their bitmaps add up to those of the bitmaps' union.
    """
    held = blocks.where("kind = 'pairs'").select(F.explode(F.arrays_zip("pairs", "docs", "links")).alias("x")).select("x.*")
    per = held.groupBy("pairs").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")).withColumn("b", F.col("pairs").bitwiseAND(F.lit((1 << SHIFT) - 1)))
    top = per.groupBy("b").agg(F.max("links").alias("top"))
    return materialise(per.join(top, "b").select("pairs", "docs", "links", (F.col("links") == F.col("top")).alias("best")), "pairs")[0]


def returned(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, rows, n_best, count_sum): what the bitmaps give back to each document of a block that has pairs.

    Only the pairs of each block meet the counts, its bitmaps don't move until they are known: a pair's row in the counts
    meets one row a block, and a block's counts, at most one for each of its entries, come to its bitmaps.
    """
    held = blocks.where("kind = 'pairs'").select("block", F.explode("pairs").alias("pairs"))
    scored = held.join(counts.select("pairs", "links", "best"), "pairs").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pairs", "links", "best"))).alias("scored"))
    whole = blocks.where("kind = 'pairs'").select("block", F.col("rows").alias("size"), "pair", "bit", "dense", "length", "data").join(scored, "block")
    whole = whole.select("block", "size", "pair", "bit", "dense", "length", "data", F.col("scored.pairs").alias("pairs"), F.col("scored.links").alias("links"), F.col("scored.best").alias("best"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                size = row["size"].as_py()
                of = lambda c: row[c].values.to_numpy(zero_copy_only=False)  # noqa: B023,E731
                block = {c: of(c) for c in ("pair", "bit", "dense", "length")} | {"data": row["data"].as_py()}
                index, docs = opened(block, size)
                at = np.searchsorted(of("pairs"), block["pair"])
                worth = np.int64(1) << block["bit"].astype(np.int64)
                sums, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
                np.add.at(sums, docs, (of("links")[at] * worth)[index])
                np.add.at(best, docs, (of("best")[at] * worth)[index])
                some = np.flatnonzero(sums)
                yield pa.RecordBatch.from_pydict({"block": pa.array([row["block"].as_py()] * len(some), pa.string()), "rows": pa.array(some, pa.int64()), "n_best": pa.array(best[some], pa.int64()), "count_sum": pa.array(sums[some], pa.int64())})

    return whole.mapInArrow(add, "block string, rows long, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Each document's digest, and the pairs (a, b, docs, links, best) of the whole corpus.

    Digest: the id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Null and empty texts, and those whose tokens'
    bytes aren't the text's (a `▁` in it, say), have no tokens: zeros and an empty digest. Repeated rows and null ids are documents
    like others and count each time; a tie for a B id's highest count makes all of them best; long texts are aligned chunk
    by chunk; columns beside id and text are ignored, whatever their names; an empty table gives no rows.
    """
    blocks = gather(docs.select(F.col(id_col).alias("of"), F.col(text_col).alias("text")), path_a, path_b)
    counts = pair_counts(blocks)
    rows = blocks.where("kind = 'doc'").select("block", "rows", "of", "n_a", "n_b", "n_groups", "n_links", "groups")
    out = rows.join(returned(blocks, counts), ["block", "rows"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    found = out.select(F.col("of").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), F.col("groups").alias("groups_sha256"))
    return found, counts.select(F.shiftright("pairs", SHIFT).alias("a"), F.col("pairs").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b"), "docs", "links", "best")
