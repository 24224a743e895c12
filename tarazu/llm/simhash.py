"""SimHash near-duplicates: BK-trees over shards of fingerprints."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.llm.common import BY, components, in_blocks, materialise, may_match

#: Shingles hashed at once; bounds the memory of one very long text.
CHUNK = 1 << 16


def bit_sums(rows: np.ndarray) -> np.ndarray:
    """How many of the rows (bytes) have each bit: bytes are added up as bytes, 255 rows at a time."""
    bits = np.unpackbits(rows, axis=1)
    whole = len(bits) // 255 * 255
    sums = np.add.reduce(bits[:whole].reshape(-1, 255, bits.shape[1]), axis=1, dtype=np.uint8)
    return sums.sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, A-Z lower-cased; 0 without a word."""
    words = text.lower().split()
    n = len(words) - width + 1
    if n < 1:
        shingles: Iterator[bytes] = iter([b" ".join(words)] if words else [])
    else:
        shingles = map(b" ".join, zip(*(words[k : k + n] for k in range(width))))
    ones, total = np.zeros(64, np.int64), 0
    while True:
        h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in islice(shingles, CHUNK)), np.uint64)
        ones += bit_sums(h.astype(">u8").view(np.uint8).reshape(-1, 8))
        total += len(h)
        if len(h) < CHUNK:
            return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints_udf(width: int = 3):
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t.as_py() or b"", width) for t in texts], np.uint64)
        return pa.array(found.view(np.int64))

    return of


class BKTree:
    """Fingerprints as a Burkhard-Keller tree: each child hangs on its Hamming distance to its parent."""

    def __init__(self, values=()):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        for v in values:
            self.insert(v)

    def insert(self, value: int) -> None:
        values, children, at = self.values, self.children, 0
        new = len(values)
        values.append(value)
        children.append({})
        if not new:
            return
        while (d := (value ^ values[at]).bit_count()) in children[at]:
            at = children[at][d]
        children[at][d] = new

    def search(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, index) of all fingerprints within the radius: by the triangle inequality only edges from d - radius to d + radius can lead there."""
        if not self.values:
            return []
        values, children, found, todo = self.values, self.children, [], [0]
        while todo:
            at = todo.pop()
            d = (value ^ values[at]).bit_count()
            if d <= radius:
                found.append((d, at))
            edges = children[at]
            if edges:
                todo += [c for e, c in edges.items() if d - radius <= e <= d + radius]
        return found


def shard_pairs(left: list[tuple], right: list[tuple] | None, radius: int, fits=None) -> Iterator[tuple[int, tuple, tuple]]:
    """(distance, row, row) of all pairs within the radius inside one block of a shard (right None) or between two. Rows are (id, fingerprint, …); `fits` may rule out pairs of rows."""
    tree, rows = BKTree(row[1] for row in (left if right is not None else ())), left
    for row in left if right is None else right:
        for d, at in tree.search(row[1], radius):
            if fits is None or fits(rows[at], row):
                yield d, rows[at], row
        if right is None:
            tree.insert(row[1])


def shard_links(left: list[tuple], right: list[tuple] | None, radius: int, fits=None) -> list[tuple[int, int]]:
    """Forest of the pairs that shard_pairs finds, closest first: fewer edges than rows, and as long as all of them are links a path between the ends of each pair."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.get(v, v)) != v:
            parent[v] = v = parent.get(up, up)
        return v

    edges = []
    for _, a, b in sorted((d, a[0], b[0]) for d, a, b in shard_pairs(left, right, radius, fits)):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            edges.append((a, b))
    return edges


def band_masks(bands: int, radius: int) -> list[int]:
    """Bit masks of which two fingerprints within the radius must agree on at least one in full: all choices of bands - radius of the bands."""
    cuts = [round(64 * k / bands) for k in range(bands + 1)]
    band = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(band, bands - radius)]


def enough_bands(n: int, radius: int, block: int) -> int:
    """The fewest bands with which n evenly spread fingerprints make shards of a block at most, on average."""
    bands = radius + 1
    while n > block << (64 * (bands - radius) // bands) and bands < 3 * radius + 3:
        bands += 1
    return bands


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def fingerprint_links(prints: DataFrame, radius: int = 2, bands: int = 3, block: int = 192) -> DataFrame:
    """Edges (a, b) that join every two distinct fingerprints (column fp, long) within the radius through a path of such links.

    A shard holds the fingerprints that agree on the bits of one mask; by the pigeonhole principle
    every pair within the radius meets in some shard. A shard of over `block` fingerprints is cut
    into blocks and each two blocks meet in a task of their own, so no task holds a whole hot shard.
    In a task one block becomes a BK-tree and the other is searched in it. Trees travel by the
    shuffle, not as broadcasts, as together they grow with the corpus. More bands suit a larger corpus
    (see enough_bands) and find the same: at radius 2, 3 give 3 shards per fingerprint of 2^21 keys,
    4 give 6 of 2^32, 5 give 10 of 2^38.
    """
    masks = [signed(m) for m in band_masks(bands, radius)]
    keyed = prints.select(F.col("fp").alias("uid"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    rows = prints.select(F.col("fp").alias("uid"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("code"))
    return in_blocks(keyed, block, rows).mapInArrow(links_map(radius), LINKS).select("a", "b").distinct()


#: What links_map gives: the ends of an edge, the smaller id first, and the shard where it was found.
LINKS = "a long, b long, t int, key long"


def links_map(radius: int, fits=None, links=shard_links):
    """Rows (t, key, lo, hi, own, uid, code, …) sorted by BY to the edges of each group, LINKS: one block becomes a BK-tree, the other is searched in it. `links` sees rows (uid, code as a number, …)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now = [], None

        def done() -> list[tuple]:
            if not now:
                return []
            t, key, lo, hi = now
            mine, other = [row for own, row in group if own == lo], None if lo == hi else [row for own, row in group if own == hi]
            return [(min(e), max(e), t, key) for e in links(mine, other, radius, fits)]

        def out(edges: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], kind) for k, kind in enumerate(kinds)], ["a", "b", "t", "key"])

        for batch in batches:
            edges = []
            more = [batch.column(c).to_pylist() for c in batch.schema.names if c not in (*BY, "own", "uid", "code")]
            t, key, lo, hi, own, uid, code = (batch.column(c).to_pylist() for c in (*BY, "own", "uid", "code"))
            for at, o, row in zip(zip(t, key, lo, hi), own, zip(uid, map(int.from_bytes, code), *more)):
                if at != now:
                    edges += done()
                    group, now = [], at
                group.append((o, row))
            yield out(edges)
        yield out(done())

    return search


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, bands: int | None = None, block: int = 192) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits) and component_id, the least id reachable by links.

    Documents link when their fingerprints differ in at most `radius` bits. Null, empty and blank
    texts have fingerprint zero and link like any other. Rows with a null id are kept and linked;
    a component in which all ids are null has a null component_id. Repeated rows stay repeated. An
    empty table gives no rows. Other columns of the input are neither read nor returned. Only ids
    and fingerprints are shuffled; copies meet as one fingerprint. A very long text is held as its words. The number of bands follows from
    that of distinct fingerprints where none is given; it changes the work, not the result.
    """
    prints = docs.select(F.col(id_col).alias("id"), fingerprints_udf(width)(F.col(text_col).cast("binary")).alias("fp"))
    prints, _ = materialise(prints, "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    bands = bands or enough_bands(classes.count(), radius, block)
    found = components(fingerprint_links(classes.select("fp"), radius, bands, block))
    of = classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(smallest, "root").select("fp", "component_id")
    return prints.join(of, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near copies by similarity: SimHash fingerprints find them, sets of shingles decide

#: Bits of a wide fingerprint, made of so many numbers of 64 bits for each shingle; odd numbers that tell these apart.
WIDE = 256
_LANES = np.random.default_rng(1729).integers(1, 2**63, WIDE // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits of a parity sketch.
PARITY = 512
#: Bytes of a text split at once, up to the next white space.
SLICE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@np.errstate(over="ignore")
def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """The distinct word shingles of a UTF-8 text, A-Z lower-cased, as ascending 64-bit hashes; a text of fewer words has its whole sequence as one, apart from all shingles."""
    hashes, at = [], 0
    while at < len(text):
        space = _SPACE.search(text, at + SLICE)
        end = space.end() if space else len(text)
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, text[at:end].lower().split()), np.uint64))
        at = end
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    n = min(width, len(words))
    if not n:
        return words
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(h)])
    return np.unique(h)


@np.errstate(over="ignore")
def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """SimHash of WIDE bits of a set of shingle hashes."""
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(shingles), CHUNK):
        some = shingles[at : at + CHUNK]
        ones += bit_sums(np.stack([_mixed(some * lane) for lane in _LANES], 1).view(np.uint8))
    return np.packbits(2 * ones > len(shingles)).tobytes()


def parity_sketch(shingles: np.ndarray) -> bytes:
    """Whether an odd number of the shingle hashes falls to each of PARITY places. Two sets' sketches differ in no more bits than the sets in shingles."""
    odd = np.zeros(PARITY, bool)
    for at in range(0, len(shingles), CHUNK):
        odd ^= np.bincount((shingles[at : at + CHUNK] % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) % 2 == 1
    return np.packbits(odd).tobytes()


def may_be_similar(similarity: float):
    """Of two rows (id, fingerprint, size, parity sketch, …): false only where their sets can't have the Jaccard similarity, by their sizes or as the sketches show more differing shingles than it leaves."""

    def fits(a: tuple, b: tuple) -> bool:
        n, m = a[2], b[2]
        if min(n, m) < similarity * max(n, m):
            return False
        return (int.from_bytes(a[3]) ^ int.from_bytes(b[3])).bit_count() <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-6

    return fits


def apart_links(left: list[tuple], right: list[tuple] | None, radius: int, fits) -> list[tuple[int, int]]:
    """All pairs that shard_pairs finds of rows whose last fields, their components so far, differ."""
    return [(a[0], b[0]) for _, a, b in shard_pairs(left, right, radius, lambda a, b: a[-1] != b[-1] and fits(a, b))]


def wide_udf(width: int):
    """(code, same, size, odd): wide fingerprint, a 128-bit name of the set of shingles, their number, and their parity sketch."""

    @F.arrow_udf("code binary, same binary, size int, odd binary")
    def of(texts: pa.Array) -> pa.Array:
        sets = (shingle_set(t.as_py() or b"", width) for t in texts)
        rows = [(wide_fingerprint(s), xxhash.xxh3_128_digest(s.tobytes()), len(s), parity_sketch(s)) for s in sets]
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.binary())
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["code", "same", "size", "odd"])

    return of


def sets_udf(width: int):
    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t.as_py() or b"", width).view(np.int64) for t in texts]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))

    return of


def bit_chance(similarity: float) -> float:
    """The chance that a bit tells two sets of one size and that Jaccard similarity apart: the angle of their vectors over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shard_plan(n: int, similarity: float, bucket: int, recall: float) -> tuple[int, int, int]:
    """(bits, tables, radius): keys of so many bits that n fingerprints fill shards of about `bucket`, so many tables
    that a pair at the similarity shares a key with a chance of `recall`, and the differing bits that it exceeds with one of some 1e-4."""
    p = bit_chance(similarity)
    bits = min(40, max(4, math.ceil(math.log2(max(n, 1) / bucket))))
    tables = math.ceil(math.log(1 - recall) / math.log1p(-((1 - p) ** bits)))
    return bits, tables, math.ceil(WIDE * p + 3.7 * math.sqrt(WIDE * p * (1 - p)))


def shards_map(bits: int, tables: int):
    """Rows (uid, code) to (uid, t, key): for each table the same seeded choice of the fingerprint's bits."""
    rng = np.random.default_rng(bits)
    places = np.stack([rng.choice(WIDE, bits, replace=False) for _ in range(tables)])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            key = np.unpackbits(code, axis=1)[:, places] @ (1 << np.arange(bits))
            uid, t = np.repeat(b.column("uid").to_numpy(), tables), np.tile(np.arange(tables, dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(t), pa.array(key.ravel().astype(np.int64))], ["uid", "t", "key"])

    return keys


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, recall: float = 0.97, bucket: int = 32, block: int = 192) -> DataFrame:
    """One row per input row: id and component_id, the least id reachable by links.

    Texts link when the Jaccard similarity of their sets of word shingles is at least `similarity`. SimHash
    fingerprints of WIDE bits over these sets find such pairs: a shard holds the fingerprints that agree on a
    choice of bits, and in a shard BK-trees give those within a radius that a pair at the similarity stays
    in (see shard_plan; more documents mean more bits and more tables); sizes and parity sketches rule out pairs that can't have it.

    All pairs found this way are settled. First a forest of them, closest first, leaves each shard, so a group of near copies costs no
    list of pairs; its edges are held against the sets themselves. Where all of a shard's edges are links, each of its pairs has a path
    of links between its ends. An edge that isn't one may have taken the place of links: such shards are searched again, and
    every pair whose ends no links join by then is held against the sets too. So groups don't depend on orders or blocks,
    and reruns agree. A hot shard is cut into blocks that meet pairwise in tasks of their own.

    Texts with equal sets are one class, whatever their number. Null, empty and blank texts have the same empty
    set; texts under `width` words have their whole sequence as one shingle. Rows with a null id are kept and
    linked, the least of a component's ids is null only where all are. Repeated rows stay repeated; an empty table gives no
    rows; other columns are neither read nor returned. Only the texts of found pairs are read again, as hashes.
    A very long text takes some 30 bytes for each word.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    prints = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("h"), wide_udf(width)(F.col(text_col).cast("binary")).alias("p"))
    prints, _ = materialise(prints.select("id", "h", "p.*"), "prints")
    classes = prints.groupBy("same").agg(F.min("id").alias("least"), *[F.min(c).alias(c) for c in ("h", "code", "size", "odd")])
    classes, _ = materialise(classes.withColumn("uid", F.monotonically_increasing_id()), "classes")
    bits, tables, radius = shard_plan(classes.count(), similarity, bucket, recall)
    keyed = classes.select("uid", "code").mapInArrow(shards_map(bits, tables), "uid long, t int, key long")
    rows, fits = classes.select("uid", "code", "size", "odd"), may_be_similar(similarity)

    def judged(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with `linked`: whether their sets have the similarity."""
        members = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct().join(classes, "uid").select("uid", F.col("h").alias("of"))
        members, _ = materialise(members, "members")
        hashed = may_match(docs.select(F.md5(text).alias("h"), F.col(text_col).alias("text")), F.xxhash64("h"), members.select(F.xxhash64("of")))
        texts = hashed.where("__may").groupBy("h").agg(F.first("text").alias("text"))  # before the shuffle a task keeps one of its copies
        sets = texts.join(members, F.col("h") == F.col("of"))
        sets, _ = materialise(sets.select("uid", sets_udf(width)(F.col("text").cast("binary")).alias("s")), "sets")
        both = F.size(F.array_intersect("x", "y"))
        held = pairs.join(sets.select(F.col("uid").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("uid").alias("b"), F.col("s").alias("y")), "b")
        held = held.select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
        return materialise(held.select("a", "b", (F.col("both") >= similarity * (F.col("sum") - F.col("both"))).alias("linked")), "judged")[0]

    near, _ = materialise(in_blocks(keyed, block, rows).mapInArrow(links_map(radius, fits), LINKS), "near")
    first = judged(near.select("a", "b").distinct())
    links = components(first.where("linked").select("a", "b"))
    failed, _ = materialise(near.join(first.where("not linked"), ["a", "b"]).select("t", "key").distinct(), "failed")
    if not failed.isEmpty():
        links, _ = materialise(links, "links")
        rows = rows.join(links, rows.uid == links.node, "left").select(*rows.columns, F.coalesce("root", "uid").alias("root"))
        again = in_blocks(keyed.join(failed, ["t", "key"], "left_semi"), block, rows).mapInArrow(links_map(radius, fits, apart_links), LINKS)
        second = judged(materialise(again.select("a", "b").distinct().join(first, ["a", "b"], "left_anti"), "again")[0])
        links = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second.where("linked").select("a", "b")))
    of = classes.join(links, classes.uid == links.node, "left").select("same", "least", F.coalesce("root", "uid").alias("root"))
    smallest = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(smallest, "root").select("same", "component_id"), "same").select(F.col("id").alias(id_col), "component_id")
