"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarazu.llm.common import BY, components, in_blocks, materialise

#: Bits of the full code, by which pairs are dropped before vectors move; directions that a rotation keeps at most.
CODE_BITS, AXES = 256, 256
#: Lengths of vectors, from the most frequent on, whose rotations are learned; those of other lengths are random.
LEARNED = 8


def learn_rotation(c: np.ndarray, bits: int, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """Projection of centred rows to `bits` directions: PCA and a rotation that makes the signs keep the most
    (Gong and Lazebnik, 2011): in turn take the signs as codes, and the best rotation onto them by an SVD."""
    axes = np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :bits]
    v = c @ axes
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1], axes.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


def hyperplanes(dim: int, bits: int, seed: int, sample: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean, planes): `bits` directions of as many rotations as that takes, learned on a sample of unit rows or random without one.

    The mean is taken off for balanced codes, unless the rows lie so close together that this would double angles.
    """
    axes = min(dim, AXES)
    mean = np.zeros(dim) if sample is None else sample.mean(0)
    if sample is not None and spread(sample, mean) < 0.5:
        mean = np.zeros(dim)
    turns = []
    for k in range(-(-bits // axes)):
        if sample is None:
            turns.append(np.linalg.qr(np.random.default_rng([seed + k, dim]).standard_normal((dim, dim)))[0][:, :axes])
        else:
            turns.append(learn_rotation(sample - mean, axes, seed=seed + k))
    return mean, np.hstack(turns)[:, :bits]


def spread(sample: np.ndarray, mean: np.ndarray) -> float:
    """Squared distance from the mean that nine of ten rows exceed."""
    return float(np.quantile(((sample - mean) ** 2).sum(1), 0.1))


def angle_at(threshold: float, distance: float = 1.0) -> float:
    """Angle, seen from a point whose squared distance is given, of two unit vectors whose cosine is the threshold; a bit tells them apart with a chance of angle / pi."""
    return math.acos(max(-1.0, min(1.0, 1 - (1 - threshold) / distance)))


def table_plan(n: int, angle: float, bucket: int = 64, recall: float = 0.96) -> tuple[int, int]:
    """(bits, tables): keys of so many bits that n vectors fill buckets of about `bucket`, and so many tables that a pair at the angle shares a key with a chance of `recall`."""
    bits = min(32, max(4, math.ceil(math.log2(max(n, 1) / bucket))))
    return bits, math.ceil(math.log(1 - recall) / math.log1p(-((1 - angle / math.pi) ** bits)))


def far_apart(angle: float) -> int:
    """Differing bits of the full code that pairs at the angle exceed with a chance of some 1e-6: five standard deviations above the mean."""
    p = min(angle / math.pi, 1.0)
    return math.ceil(CODE_BITS * p + 5 * math.sqrt(CODE_BITS * p * (1 - p)))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the vector, null unless it has finite components, not all of them 0. Adding 0 makes -0 equal to 0."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col(vec_col).isNotNull() & ~bad & F.exists(vec_col, lambda x: x != 0)
    plain = F.transform(vec_col, lambda x: x + F.lit(0).cast(df.schema[vec_col].dataType.elementType))
    return df.select(F.col(id_col).alias("id"), F.when(ok, plain).alias("v"))


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length scaled to length 1 in double precision, first by their largest component, so that squares neither overflow nor vanish."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def by_length(t: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each length of vectors, in their order."""
    n = np.diff(t.column("v").combine_chunks().offsets.to_numpy()) if len(t) else np.zeros(0, int)
    for dim in np.unique(n):
        yield int(dim), (t if (n == dim).all() else t.take(pa.array(np.flatnonzero(n == dim)))).combine_chunks()


def codes_map(planes: dict, bits: int, tables: int, seed: int):
    """Rows (uid, copies, v) with keys, one of `bits` bits and the vector's length for each table, and code, the first CODE_BITS bits."""
    total = max(bits * tables, CODE_BITS)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, t in by_length(pa.Table.from_batches([batch])):
                if dim not in planes:
                    planes[dim] = hyperplanes(dim, total, seed)
                mean, turn = planes[dim]
                signs = (unit_rows(t.column("v").chunk(0)) - mean) @ turn >= 0
                keys = signs[:, : bits * tables].reshape(len(t), tables, bits) @ (1 << np.arange(bits)) + (dim << 32)
                ends = np.arange(len(t) + 1, dtype=np.int32)
                code = pa.Array.from_buffers(pa.binary(), len(t), [None, pa.py_buffer((ends * (CODE_BITS // 8)).tobytes()), pa.py_buffer(np.packbits(signs[:, :CODE_BITS], axis=1).tobytes())])
                keys = pa.ListArray.from_arrays(pa.array(ends * tables), pa.array(keys.ravel().astype(np.int64)))
                yield from t.append_column("keys", keys).append_column("code", code).to_batches()

    return code


def group_starts(t: pa.Table) -> np.ndarray:
    marks = np.stack([t.column(c).to_numpy() for c in BY], 1)
    return np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(1)]) if len(marks) else np.zeros(0, int)


def groups_of(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, partners) of whole groups, sorted by BY: index arrays of as many groups of one size (first axis) as fit together.

    Inside a block both are the same rows; where two blocks meet, the rows of the one and those of the other.
    """
    own, lo, hi = (t.column(c).to_numpy() for c in ("own", "lo", "hi"))
    starts = group_starts(t)
    sizes = np.diff([*starts, len(t)])
    inner = lo[starts] == hi[starts]
    for size in np.unique(sizes[inner & (sizes > 1)]):
        whole = starts[inner & (sizes == size)]
        step = max(1, (1 << 18) // int(size * size))
        for k in range(0, len(whole), step):
            at = whole[k : k + step, None] + np.arange(size)
            yield at, at
    for start, size in zip(starts[~inner], sizes[~inner]):
        at = np.arange(start, start + size)
        one, two = at[own[at] == lo[start]], at[own[at] != lo[start]]
        if len(one) and len(two):
            yield one[None], two[None]


def whole_groups(batches: Iterator[pa.RecordBatch], done: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """done() of the groups of sorted batches, each group whole: the last one of a batch may go on in the next."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        starts = group_starts(t)
        last = starts[-1] if len(starts) else 0
        yield done(t.slice(0, last))
        rest = t.slice(last)
    if rest is not None:
        yield done(rest)


def close_rows(most: int):
    """(t, key, uid) of the rows that have another row of their bucket within `most` bits of the full code."""

    def done(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        near = np.zeros(len(t), bool)
        if len(t):
            codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint64).reshape(len(t), -1)
            for a, b in groups_of(t):
                close = sum(np.bitwise_count(codes[a][:, :, None, w] ^ codes[b][:, None, :, w]).astype(np.int16) for w in range(codes.shape[1])) <= most
                if a is b:
                    close[:, np.arange(a.shape[1]), np.arange(a.shape[1])] = False
                near[a[close.any(2)]] = True
                near[b[close.any(1)]] = True
        return pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[near]) for c in ("t", "key", "uid")], ["t", "key", "uid"])

    return lambda batches: whole_groups(batches, done)


def group_links(x: np.ndarray, y: np.ndarray, x_keys: np.ndarray, y_keys: np.ndarray, tables: np.ndarray, threshold: float) -> np.ndarray:
    """In each of some groups of equal shape (first axis), which rows of x link with which of y, leaving out pairs that met in a table before the group's."""
    linked = x @ y.swapaxes(1, 2) >= threshold
    g, a, b = np.nonzero(linked)
    met = ((x_keys[g, a] == y_keys[g, b]) & (np.arange(x_keys.shape[2]) < tables[g, None])).any(1)
    linked[g[met], a[met], b[met]] = False
    return linked


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In each group, for each row and each column the first row of its component; a column without a link gets the number of rows."""
    groups, n, _ = linked.shape
    rows = np.tile(np.arange(n), (groups, 1))
    while True:
        cols = np.where(linked, rows[:, :, None], n).min(1)
        new = np.minimum(rows, np.where(linked, cols[:, None, :], n).min(2))
        if (new == rows).all():
            return rows, cols
        rows = new


def compare_groups(t: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(uid, links, uid of its component's first row) of all linked rows of whole groups of vectors of one length, sorted by BY."""
    uid, copies, table = (t.column(c).to_numpy() for c in ("uid", "copies", "t"))
    x, keys = unit_rows(t.column("v").chunk(0)), t.column("keys").chunk(0).flatten().to_numpy().reshape(len(t), -1)
    for a, b in groups_of(t):
        linked = group_links(x[a], x[b], keys[a], keys[b], table[a[:, 0]], threshold)
        if a is b:
            size = a.shape[1]
            linked[:, np.arange(size), np.arange(size)] = False
            degree = (linked * copies[a][:, None, :]).sum(2)
            first = np.take_along_axis(uid[a], forest(linked | np.eye(size, dtype=bool))[0], 1)
            yield uid[a][degree > 0], degree[degree > 0], first[degree > 0]
        else:
            one, two, linked = a[0], b[0], linked[0]
            rows, cols = (f[0] for f in forest(linked[None]))
            for some, first, degree in ((one, rows, linked @ copies[two]), (two, cols, copies[one] @ linked)):
                have = degree > 0
                yield uid[some][have], degree[have], uid[one[first[have]]]


def links_map(threshold: float):
    def done(t: pa.Table) -> pa.RecordBatch:
        found = [(np.zeros(0, np.int64),) * 3]
        for _, some in by_length(t):
            found += compare_groups(some, threshold)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found)], ["uid", "n", "to"])

    return lambda batches: whole_groups(batches, done)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, recall: float = 0.96, sample: int = 4096, bucket: int = 64, block: int = 512, seed: int = 0) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Two vectors of one length link if they are equal, or are found and their cosine in double precision is at
    least `threshold`; n_links counts such others, component_id is the least id reachable (the own id without a
    link). Equal vectors are one class with a count, so exact copies cost nothing from there on.

    Found are vectors that share a key in one of the Hamming tables. Keys are bits of learned codes; their width
    follows from the number of vectors, so that buckets stay at about `bucket`, and the number of tables from
    that and from `recall`, the chance that a pair right at the threshold shares a key (see table_plan).
    In a bucket full codes are compared first: only vectors with another one within some bits (see far_apart)
    are fetched and compared, and count in the first table where they meet. A bucket over `block`
    classes is cut into blocks that meet pairwise in tasks of their own, and only each class's number of links
    and a spanning forest leave a task, so a large group of near copies costs no list of pairs.

    The rotations are learned, for each of the LEARNED most frequent lengths, on about `sample` distinct vectors
    drawn by a hash (what reaches the driver); those of rarer lengths are random. Every vector is indexed. Null
    vectors, empty and zero vectors and vectors with null or non-finite components have no link. Rows are vectors of
    their own, also where ids or whole rows repeat; a null id links and counts like others, a component without
    any id has a null component_id, and kept is whether both ids are equal, two nulls being so. An empty table
    gives no rows; other columns are neither read nor returned.
    """
    unlike = [F.xxhash64("v"), F.xxhash64(F.lit(seed), "v")]  # 128 bits name a vector
    vectors = usable(df, id_col, vec_col)
    distinct = vectors.where("v is not null").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes, _ = materialise(distinct.select(F.monotonically_increasing_id().alias("uid"), "least", "copies", unlike[0].alias("h1"), unlike[1].alias("h2"), "v"), "classes")
    lengths = classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LEARNED).collect()
    n = classes.count()
    if not n:
        return df.select(F.col(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    samples = {}
    for r in lengths:
        drawn = F.pmod(F.col("h1"), F.lit(1 << 30)) < max(1, int(min(1.0, sample / r.n) * (1 << 30)))
        rows = classes.where(F.size("v") == r.dim).where(drawn).select("h1", "h2", "v").collect()
        if rows:
            samples[r.dim] = unit_rows(pa.array([x.v for x in sorted(rows)]))
    means = {dim: x.mean(0) for dim, x in samples.items()}
    spreads = [s for s in (spread(x, means[dim]) for dim, x in samples.items()) if s >= 0.5]
    angle = angle_at(threshold, min([1.0, *spreads]))
    bits, tables = table_plan(n, angle, bucket, recall)
    planes = {dim: hyperplanes(dim, max(bits * tables, CODE_BITS), seed, x) for dim, x in samples.items()}
    item = df.schema[vec_col].dataType.elementType.simpleString()
    coded, _ = materialise(classes.select("uid", "copies", "v").mapInArrow(codes_map(planes, bits, tables, seed), f"uid long, copies long, v array<{item}>, keys array<long>, code binary"), "codes")

    near = in_blocks(coded.select("uid", F.posexplode("keys").alias("t", "key")), block, coded.select("uid", "code")).mapInArrow(close_rows(far_apart(angle)), "t int, key long, uid long")
    near, _ = materialise(near.distinct(), "near")
    links, _ = materialise(in_blocks(near, block, coded.drop("code")).mapInArrow(links_map(threshold), "uid long, n long, to long"), "links")
    found = components(links.select(F.col("uid").alias("a"), F.col("to").alias("b")))
    degrees = links.groupBy("uid").agg(F.sum("n").alias("n"))
    known = classes.drop("v").join(degrees, "uid", "left").join(found, F.col("uid") == found.node, "left").withColumn("root", F.coalesce("root", "uid"))
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(least, "root").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component")

    named = vectors.select("id", *[F.when(F.col("v").isNotNull(), h).alias(f"h{k}") for k, h in enumerate(unlike, 1)])
    out = named.join(known, ["h1", "h2"], "left").select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
