"""Merkle dataset manifest: every few levels are kept; proofs work the levels between out again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarazu.llm.common import materialise

#: Nodes that become one, and levels from one kept level to the next: a subtree between two of them has at most RUN ** LEVELS nodes below.
RUN, LEVELS = 3, 4
#: What a leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROW = (1 << 33) - 1  # monotonically_increasing_id() counts a partition's rows in its lower 33 bits


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of the fields: `-` for a null, else the length in UTF-8 bytes, `:` and the value."""
    said = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (f.cast("string") for f in fields)]
    return digest(*said)


def tree_name(source: Column) -> Column:
    """A tree's name: never null, and in the order of sources (null first, then by bytes)."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def ranked(rows: DataFrame, tree: str, by: list[str], what: str) -> DataFrame:
    """rows with pos (from 0 in their tree, in the order of `by`, nulls first) and n (the tree's rows), written to the shared folder.

    Rows are sorted by ranges, so a tree with most rows spreads over many tasks. A row's place is its place in its
    task's part of the tree plus the rows that earlier tasks hold of it; only a count for each task and tree moves for that.
    """
    spark = rows.sparkSession
    order = [F.col(c).asc_nulls_first() for c in (tree, *by)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt, _ = materialise(dealt.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit(_ROW))), what)
    held = dealt.groupBy(tree, "part").agg(F.count("*").alias("m"), F.min("at").alias("first"))
    before = W.partitionBy(tree).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    held = held.withColumns({"shift": F.coalesce(F.sum("m").over(before), F.lit(0)) - F.col("first"), "n": F.sum("m").over(W.partitionBy(tree))})
    return dealt.join(held.drop("m", "first"), [tree, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _runs(level: Column) -> Column:
    """The level above: every RUN consecutive digests become one."""
    return F.when(F.size(level) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / RUN).cast("int")), lambda k: F.sha2(F.array_join(F.slice(level, k * RUN + 1, RUN), ""), 256))).otherwise(F.array().cast("array<string>"))


def _subtrees(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """(tree, pos, n, steps, kids, l0 … l<LEVELS>): the aligned subtrees over a kept level, kids being its nodes in order and l<k> the digests k levels above them.

    steps: levels that are really there, fewer than LEVELS where the tree ends.
    """
    width = RUN**LEVELS
    kid = F.struct("pos", "h", *extra)
    out = nodes.groupBy("tree", F.floor(F.col("pos") / width).alias("up")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(kid)).alias("kids"))
    powers = F.array(*[F.lit(RUN**k) for k in range(LEVELS)])
    out = out.withColumn("steps", F.size(F.filter(powers, lambda p: p < F.col("n")))).withColumn("l0", F.col("kids.h"))
    for k in range(LEVELS):
        out = out.withColumn(f"l{k + 1}", F.when(F.col("steps") > k, _runs(F.col(f"l{k}"))))
    return out.withColumnRenamed("up", "pos")


@dataclass
class Tree:
    """Kept levels of a forest of trees, the lowest first: (tree, pos, n, h), the lowest also with its own columns; the last holds each tree's root."""

    levels: list[DataFrame]
    extra: list[str]

    @property
    def roots(self) -> DataFrame:
        return self.levels[-1].select("tree", "h")


def build(nodes: DataFrame, extra: list[str]) -> Tree:
    """The forest over nodes (tree, pos, n, h, and the columns named in extra). Only each LEVELS-th level is written, to the shared folder."""
    tree = Tree([nodes], extra)
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        low = _subtrees(tree.levels[-1], extra if len(tree.levels) == 1 else [])
        root = F.coalesce(*[F.get(F.col(f"l{k}"), F.lit(0)) for k in range(LEVELS, -1, -1)])
        up = low.select("tree", "pos", F.ceil(F.col("n") / RUN**LEVELS).alias("n"), root.alias("h"))
        tree.levels.append(materialise(up, "merkle")[0])
        most = -(-most // RUN**LEVELS)
    return tree


def proofs(tree: Tree, tops: DataFrame) -> DataFrame:
    """(tree, pos, h, the extra columns, proof, and the columns of tops): each lowest node with its siblings, level by level.

    tops has a row for each tree: tree, proof (what follows above the tree's root), and what all its nodes get. A proof is
    an array of (left, right), a run's digests before and after the node's own. From the highest kept level down, each
    subtree's levels are worked out from its kept nodes, their siblings go to those nodes and nothing else of them is kept.
    """
    handed = [c for c in tops.columns if c not in ("tree", "proof")]
    above = tops.withColumn("pos", F.lit(0).cast("long"))
    for k in range(len(tree.levels) - 2, -1, -1):
        extra = tree.extra if k == 0 else []
        low = _subtrees(tree.levels[k], extra).join(above.select("tree", "pos", "proof", *handed), ["tree", "pos"])

        def siblings(i: Column, k: int) -> Column:
            level, at = F.col(f"l{k}"), F.floor(i / RUN**k).cast("int")
            first = at - at % RUN
            left, right = F.slice(level, first + 1, at % RUN), F.slice(level, at + 2, RUN - 1 - at % RUN)
            return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

        def climbed(kid: Column, i: Column) -> Column:
            own = F.filter(F.array(*[F.when(F.col("steps") > k, siblings(i, k)) for k in range(LEVELS)]), lambda s: s.isNotNull())
            return F.struct(kid.alias("kid"), F.concat(own, F.col("proof")).alias("proof"))

        out = low.select("tree", *handed, F.explode(F.transform("kids", climbed)).alias("x"))
        above = out.select("tree", "x.kid.pos", "x.kid.h", *[F.col(f"x.kid.{c}") for c in extra], "x.proof", *handed)
        if k:
            above, _ = materialise(above, "proofs")
    return above if len(tree.levels) > 1 else tree.levels[0].join(above.drop("pos"), "tree")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, source, leaf, checked, subroot, root, proof): a row for each of docs.

    A leaf is the digest of the fields; per source, leaves ascend by id (nulls first; equal ids by leaf, equal rows side by side)
    and every RUN consecutive nodes become one until one remains; the sources' roots, null first and then by bytes, likewise.
    proof: the siblings up to root as (left, right). checked: the leaf with `tampered` in place of the text, or leaf itself.
    Null fields are `-`, empty ones `0:`; long texts count whole; columns beside the fields are ignored, whatever their names. An empty table gives no rows.
    """
    own = {f: F.col(f"`{f}`") for f in fields}
    now = docs.select(own[id_col].alias("doc_id"), own[source_col].alias("source"), tree_name(own[source_col]).alias("tree"), leaf_digest(*own.values()).alias("h"), *([] if tampered is None else [leaf_digest(*[tampered if f == "text" else c for f, c in own.items()]).alias("checked")]))
    now = now if tampered is not None else now.withColumn("checked", F.col("h"))
    leaves, _ = materialise(now.withColumn("row", F.monotonically_increasing_id()), "leaves")
    extra = ["doc_id", "source", "checked"]
    low = build(ranked(leaves, "tree", ["doc_id", "h", "row"], "ranked").drop("row"), extra)
    sources = low.roots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "h")
    high = build(ranked(sources, "tree", ["name"], "sources"), ["name"])
    top = high.roots.select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("proof"), F.col("h").alias("root"))
    tops = proofs(high, top).select(F.col("name").alias("tree"), "proof", F.col("h").alias("subroot"), "root")
    out = proofs(low, materialise(tops, "tops")[0])
    return out.select("doc_id", "source", F.col("h").alias("leaf"), "checked", "subroot", "root", "proof")
