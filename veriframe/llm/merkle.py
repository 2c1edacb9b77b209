"""A Merkle manifest of a dataset: a tree of 16 children a node over each source's rows, and one over the sources' roots.

Rows are sorted by source and doc_id over ranges, so that a hot source lies in many tasks; counts of the ranges give each row its place. Aligned
blocks of ARITY ** HEIGHT leaves then go to tasks by source and block. A first pass reduces each block to its root; the roots are the
leaves of the next tier, until a source has one node. The way back starts at the tree over sources and goes down a tier at a
time: a block's rows are led by one row with the proof of the block's root (the upper proof), and a traversal of the block emits each
leaf's proof with that appended.

The traversal is the fractal one: the block's tree is a stack of subtrees of one level of 16 nodes. Per level the existing subtree
holds the siblings of the leaf at hand, while the desired one, which lies to its right, is built up a leaf a step; when the leaf passes
the end of the existing one, the desired one takes its place. Memory is 32 digests a level and what the building of
one subtree keeps, besides the block's leaves (4,096 digests).

Defined results: null columns are "-" in a leaf; rows of one source and doc_id stand in the order of their leaves, a null doc_id
first; a null source is one of its own, in front of the others; repeated rows are leaves each; an empty table gives no rows; only
the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, written

ARITY = 16
#: Levels of an aligned block.
HEIGHT = 3
#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "array<struct<a: string, b: string>>"
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def hashed(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels above n nodes: the root of one node is the node."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


class Subtree:
    """One level of a stack: up to ARITY nodes that are the children of one node, built from leaves that come one by one; of each lower
    level the run that isn't full is kept."""

    def __init__(self, level: int):
        self.level, self.nodes, self.open = level, [], [[] for _ in range(level)]

    def add(self, leaf: str, last: bool) -> None:
        """The next leaf; last: the block ends behind it, so runs that aren't full end too."""
        own, k = leaf, 0
        while k < self.level:
            self.open[k].append(own)
            if len(self.open[k]) < ARITY and not last:
                return
            own, self.open[k] = hashed(*self.open[k]), []
            k += 1
        self.nodes.append(own)


def proofs(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf, level by level, the siblings in front of it and behind it, as joined text.

    Level k has an existing subtree (children of one node, ARITY ** (k + 1) leaves) and the desired one behind it; each step
    gives the desired subtree of each level one leaf more, so it is whole when the existing one is left."""
    n, spans = len(leaves), [ARITY ** (k + 1) for k in range(levels)]
    existing, desired = [], []
    for k, span in enumerate(spans):
        first = Subtree(k)
        for i in range(min(span, n)):
            first.add(leaves[i], i + 1 == n)
        existing.append(first)
        desired.append(Subtree(k))
    for i in range(n):
        for k, span in enumerate(spans):
            if i and i % span == 0:
                existing[k], desired[k] = desired[k], Subtree(k)
        out = []
        for k in range(levels):
            at, nodes = i // ARITY**k % ARITY, existing[k].nodes
            out.append(("".join(nodes[:at]), "".join(nodes[at + 1 :])))
        yield out
        for k, span in enumerate(spans):
            if i + span < n:
                desired[k].add(leaves[i + span], i + span + 1 == n)


def folded(leaf: str, proof: list[tuple[str, str]]) -> str:
    for before, after in proof:
        leaf = hashed(before, leaf, after)
    return leaf


def block_root(leaves: list[str], levels: int) -> str:
    whole = Subtree(levels)
    for i, leaf in enumerate(leaves):
        whole.add(leaf, i + 1 == len(leaves))
    return whole.nodes[0]


def _levels(n: int, height: int) -> int:
    """Levels of a block in a group of n nodes: as many as these need where it is the group's only one."""
    return height if n > ARITY**height else levels_of(n)


def _value(column: Column) -> Column:
    """A column's part of a leaf."""
    text = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos (from 0) within their group, by order, and the group's n; group is a text and isn't null.

    Rows are sorted over ranges and written; each range's count of each group then gives where the range starts in it."""
    sorted_ = rows.repartitionByRange(group, *(F.col(c).asc_nulls_first() for c in order)).sortWithinPartitions(group, *(F.col(c).asc_nulls_first() for c in order))
    at = sorted_.schema.fieldNames().index(group)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k = None, 0
        for batch in batches:
            out = []
            for own in batch.column(at).to_pylist():
                now, k = own, k + 1 if own == now else 0
                out.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "k__"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema.fields)
    numbered = written(sorted_.withColumn("p__", F.spark_partition_id()).mapInArrow(number, f"{kinds}, p__ int, k__ long"), "sorted")
    ranges = numbered.groupBy(group, "p__").agg((F.max("k__") + 1).alias("c__"))
    before = Window.partitionBy(group).orderBy("p__").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(group, "p__", F.coalesce(F.sum("c__").over(before), F.lit(0)).alias("s__"), F.sum("c__").over(Window.partitionBy(group)).alias("n"))
    return numbered.join(starts, [group, "p__"]).withColumn("pos", F.col("s__") + F.col("k__")).drop("p__", "k__", "s__", "c__")


def _block(height: int) -> Column:
    return F.floor(F.col("pos") / ARITY**height).cast("long").alias("block")


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """Rows (tuples of the named columns, the first two key and block) of one block after the other; a block is bounded."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
            if held and held[0][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _roots(tier: DataFrame, height: int) -> DataFrame:
    """key, pos, n and digest of the blocks' roots of a tier (key, pos, n, digest): the next tier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ["key", "block", "n", "digest"]):
            key, block, n, _ = rows[0]
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([block], pa.int64()), pa.array([-(-n // ARITY**height)], pa.int64()), pa.array([block_root([r[3] for r in rows], _levels(n, height))])], names=["key", "pos", "n", "digest"])

    own = tier.select("key", _block(height), "pos", "n", "digest").repartition("key", "block").sortWithinPartitions("key", "block", "pos")
    return own.mapInArrow(run, "key string, pos long, n long, digest string")


def tiers_of(leaves: DataFrame, height: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """The tiers above leaves (key, pos, n, digest), leaves first, and key and digest of each group's root."""
    tiers = [leaves]
    while True:
        up = written(_roots(tiers[-1], height), "tier")
        if (up.agg(F.max("n")).first()[0] or 1) <= 1:
            return tiers, up.select("key", "digest")
        tiers.append(up)


def _led(tier: DataFrame, upper: DataFrame, columns: str, height: int) -> DataFrame:
    """Blocks of a tier, each led by the row of its upper proof (key, pos of the block, upper, subroot) with pos -1."""
    fill = [F.lit(None).cast(f.dataType).alias(f.name) for f in tier.schema.fields if f.name in columns.split()]
    heads = upper.select("key", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"), *fill, "upper", "subroot")
    own = tier.select("key", _block(height), "pos", "n", *columns.split(), F.lit(None).cast(_UPPER).alias("upper"), F.lit(None).cast("string").alias("subroot"))
    return own.unionByName(heads).repartition("key", "block").sortWithinPartitions("key", "block", "pos")


def _inner(tier: DataFrame, upper: DataFrame, height: int) -> DataFrame:
    """Upper proofs of a tier's nodes, from those of its blocks' roots: key, pos, upper, subroot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *rows in _runs(batches, ["key", "block", "pos", "n", "digest", "upper", "subroot"]):
            above = [(x["a"], x["b"]) for x in head[5]]
            own = proofs([r[4] for r in rows], _levels(rows[0][3], height))
            for k in range(0, len(rows), ARITY * ARITY):  # a batch a subtree of two levels, as proofs are long
                step = rows[k : k + ARITY * ARITY]
                listed = pa.array([[{"a": a, "b": b} for a, b in next(own) + above] for _ in step], pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())])))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in step]), pa.array([r[2] for r in step], pa.int64()), listed, pa.array([head[6]] * len(step), pa.string())], names=["key", "pos", "upper", "subroot"])

    return _led(tier, upper, "digest", height).mapInArrow(run, f"key string, pos long, upper {_UPPER}, subroot string")


def merkle_manifest(df: DataFrame, columns: tuple[str, ...] = COLUMNS, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    columns: doc_id, source, others and the text, in the order of a leaf; height: levels of an aligned block. Rows whose doc_id's CRC-32 is divisible by five are
    tampered with: their text's A-Z is lower-cased before the root is folded from it."""
    spark = df.sparkSession
    bounded(spark)
    ident, source, text = columns[0], columns[1], columns[-1]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fixed = [_value(df[c]) for c in columns[:-1]]
    tampered = (F.crc32(df[ident].cast("string")) % 5 == 0) & df[text].isNotNull()
    leaf = F.sha2(F.concat(*fixed, _value(df[text])), 256)
    changed = F.when(tampered, F.sha2(F.concat(*fixed, _value(F.translate(df[text].cast("string"), upper, lower))), 256))
    digests = written(df.select(df[ident].cast("long").alias("doc_id"), df[source].cast("string").alias("source"), _value(df[source]).alias("key"), leaf.alias("digest"), changed.alias("changed")), "leaves")
    placed = written(positions(digests.drop("source"), "key", ["doc_id", "digest"]), "placed")
    tiers, subroots = tiers_of(placed, height)
    named = digests.select("source", "key").distinct().join(subroots, "key").select(F.lit("").alias("key"), "source", F.col("key").alias("own"), "digest")
    sources = written(positions(named, "key", ["source"]), "sources")
    over, top = tiers_of(sources, height)
    first = top.first()
    root = first["digest"] if first else None
    none = F.array().cast(_UPPER)
    proofs_ = top.select("key", F.lit(0).cast("long").alias("pos"), none.alias("upper"), F.lit(None).cast("string").alias("subroot"))
    for tier in reversed(over):
        proofs_ = _inner(tier, proofs_, height)
    proofs_ = sources.select("pos", "own", F.col("digest").alias("subroot")).join(proofs_.select("pos", "upper"), "pos").select(F.col("own").alias("key"), F.lit(0).cast("long").alias("pos"), "upper", "subroot")
    for tier in reversed(tiers[1:]):
        proofs_ = _inner(tier, proofs_, height)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *rows in _runs(batches, ["key", "block", "pos", "n", "doc_id", "digest", "changed", "upper", "subroot"]):
            above, out = [(x["a"], x["b"]) for x in head[7]], []
            rest = "".join(a + b for a, b in above)
            for row, own in zip(rows, proofs([r[5] for r in rows], _levels(rows[0][3], height))):
                back = folded(row[6] or row[5], own + above)
                out.append((row[4], row[5], head[8], root, hashed(*(a + b for a, b in own), rest), back, back == root))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), *[pa.string()] * 5, pa.bool_()])], names=names)

    return _led(placed, proofs_, "doc_id digest changed", height).mapInArrow(run, SCHEMA)
