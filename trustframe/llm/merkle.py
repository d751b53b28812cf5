"""Merkle manifest of a dataset: content-addressed records and inclusion proofs.

Leaf: ``H`` (SHA-256 of the concatenated inputs, digests as hex text) of the
row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and value.
The leaves of one tree (a source) ascend by id; ``ARITY`` consecutive nodes
become their H, a short last run too, until one node, the subroot, is left.
The subroots by name (null first, then UTF-8 bytes) form the upper tree in the
same way, its last node is the root.

Store: every inner node is a record (digest -> children digests).  The records
of ``DEPTH`` levels over ``ARITY ** DEPTH`` consecutive nodes are kept in one
pack, found by the digest of its topmost node; a pack is bounded, and a tree of
n leaves needs log(n) / DEPTH rounds of one shuffle of digests each.

Descent: a request starts at the root and follows the base-``ARITY`` digits of
its rank through the records; at each level the children it does not select
are collected.  Requests below one pack arrive together.  The collected
segments, reversed, are the proof from leaf to root, and a claimed leaf is
folded upwards through them.

Ranks come from range partitions and running counts over them, so no source
is sorted in one task; texts are hashed where they are read and never move.
An empty table gives an empty manifest.  Repeated rows are leaves of their
own; equal ids order by leaf digest.  Null ids come first in their source.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded_batches, written

ARITY = 3
DEPTH = 6
SPAN = ARITY ** DEPTH
UPPER = ""                         # tree name of the upper tree; no encoded source is empty


def encoded(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(
        F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*fields: Column) -> Column:
    """Binary SHA-256 of the encoded fields."""
    return F.unhex(F.sha2(F.concat(*(encoded(f) for f in fields)), 256))


def hashed(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def depth(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    levels, reach = 0, 1
    while reach < n:
        levels, reach = levels + 1, reach * ARITY
    return levels


def _depth_col(n: Column) -> Column:
    """``depth`` of a long column: how many powers of the arity are below it."""
    powers = F.array(*(F.lit(ARITY ** i) for i in range(40) if ARITY ** i < 1 << 62))
    return F.size(F.filter(powers, lambda p: p < n))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (column ``tree``) plus ``idx``, the rank in its tree, and ``n``, the tree's size."""
    bounded_batches(rows.sparkSession)
    salt = rows.withColumn("__s", F.monotonically_increasing_id())    # splits repeated rows
    keys = [F.col("tree"), *(F.col(c).asc_nulls_first() for c in order), F.col("__s")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = salt.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__s")
    at = ranged.columns.index("tree")
    schema = T.StructType([*ranged.schema.fields, T.StructField("part", T.LongType()),
                           T.StructField("place", T.LongType())])
    columns = schema.names

    def number(batches):
        from pyspark import TaskContext

        part, tree, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            names = batch.column(at).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(names[1:] != names[:-1]) + 1
            place = np.empty(len(names), np.int64)
            for a, b in zip([0, *cut], [*cut, len(names)]):
                if a == b:
                    continue
                if names[a] != tree:
                    tree, done = names[a], 0
                place[a:b] = np.arange(done, done + b - a)
                done += b - a
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(names), part)), pa.array(place)],
                names=columns)

    placed = written(ranged.mapInArrow(number, schema), "placed")
    held = placed.groupBy("part", "tree").agg(F.count("*").alias("rows"))
    of_tree = Window.partitionBy("tree")                               # a row per partition
    before = of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = held.select("part", "tree", F.sum("rows").over(of_tree).alias("n"),
                         F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    return (placed.join(offset, ["part", "tree"])
                  .withColumn("idx", F.col("offset") + F.col("place"))
                  .drop("part", "place", "offset"))


_DIGESTS = T.ArrayType(T.BinaryType(), False)
_RECORDS = T.ArrayType(T.StructType([T.StructField("digest", T.BinaryType()),
                                     T.StructField("children", _DIGESTS)]), False)


def _records(nodes: list[bytes], levels: int) -> tuple[bytes, list[tuple]]:
    """Topmost digest and the records of ``levels`` levels above ``nodes``."""
    records = {}
    for _ in range(levels):
        runs = [nodes[i:i + ARITY] for i in range(0, len(nodes), ARITY)]
        nodes = [hashed(run) for run in runs]
        records.update(zip(nodes, runs))
    return nodes[0], list(records.items())


def _packs(nodes: DataFrame, level: int) -> DataFrame:
    """Packs over the nodes (tree, n, idx, digest, item) of one level, one row per pack."""
    blocks = (nodes.groupBy("tree", "n", F.expr(f"idx div {SPAN}").alias("block"))
                   .agg(F.sort_array(F.collect_list(F.struct("idx", "digest", "item"))).alias("l"))
                   .select("tree", "n", "block", F.col("l.digest").alias("nodes"),
                           F.col("l.item").alias("items")))
    schema = T.StructType([*(f for f in blocks.schema.fields if f.name != "nodes"),
                           T.StructField("top", T.BinaryType()),
                           T.StructField("records", _RECORDS)])
    columns = schema.names
    record_type = pa.list_(pa.struct([("digest", pa.binary()),
                                      ("children", pa.list_(pa.binary()))]))

    def build(batches):
        for batch in batches:
            made = [_records(nodes, max(0, min(DEPTH, depth(n) - level))) for nodes, n in
                    zip(batch.column("nodes").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns[:-2]]
                + [pa.array([t for t, _ in made], pa.binary()),
                   pa.array([[{"digest": d, "children": c} for d, c in r] for _, r in made],
                            record_type)], names=columns)

    return blocks.mapInArrow(build, schema)


def _segment(digit: int, children: list[bytes]) -> bytes:
    """One step of a path: the digit, how many siblings, the siblings."""
    others = children[:digit] + children[digit + 1:]
    return bytes((digit, len(others))) + b"".join(others)


def _segments(path: bytes) -> list[tuple[int, list[bytes]]]:
    out, at = [], 0
    while at < len(path):
        stop = at + 2 + 32 * path[at + 1]
        out.append((path[at], [path[i:i + 32] for i in range(at + 2, stop, 32)]))
        at = stop
    return out


def descend(top: bytes, records: dict[bytes, list[bytes]], rank: int,
            levels: int) -> tuple[bytes, bytes]:
    """(path, digest) of the node ``levels`` below ``top`` that the digits of ``rank`` select."""
    path = b""
    for j in range(levels - 1, -1, -1):
        digit = rank // ARITY ** j % ARITY
        children = records[top]
        path += _segment(digit, children)
        top = children[digit]
    return path, top


def folded(claim: bytes, path: bytes) -> tuple[bytes, bytes]:
    """(H of the siblings from leaf to root, root recomputed from ``claim``)."""
    siblings = []
    for digit, others in reversed(_segments(path)):
        siblings += others
        claim = hashed([*others[:digit], claim, *others[digit:]])
    return hashed(siblings), claim


def _arrived(frontier: DataFrame, packs: DataFrame, level: int) -> DataFrame:
    """One row per node below the packs: tree, n, root, subroot, idx, digest, path, item.

    ``frontier``: tree, n, block, top (a digest), path, root, subroot.
    """
    met = frontier.join(packs.drop("n"), ["tree", "block", "top"])
    item = next(f for f in packs.schema.fields if f.name == "items").dataType.elementType
    kept = ["tree", "n", "root", "subroot"]
    met = met.select(*kept, "block", "top", "path", "items", "records")
    schema = T.StructType([*(met.schema[c] for c in kept), T.StructField("idx", T.LongType()),
                           T.StructField("digest", T.BinaryType()),
                           T.StructField("path", T.BinaryType()), T.StructField("item", item)])

    columns = schema.names

    def walk(batches):
        for batch in batches:
            col = {c: batch.column(c) for c in batch.schema.names}
            for row in range(batch.num_rows):
                n, block, top, path = (col[c][row].as_py() for c in ("n", "block", "top", "path"))
                records = {r["digest"]: r["children"] for r in col["records"][row].as_py()}
                levels = max(0, min(DEPTH, depth(n) - level))
                items = col["items"][row].values
                got = [descend(top, records, rank, levels) for rank in range(len(items))]
                same = [pa.array([col[c][row].as_py()] * len(items), batch.schema.field(c).type)
                        for c in kept]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(np.arange(len(items)) + block * SPAN),
                     pa.array([d for _, d in got], pa.binary()),
                     pa.array([path + p for p, _ in got], pa.binary()), items],
                    names=columns)

    return met.mapInArrow(walk, schema)


@dataclass
class Trees:
    """Trees built over ranked nodes: ``packs[r]`` covers the r-th ``DEPTH`` levels."""
    packs: list[DataFrame] = field(default_factory=list)
    tops: DataFrame | None = None           # tree, n, top


def build(nodes: DataFrame, largest: int) -> Trees:
    """Trees over ``nodes`` (tree, n, idx, digest, item); ``largest`` is the largest n."""
    out = Trees()
    rounds = max(1, -(-depth(largest) // DEPTH))
    for r in range(rounds):
        packs = written(_packs(nodes, r * DEPTH), "packs")
        out.packs.append(packs)
        ends = _depth_col(F.col("n")) <= (r + 1) * DEPTH
        done = packs.where(ends).select("tree", "n", "top")
        out.tops = done if out.tops is None else out.tops.unionByName(done)
        nodes = packs.where(~ends).select("tree", "n", F.col("block").alias("idx"),
                                          F.col("top").alias("digest"),
                                          F.lit(None).cast("int").alias("item"))
    return out


def requested(trees: Trees, starts: DataFrame) -> DataFrame:
    """Every leaf of the trees with its path; ``starts``: tree, n, top, path, root, subroot."""
    first = F.greatest(F.ceil(_depth_col(F.col("n")) / DEPTH), F.lit(1)) - 1   # topmost round
    arrived = None
    for r in range(len(trees.packs) - 1, -1, -1):
        frontier = starts.where(first == r).withColumn("block", F.lit(0).cast("long"))
        if arrived is not None:
            below = arrived.select("tree", "n", F.col("digest").alias("top"), "path", "root",
                                   "subroot", F.col("idx").alias("block"))
            frontier = frontier.unionByName(below)
        arrived = _arrived(frontier, trees.packs[r], r * DEPTH)
        if r:
            arrived = written(arrived, "paths")
    return arrived


def _name(tree: Column) -> Column:
    """The source of an encoded tree name."""
    return F.when(tree != "-", F.substring(tree, F.instr(tree, F.lit(":")) + 1, F.length(tree)))


@dataclass
class Manifest:
    lower: Trees
    upper: Trees

    def subroots(self) -> DataFrame:
        """source, leaves, subroot (hex)."""
        return self.lower.tops.select(_name(F.col("tree")).alias("source"),
                                      F.col("n").alias("leaves"),
                                      F.lower(F.hex("top")).alias("subroot"))

    def root(self) -> DataFrame:
        """One row, the root in hex; none for an empty dataset."""
        return self.upper.tops.select(F.lower(F.hex("top")).alias("root"))

    def records(self) -> DataFrame:
        """The store: digest -> children, in hex, each inner node once."""
        every = None
        for packs in (*self.lower.packs, *self.upper.packs):
            some = packs.select(F.explode("records").alias("r"))
            every = some if every is None else every.unionByName(some)
        return (every.select(F.lower(F.hex("r.digest")).alias("digest"),
                             F.transform("r.children", lambda c: F.lower(F.hex(c))).alias("children"))
                     .dropDuplicates(["digest"]))

    def paths(self) -> DataFrame:
        """tree, idx, digest, path, subroot, root and the caller's ``item`` of every leaf."""
        top = self.upper.tops.select(
            "tree", "n", "top", F.lit(b"").alias("path"), F.col("top").alias("root"),
            F.lit(None).cast("binary").alias("subroot"))
        at = written(requested(self.upper, top), "upper")
        starts = at.select("item.tree", "item.n", F.col("digest").alias("top"), "path", "root",
                           F.col("digest").alias("subroot"))
        return requested(self.lower, starts)


def manifest(leaves: DataFrame, order: list[str]) -> Manifest:
    """Manifest of ``leaves``: source, digest (binary), item (what the caller wants back).

    ``order`` names the columns that order the leaves of a source; ties go by digest.
    """
    rows = leaves.select(encoded(F.col("source")).alias("tree"), "digest", "item", *order)
    ranked = _numbered(rows, [*order, "digest"]).drop(*order)
    lower = _grown(ranked)
    names = lower.tops.select(
        F.lit(UPPER).alias("tree"), _name(F.col("tree")).alias("source"),
        F.col("top").alias("digest"), F.struct("tree", "n").alias("item"))
    return Manifest(lower, _grown(_numbered(names, ["source"]).drop("source")))


def _grown(nodes: DataFrame) -> Trees:
    nodes = written(nodes, "ranked")
    return build(nodes, nodes.agg(F.max("n")).first()[0] or 0)


def verified(docs: DataFrame, fields: list[str], source: str, doc_id: str,
             claims: dict[str, Column]) -> DataFrame:
    """Inclusion proof of every row, checked against a claimed version of the row.

    ``claims`` maps field names to the claimed values (the row's own where
    absent).  Gives doc_id, leaf, subroot, root, proof_sha256 (of the siblings
    from leaf to root), folded_root (recomputed from the claim) and verified.
    """
    item = F.struct(F.col(doc_id).alias("id"),
                    digest(*(claims.get(f, F.col(f)) for f in fields)).alias("claim"))
    leaves = written(docs.select(F.col(source).alias("source"), F.col(doc_id).alias("doc_id"),
                                 digest(*(F.col(f) for f in fields)).alias("digest"),
                                 item.alias("item")), "leaves")
    paths = manifest(leaves, ["doc_id"]).paths()
    schema = T.StructType([T.StructField("doc_id", leaves.schema["doc_id"].dataType), *(
        T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256",
                                                   "folded_root")),
        T.StructField("verified", T.BooleanType())])

    def fold(batches):
        for batch in batches:
            items = batch.column("item")
            claim, path, leaf, subroot, root = (c.to_pylist() for c in (
                items.field("claim"), *map(batch.column, ("path", "digest", "subroot", "root"))))
            done = [folded(*x) for x in zip(claim, path)]
            texts = [[x.hex() for x in c] for c in (leaf, subroot, root, [p for p, _ in done],
                                                    [f for _, f in done])]
            yield pa.RecordBatch.from_arrays(
                [items.field("id"), *(pa.array(t, pa.string()) for t in texts),
                 pa.array([f == r for (_, f), r in zip(done, root)])], names=schema.names)

    return paths.select("digest", "path", "subroot", "root", "item").mapInArrow(fold, schema)
