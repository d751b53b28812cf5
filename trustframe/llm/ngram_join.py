"""Jaccard join of word n-gram sets through PartEnum signatures.

A document's set: the distinct 3-word shingles of its words (A-Z lower-cased,
runs of anything but ASCII white space); fewer words form one shingle.  Null,
empty and blank texts have no set and are linked with nothing.  Two sets link
when ``100 * intersection >= NUM * union``, that is when they differ in at most
(n + m) * (100 - NUM) / (100 + NUM) elements.

Signatures: sizes fall into bands such that linked sets are in one band or in
neighbouring ones.  Instance j joins the bands j - 1 and j, whose largest size
bounds the difference by k.  It cuts the domain of shingles (64-bit hashes)
into k // (DIFFER + 1) + 1 partitions of ``PARTS`` parts: in at least one
partition, linked sets differ in at most ``DIFFER`` parts and thus agree on one
of the enumerated subsets of ``PARTS - DIFFER`` parts.  A signature is the
digest of a set's shingles in such a subset.  Where k is 0 only equal sets
link, and those are one node already.

Candidates, the same way for every size of a posting:

1. each member of a posting meets the smallest member; verified links are
   contracted to components;
2. postings whose members are now in one component are done.  The others are
   cut into blocks of at most ``BLOCK`` members by hash, and block pairs are
   compared where they lie: members of different components whose parts differ
   in no more places than the sizes allow become candidates.

Every candidate is verified on the whole shingle sets, so components are exact.
Equal sets are one node, by a 128-bit digest.  The ids of needed texts are
broadcast only if counted to be few.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import append_columns, bounded_batches, salted_lookup, written
from .components import components

SHINGLE = 3
NUM, DEN = 90, 100
PARTS, DIFFER = 3, 1
BLOCK = 2048
BROADCAST_IDS = 2_000_000
PLACES = 1 << 15              # a signature holds its place modulo this
_SUBSETS = list(combinations(range(PARTS), PARTS - DIFFER))
# odd multipliers of the shingle hash
_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD]


def _spread(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number depends on all its bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(_MIX[3])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one UTF-8 text."""
    words = text.lower().split()           # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    mixed = sum(each[i:len(each) - n + 1 + i] * np.uint64(_MIX[i]) for i in range(n))
    return np.unique(_spread(mixed + np.uint64(n)))


@lru_cache(maxsize=8)
def bands(upto: int) -> tuple[list[int], list[int]]:
    """First and last size of every band that starts at ``upto`` or below, and of one more."""
    first, last = [], []
    size = 1
    while True:
        first.append(size)
        last.append(size * DEN // NUM)
        if size > upto:
            return first, last
        size = last[-1] + 1


def differences(n: int, m: int) -> int:
    """How many elements linked sets of these sizes may differ in."""
    return (n + m) * (DEN - NUM) // (DEN + NUM)


@lru_cache(maxsize=1 << 16)
def instances(size: int) -> tuple[int, int, int]:
    """Band of a size, and the number of parts in its instances band and band + 1 (0: no signature)."""
    first, last = bands(max(1024, 1 << size.bit_length()))
    band = bisect_right(first, size) - 1
    allowed = (differences(last[j], last[j]) for j in (band, band + 1))
    return band, *(PARTS * (k // (DIFFER + 1) + 1) if k else 0 for k in allowed)


def part_digests(hashes: np.ndarray, n_parts: int) -> np.ndarray:
    """32-bit digest of the hashes in each part of the domain; sorted hashes, equal ranges."""
    part = ((hashes >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
    edge = np.searchsorted(part, np.arange(n_parts + 1, dtype=np.uint64))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)))
    return (_spread(total[edge[1:]] - total[edge[:-1]]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sets(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` plus n_shingles, set_id (null without shingles), band and parts of both instances."""
    def rows(texts):
        out = []
        for t in texts:
            h = shingles(t)
            if not len(h):
                out.append((0, None, None, None, None))
                continue
            band, low, high = instances(len(h))
            out.append((len(h), xxhash.xxh128_digest(h.tobytes()), band,
                        part_digests(h, low) if low else [], part_digests(h, high) if high else []))
        return zip(*out)

    ints = T.ArrayType(T.IntegerType(), False)
    return append_columns(docs, keep, text, [
        T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()),
        T.StructField("band", T.IntegerType()), T.StructField("low", ints),
        T.StructField("high", ints)], rows)


def _signatures(parts: Column, instance: Column) -> Column:
    """Signatures of one instance: a hash, the place in this list (``PLACES``), the instance's lowest bit."""
    def of(i: Column) -> Column:
        return F.array(*(F.xxhash64(instance, i, F.lit(o), *(F.get(parts, i * PARTS + p) for p in s))
                         for o, s in enumerate(_SUBSETS)))

    every = F.flatten(F.transform(
        F.sequence(F.lit(0), F.floor(F.size(parts) / PARTS).cast("int") - 1), of))
    bit = instance.bitwiseAND(F.lit(1)).cast("long")
    marked = F.transform(every, lambda s, i: F.shiftleft(F.shiftright(s, 16), 16).bitwiseOR(
        F.shiftleft(i.bitwiseAND(F.lit(PLACES - 1)).cast("long"), 1)).bitwiseOR(bit))
    return F.when(F.size(parts) > 0, marked).otherwise(F.array().cast("array<bigint>"))


def postings(rows: DataFrame) -> DataFrame:
    """sig, node, pivot (the smallest node) and n of every signature that several nodes share."""
    index = rows.select("node", F.explode(F.concat(
        _signatures(F.col("low"), F.col("band")),
        _signatures(F.col("high"), F.col("band") + 1))).alias("sig"))
    shared = Window.partitionBy("sig")
    return (index.withColumn("n", F.count("*").over(shared))
                 .withColumn("pivot", F.min("node").over(shared)).where("n > 1"))


def _only(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` of the given distinct nodes, where they lie if the nodes are counted to be few."""
    nodes = written(nodes, "needed")
    few = nodes.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(nodes) if few else nodes, "node", "left_semi")


def _parts_of(sig: Column, band: Column, low: Column, high: Column) -> Column:
    """The parts a set has in the instance of a signature."""
    same = sig.bitwiseAND(F.lit(1)) == band.bitwiseAND(F.lit(1)).cast("long")
    return F.when(same, low).otherwise(high)


def _allowed(n: Column, m: Column) -> Column:
    return F.floor((n + m) * (DEN - NUM) / (DEN + NUM))


def _star_pairs(shared: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b) of members and smallest members that can link by their sizes and parts."""
    pairs = (shared.where("node <> pivot").groupBy(F.col("node").alias("a"), "pivot")
                   .agg(F.min("sig").alias("sig")))
    pairs = written(pairs, "met")
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("pivot")).distinct()
    side = _only(rows, need).select("node", "n_shingles", "band", "low", "high")
    a = side.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"),
                    F.struct("band", "low", "high").alias("pa"))
    b = side.select(F.col("node").alias("pivot"), F.col("n_shingles").alias("nb"),
                    F.struct("band", "low", "high").alias("pb"))
    met = pairs.join(a, "a").join(b, "pivot")        # a smallest member may be hot: AQE splits it
    mine, other = (_parts_of(F.col("sig"), *(F.col(f"{p}.{c}") for c in ("band", "low", "high")))
                   for p in ("pa", "pb"))
    differing = F.size(F.filter(F.zip_with(mine, other, lambda x, y: x != y), lambda d: d))
    return met.where(differing <= _allowed(F.col("na"), F.col("nb"))).select(
        "a", F.col("pivot").alias("b"))


def _block_pairs(members: DataFrame) -> DataFrame:
    """(a, b) of members of one posting, different roots, whose parts differ little enough.

    ``members``: sig, n, pivot, high (whether the set is in the instance's lower
    band), node, root, size, parts.
    A pair comes once, from the first signature it shares in the higher of its
    bands' instances, and not with the pivot, which it has met.
    """
    bounded_batches(members.sparkSession)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = (members.where("node <> pivot")
                     .withColumn("mine", F.pmod(F.xxhash64("node"), blocks).cast("int"))
                     .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
                     .select("sig", F.least("mine", "other").alias("i"),
                             F.greatest("mine", "other").alias("j"), "mine", "high", "node", "root",
                             "size", "parts"))
    key = ["sig", "i", "j"]

    def near(rows: pa.Table):
        node, root, size, mine = (rows.column(c).to_numpy() for c in ("node", "root", "size", "mine"))
        place = rows.column("sig")[0].as_py() >> 1 & PLACES - 1
        high = np.array(rows.column("high").to_pylist(), bool)
        apart = rows.column("i")[0] != rows.column("j")[0]
        parts = rows.column("parts").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        for x in range(len(node) - 1):
            later = slice(x + 1, None)
            fits = (root[later] != root[x]) & ~(high[later] & high[x])
            if apart:
                fits &= mine[later] != mine[x]
            at = np.flatnonzero(fits) + x + 1
            same = parts[at] == parts[x]
            few = (~same).sum(axis=1) <= (size[at] + size[x]) * (DEN - NUM) // (DEN + NUM)
            at, same = at[few], same[few].reshape(few.sum(), parts.shape[1] // PARTS, PARTS)
            if len(at):
                agree = np.stack([same[:, :, list(s)].all(axis=2) for s in _SUBSETS], axis=2)
                hits = node[at[agree.reshape(len(at), -1).argmax(axis=1) % PLACES == place]]
                if len(hits):
                    yield np.minimum(hits, node[x]), np.maximum(hits, node[x])

    def run(batches):
        held = []
        for batch in (*batches, None):
            if batch is not None:
                held.append(pa.Table.from_batches([batch]))
            if not held:
                return
            rows = pa.concat_tables(held)
            keys = np.stack([rows.column(c).to_numpy() for c in key], axis=1)
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
            if batch is None:
                cut.append(len(keys))
            for at, stop in zip(cut, cut[1:]):
                found = list(near(rows.slice(at, stop - at)))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c)) for c in zip(*found)], names=["a", "b"])
            held = [rows.slice(cut[-1])]

    return (placed.repartition(*key).sortWithinPartitions(*key)
                  .mapInArrow(run, "a long, b long"))


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, doc_id: str,
              text: str) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough."""
    pairs = written(pairs, "candidates")
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    held = written(_only(rows.select("node", "doc_id", "set_id"), need), "held")
    ids = held.select("doc_id").distinct()
    if held.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text"))
    texts = texts.join(ids, F.col("__id").eqNullSafe(F.col("doc_id")), "left_semi")

    def hashed(batch):
        found = [shingles(t) for t in batch]
        return [[xxhash.xxh128_digest(h.tobytes()) for h in found], [h.view(np.int64) for h in found]]

    full = append_columns(texts, [], "text", [
        T.StructField("set_id", T.BinaryType()),
        T.StructField("shingles", T.ArrayType(T.LongType(), False))], hashed)
    full = written(held.select("node", "set_id").join(full, "set_id")
                       .dropDuplicates(["node"]).select("node", "shingles"), "shingles")
    a = full.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = full.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - shared
    return both.where(shared * DEN >= union * NUM).select("a", "b")


def links(rows: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(a, b) node pairs, all verified, that connect every component of linked nodes.

    ``rows``: node, doc_id, set_id, n_shingles, band, low and high of every row;
    ``nodes``: the one node that stands for each distinct set.
    """
    shared = written(postings(_only(rows, nodes.select("node"))), "postings")
    stars = written(_verified(_star_pairs(shared, rows), rows, docs, doc_id, text), "stars")
    roots = components(stars, "a", "b").withColumnRenamed("root", "found")
    of = Window.partitionBy("sig")
    root = F.coalesce("found", "node")
    rest = (shared.where("n > 2").join(roots, "node", "left").withColumn("root", root)
                  .withColumn("least", F.min("root").over(of))
                  .withColumn("most", F.max("root").over(of)).where("least <> most"))
    rest = written(rest.select("sig", "n", "pivot", "node", "root"), "open")
    if rest.isEmpty():
        return stars
    members = rest.join(_only(rows, rest.select("node").distinct()).select(
        "node", F.col("n_shingles").alias("size"), "band", "low", "high"), "node")
    upper = F.col("sig").bitwiseAND(F.lit(1)) != F.col("band").bitwiseAND(F.lit(1)).cast("long")
    parts = _parts_of(F.col("sig"), F.col("band"), F.col("low"), F.col("high"))
    pairs = _block_pairs(members.select("sig", "n", "pivot", upper.alias("high"), "node", "root",
                                        "size", parts.alias("parts")))
    return stars.unionByName(written(_verified(pairs, rows, docs, doc_id, text), "rest"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_id, root, component_id per row of ``docs``.

    ``root`` is one node of the component (null where a set stands alone),
    ``component_id`` the smallest doc_id reachable over links, the own one
    included.  Repeated rows share it; a component whose ids are all null has a
    null one.  An empty table gives an empty result.  Other columns of ``docs``
    are not read, whatever their names.
    """
    every = written(sets(docs, [doc_id], text).withColumnRenamed(doc_id, "doc_id")
                    .withColumn("row", F.monotonically_increasing_id()), "sets")
    nodes = written(every.where("set_id IS NOT NULL").groupBy("set_id").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("n")),
        "nodes")
    found = links(every.withColumnRenamed("row", "node"), nodes, docs, doc_id, text)
    roots = written(components(found, "a", "b"), "roots")
    linked = nodes.join(roots, "node").select("set_id", "root", "least")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    alone = (nodes.where("n > 1").join(roots, "node", "left_anti")
                  .select("set_id", F.col("node").alias("root"), F.col("least").alias("component_id")))
    groups = written(linked.join(of_root, "root").select("set_id", "root", "component_id")
                           .unionByName(alone), "groups")
    hit = salted_lookup(every, groups, "set_id", F.col("row"))
    own = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return hit.select(F.col("doc_id").alias(doc_id), "n_shingles", "set_id", "root",
                      own.alias("component_id"))
