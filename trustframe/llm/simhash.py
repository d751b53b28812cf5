"""SimHash near-duplicates through a byte-position inverted index.

Fingerprint: 64 bits over the XXH64 hashes (seed 42) of the 3-word shingles,
repeats included; a bit is 1 if set in over half of them.  Words are runs of
anything but ASCII white space, A-Z lower-cased; fewer words than a shingle
form one; null, empty and blank texts have fingerprint zero.

Links: fingerprints at ``MAX_BITS`` = 2 or fewer differing bits share at least
6 of their 8 (position, byte) entries.  The index holds each distinct
fingerprint (copies collapse first) under the six unions of two byte-position
pairs; two changed bytes touch at most two of the four pairs, so every such
pair of fingerprints meets in one posting of four common bytes.  Pairs that
meet are tallied over all eight positions, kept at 6 or more, then verified by
bit distance.  A posting of more than ``POSTING_PAIRS`` fingerprints emits no
pairs: its members meet at their one-bit neighbours instead (two fingerprints
are at most two bits apart exactly if they share a neighbour or one another),
at most 33 entries per member and 33 members per meeting point.  Nothing is
dropped and no group is collected.

Components come from ``components``; equal fingerprints are one node.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import append_columns, salted_lookup, written
from .components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
MIN_BYTES = 8 - MAX_BITS
POSTING_PAIRS = 64
_BLOCK = 1 << 16


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of one UTF-8 text."""
    words = text.lower().split()          # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-SHINGLE])).tolist()
    stops = (ends[SHINGLE - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(stops), _BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in
                      zip(starts[at:at + _BLOCK], stops[at:at + _BLOCK])], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    over = np.packbits(ones * 2 > len(stops), bitorder="little")
    return int(over.view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus ``fp`` (the fingerprint's bits as a long) and ``text_hash``."""
    def rows(texts):
        fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
        sig = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts],
                       dtype=np.uint64).view(np.int64)
        return [fps, sig]

    return append_columns(docs, keep, text, [
        T.StructField("fp", T.LongType()), T.StructField("text_hash", T.LongType())], rows)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _combos() -> list[tuple[int, list[int]]]:
    """(mask of four byte positions, bits outside it) per union of two position pairs."""
    pairs = [0xFFFF << (16 * i) for i in range(4)]
    masks = [pairs[i] | pairs[j] for i in range(4) for j in range(i)]
    return [(_signed(m), [b for b in range(64) if not m >> b & 1]) for m in masks]


def shared_bytes(x: Column) -> Column:
    """How many of the 8 byte positions agree, from the xor of two fingerprints."""
    return sum(F.when(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0)
               for i in range(8))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) fingerprint pairs that connect all at ``MAX_BITS`` or fewer bits.

    ``distinct``: one row per fingerprint, column ``fp``.  Pairs of small
    postings are verified links; large postings link each member to the
    smallest member at the same meeting point, which is connected to it.
    """
    combos = _combos()
    entry = F.explode(F.array(*(F.struct(F.lit(i).alias("combo"),
                                         F.col("fp").bitwiseAND(F.lit(m)).alias("bytes"))
                                for i, (m, _) in enumerate(combos))))
    index = distinct.select("fp", entry.alias("e")).select("fp", "e.combo", "e.bytes")
    size = index.groupBy("combo", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    postings = written(index.join(size, ["combo", "bytes"]), "postings")

    small = postings.where(F.col("n") <= POSTING_PAIRS)
    other = small.select("combo", "bytes", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    met = (small.select("combo", "bytes", F.col("fp").alias("a"))
                .join(other, ["combo", "bytes"]).where("a < b"))
    pairs = (met.withColumn("shared", shared_bytes(x))
                .where(F.col("shared") >= MIN_BYTES)
                .where(F.bit_count(x) <= MAX_BITS).select("a", "b"))

    large = postings.where(F.col("n") > POSTING_PAIRS)
    flips = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << b)) for b in free))
                      for _, free in combos))
    near = large.select("fp", "combo", F.explode(F.transform(
        F.get(flips, F.col("combo")), lambda f: F.col("fp").bitwiseXOR(f))).alias("meeting"))
    hub = Window.partitionBy("combo", "meeting")
    stars = (near.withColumn("b", F.min("fp").over(hub))
                 .where("fp <> b").select(F.col("fp").alias("a"), "b"))
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, text_hash, root, component_id per row of ``docs``.

    ``root`` is one fingerprint of the component, ``component_id`` the smallest
    doc_id reachable over links, the own one included; repeated rows share it;
    a component whose ids are all null has a null one.
    """
    rows = written(fingerprints(docs, [doc_id], text), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min(doc_id).alias("least"), F.count("*").alias("n")),
                    "nodes")
    roots = components(links(nodes.select("fp")), "a", "b")
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "least")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = linked.join(of_root, "root").select("fp", "root", "component_id")
    alone = (nodes.where("n > 1").join(of_fp.select("fp"), "fp", "left_anti")
                  .select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id")))
    groups = written(of_fp.unionByName(alone), "groups")
    # rows without an entry are the only one of their fingerprint and have no link
    hit = salted_lookup(rows, groups, "fp", F.struct(F.col(doc_id), F.col("text_hash")))
    own = F.when(F.col("root").isNull(), F.col(doc_id)).otherwise(F.col("component_id"))
    return hit.select(doc_id, "fp", "text_hash", F.coalesce("root", "fp").alias("root"),
                      own.alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per component: the smallest doc_id, then text hash.

    A null doc_id stays only where its whole component has none.  Of rows
    that repeat the chosen id and text one stays.
    """
    found = near_duplicates(docs, doc_id, text)
    rank = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"),
                    F.col("text_hash").alias("h"))
    best = found.groupBy("root").agg(F.min(rank).alias("best")).select("best.*")
    sig = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = sig.join(best, sig[doc_id].eqNullSafe(best["id"]) & (sig["__h"] == best["h"]),
                    "left_semi")
    once = Window.partitionBy(doc_id, "__h").orderBy(F.lit(0))
    return (kept.withColumn("__n", F.row_number().over(once)).where("__n = 1")
                .select(*docs.columns))
