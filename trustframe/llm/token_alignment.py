"""Alignment of two tokenizers over the same text.

A is a byte-level BPE (``tokenizers`` JSON file) over a space and the text, B a
``sentencepiece`` model with byte fallback over the text, to which it adds that
space itself.  The tokens' bytes, joined, must give the space and the text for
both; texts where they do not, null and empty ones have no tokens: counts are
zero and the list of groups is empty.  Repeated rows count each; an empty table
gives an empty result; a kept column named like an added one gives way to it.

Method, per text: a dictionary from cumulative byte end to token index for each
side; the set intersection of their keys, sorted, cuts both id lists into
groups; the links of a group are all its pairs of an A and a B occurrence,
kept as distinct id pairs with their number.

This runs on parts of a text, cut before each single space or line end between
two other characters: the A pattern ends a match there, no B piece reads across
it (checked when the model is loaded), so both sides have a token end there and
the groups of the parts are those of the text.  Parts repeat, so each worker
remembers the alignments of the last ones (a bounded number).

Corpus counts (in how many texts an id pair is linked) come from one
aggregation; their table is bounded by the vocabularies, not by the corpus.  It
is broadcast if its counted rows are few enough, else joined by a salted
shuffle.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
import struct
from array import array
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, salted_lookup, written

# parts whose alignment a worker remembers, and that it encodes at once
MEMO_PARTS = 200_000
BATCH_PARTS = 500
# rows of the count table that are broadcast, 16 bytes each
BROADCAST_PAIRS = 4_000_000
SPACE_MARK = "▁"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_ODD = re.compile(r"\s\s|^\s|\s$")                      # white space that may be no cut
_COUNTS = struct.Struct("4q")
_BYTE_ENTRY = re.compile(r"<0x([0-9A-F]{2})>")


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte.

    Printable bytes stand for themselves, the others follow from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, the bytes of their ids, and the alignments of recent parts."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # one Spark task, one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for entry, i in self.a.get_vocab().items():
            if all(c in letters for c in entry):
                self.a_bytes[i] = bytes(letters[c] for c in entry)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            of_byte = _BYTE_ENTRY.fullmatch(piece) if self.b.is_byte(i) else None
            self.b_bytes.append(bytes((int(of_byte[1], 16),)) if of_byte
                                else piece.replace(SPACE_MARK, " ").encode())
            if SPACE_MARK in piece.lstrip(SPACE_MARK) or "\n" in piece:
                raise ValueError(f"piece {i} reads across a cut: texts cannot be cut there")
        self.stride = len(self.b_bytes)
        self.memo: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def groups(self, some: list[str]) -> list[list[tuple] | None]:
        """(A ids, B ids) of the groups of each part, None if its bytes do not join to it."""
        out: list = [None] * len(some)
        alone = [i for i, p in enumerate(some) if len(p) < 2 or p[1].isspace() or p[-1].isspace()]
        plain = sorted(set(range(len(some))) - set(alone))
        for at in range(0, len(plain), BATCH_PARTS):
            now = plain[at:at + BATCH_PARTS]
            found = self._groups([some[i] for i in now])
            if found is None:
                alone += now
            else:
                for i, g in zip(now, found):
                    out[i] = g
        for i in alone:
            out[i] = (self._groups([some[i]]) or [None])[0]
        return out

    def _groups(self, some: list[str]) -> list[list[tuple]] | None:
        """Groups of parts that stand side by side; None unless all their bytes join."""
        text = "".join(some)
        whole = text.encode()
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = []
        for p, ids in zip(some, self.b.encode([p.removeprefix(" ") for p in some], num_threads=1)):
            # the space that B adds stands for the part's own, or is one too many before a line end
            b += ids if p[0] == " " else ids[1:]
        a_bytes, b_bytes = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if not b"".join(a_bytes) == whole == b"".join(b_bytes):
            return None
        stops = iter(accumulate(len(p.encode()) for p in some))
        out, now, stop = [], [], next(stops)
        for end, i, k, j, m in cuts(accumulate(map(len, a_bytes)), accumulate(map(len, b_bytes))):
            now.append((a[i:k], b[j:m]))
            if end == stop:
                out.append(now)
                now, stop = [], next(stops, None)
        return out if len(out) == len(some) else None

    def align(self, texts: list[bytes]) -> list[list[tuple]]:
        """What ``_part`` gives for each part of each text, empty where the bytes do not join."""
        gc.disable()            # nothing here is cyclic, and a collection walks the whole memo
        try:
            return self._align(texts)
        finally:
            gc.enable()

    def _align(self, texts: list[bytes]) -> list[list[tuple]]:
        cut = [parts(t) for t in texts]
        now = {p: self.memo.get(p) or self.old.get(p) for c in cut for p in c}
        new = [p for p, known in now.items() if known is None]
        now.update(zip(new, (g and self._part(g) for g in self.groups(new))))
        self.memo.update(now)
        if len(self.memo) > MEMO_PARTS:
            self.memo, self.old = {}, self.memo
        found = ([now[p] for p in c] for c in cut)
        return [[] if None in f else f for f in found]

    def _part(self, groups: list[tuple]) -> tuple[str, bytes, bytes]:
        """Listed groups, (pair, times) of their links, (A ids, B ids, groups, links)."""
        shown, pairs, n_a, n_b, n_links, stride = [], [], 0, 0, 0, self.stride
        for a, b in groups:
            if len(a) == 1 == len(b):
                shown.append(f"{a[0]}|{b[0]}")
                pairs += a[0] * stride + b[0], 1
            else:
                shown.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
                of_b = Counter(b)
                for x, times in Counter(a).items():
                    for y, more in of_b.items():
                        pairs += x * stride + y, times * more
            n_a += len(a)
            n_b += len(b)
            n_links += len(a) * len(b)
        return (";".join(shown), array("q", pairs).tobytes(),
                _COUNTS.pack(n_a, n_b, len(groups), n_links))


def parts(text: bytes) -> list[str]:
    """The space and the text, cut where both sides have a token end; [] if no tokens are due."""
    try:
        whole = text.decode()
    except UnicodeDecodeError:
        return []
    if not whole:
        return []
    if "\x00" in whole or _ODD.search(whole):
        return _CUT.split(" " + whole)
    marked = whole.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")
    marked[0] = " " + marked[0]
    return marked


def cuts(a_ends: Iterable[int], b_ends: Iterable[int]):
    """(end, i, k, j, m): ids i to k of A and j to m of B lie before a common end, after the last."""
    a_at = {end: i for i, end in enumerate(a_ends, 1)}
    b_at = {end: i for i, end in enumerate(b_ends, 1)}
    i = j = 0
    for end in sorted(a_at.keys() & b_at.keys()):
        k, m = a_at[end], b_at[end]
        yield end, i, k, j, m
        i, j = k, m


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One pair of tokenizers per Python worker."""
    return Aligner(a_path, b_path)


def align(docs: DataFrame, a_path: str, b_path: str, keep: list[str],
          text: str = "text") -> DataFrame:
    """``keep`` plus ``groups`` (array of A ids and B ids) of every text, empty without tokens."""
    def rows(texts):
        found = (aligner(a_path, b_path).groups(parts(t)) for t in texts)
        return [[[] if None in f else [{"a": a, "b": b} for g in f for a, b in g] for f in found]]

    ids = T.ArrayType(T.IntegerType(), False)
    return append_columns(docs, keep, text, [T.StructField("groups", T.ArrayType(
        T.StructType([T.StructField("a", ids), T.StructField("b", ids)]), False))], rows)


def _summed(found: list[tuple]) -> list:
    """Counts, digest of the groups, distinct pairs and their numbers of one text."""
    n = np.frombuffer(b"".join(p[2] for p in found), np.int64).reshape(-1, 4).sum(axis=0)
    each = np.frombuffer(b"".join(p[1] for p in found), np.int64).reshape(-1, 2)
    pair, where = np.unique(each[:, 0], return_inverse=True)
    times = np.bincount(where, each[:, 1], len(pair)).astype(np.int64)
    shown = ";".join(p[0] for p in found)
    digest = hashlib.sha256(shown.encode()).hexdigest() if found else ""
    return [*n.tolist(), digest, pair, times]


def linked(docs: DataFrame, a_path: str, b_path: str, keep: list[str],
           text: str = "text") -> DataFrame:
    """``keep`` plus counts, the digest of the groups, and the distinct linked id pairs.

    ``pairs`` holds a * (B's size) + b, ``times`` how many links the pair has.
    """
    def rows(texts):
        return zip(*map(_summed, aligner(a_path, b_path).align(texts)))

    long, longs = T.LongType(), T.ArrayType(T.LongType(), False)
    return append_columns(docs, keep, text, [
        T.StructField("n_a", long), T.StructField("n_b", long), T.StructField("n_groups", long),
        T.StructField("n_links", long), T.StructField("groups_sha256", T.StringType()),
        T.StructField("pairs", longs), T.StructField("times", longs)], rows)


def pair_counts(rows: DataFrame, stride: int) -> DataFrame:
    """pair, n (texts that hold it linked) and best (n is the highest of its A id)."""
    n = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair")
                    .agg(F.count("*").alias("n")), "pair-counts")
    a = F.expr(f"pair div {stride}")
    most = n.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return (n.withColumn("a", a).join(most, "a")
             .select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")))


def scored(docs: DataFrame, a_path: str, b_path: str, keep: list[str], text: str = "text",
           broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``linked`` without its arrays, plus ``n_best`` and ``count_sum`` over the links."""
    rows = written(linked(docs, a_path, b_path, keep, text), "linked")
    stride = aligner(a_path, b_path).stride
    counts = written(pair_counts(rows, stride), "pair-scores")
    few = counts.count() <= broadcast_pairs
    plain = [c for c in rows.columns if c not in ("pairs", "times")]
    each = (rows.withColumn("__row", F.monotonically_increasing_id())
                .select("__row", *plain, F.explode_outer(F.arrays_zip("pairs", "times")).alias("l"))
                .select("__row", *plain, F.col("l.pairs").alias("pair"),
                        F.col("l.times").alias("times")))
    met = (each.join(F.broadcast(counts), "pair", "left") if few
           else salted_lookup(each, counts, "pair", F.col("__row")))
    total = {"n_best": F.col("best"), "count_sum": F.col("n")}
    return (met.groupBy("__row", *plain)
               .agg(*(F.coalesce(F.sum(v * F.col("times")), F.lit(0)).alias(name)
                      for name, v in total.items()))
               .drop("__row"))
