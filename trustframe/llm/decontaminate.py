"""Benchmark decontamination with suffix arrays over shards of the documents.

Each task cuts its documents into shards of about ``SHARD_WORDS`` words and
sorts the suffixes of each shard (words as numbers, prefix doubling).  Every
test suffix, that is every position of a benchmark item with a full window
after it, is binary-searched in every shard; the range it falls in holds all
places of its window.  For each hit place the longest verbatim match follows
from a search in the sorted test suffixes.

Words are ``[0-9a-z]`` and every non-ASCII character after lower-casing A-Z.
A window is ``window`` consecutive words of an item; an item of fewer words,
but not none, is one window.  Document words that no item uses cannot be in a
match, so runs of other words shorter than the shortest window are left out of
the sort; this loses no match.

The benchmark is a query set: it is sent to the tasks in blocks of at most
``BLOCK_BYTES`` of text (an item is never cut), one pass over the documents per
block, and the passes add up in two state columns.  Null texts have no words.
Repeated items count once by item_id; an item without id marks words but is
not listed.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, rows_where, utf8, written

WINDOW = 10
SHARD_WORDS = 1 << 21
BLOCK_BYTES = 4 << 20
_CHUNK = 1 << 21

_WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32
                    for c in bytes(range(256)).lower())


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def suffix_array(a: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of ``a`` sorted by their first ``depth`` numbers at least."""
    rank = np.unique(a, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while k < depth and len(rank) and rank.max() < len(rank):
        after = np.zeros_like(rank)
        after[:-k or None] = rank[k:]
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1] + 1
        k *= 2
    return np.argsort(rank, kind="stable")


def _compare(a: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sign of (suffix of ``a`` at ``at``) against each row of ``q``, by q's width.

    ``a`` must be padded with that many zeros.
    """
    rows = a[at[:, None] + np.arange(q.shape[1])]
    differ = rows != q
    first = differ.argmax(axis=1)
    i = np.arange(len(q))
    return np.sign(rows[i, first].astype(np.int64) - q[i, first])


def bound(a: np.ndarray, sa: np.ndarray, q: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of the rows of ``q`` in ``sa``: first place not before (or after) each."""
    out = np.empty(len(q), np.int64)
    step = max(1, _CHUNK // max(1, q.shape[1]))
    for s in range(0, len(q), step):
        part = q[s:s + step]
        lo, hi = np.zeros(len(part), np.int64), np.full(len(part), len(sa), np.int64)
        while len(sa) and (lo < hi).any():
            mid = (lo + hi) // 2
            sign = _compare(a, sa[np.minimum(mid, len(sa) - 1)], part)
            right = ((sign < 0) | (after & (sign == 0))) & (lo < hi)
            hi = np.where((lo < hi) & ~right, mid, hi)
            lo = np.where(right, mid + 1, lo)
        out[s:s + step] = lo
    return out


def _common(a, i, b, j, depth) -> np.ndarray:
    """Length of the common prefix of a[i:] and b[j:] up to ``depth``, 0 ends a text."""
    n = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    for d in range(depth):
        x = a[np.minimum(i[live] + d, len(a) - 1)]
        live = live[(x == b[np.minimum(j[live] + d, len(b) - 1)]) & (x != 0)]
        if not len(live):
            break
        n[live] = d + 1
    return n


class Block:
    """The test suffixes of one block of items."""

    def __init__(self, items: list[tuple], window: int):
        names: dict[bytes, int] = {}
        texts = [(i, [names.setdefault(w, len(names) + 1) for w in words((t or "").encode())])
                 for i, t in items]
        texts = [(i, w) for i, w in texts if w]
        self.names, self.items = names, [i for i, _ in texts]
        lengths = np.array([len(w) for _, w in texts], dtype=np.int64)
        self.depth = int(lengths.max(initial=0))
        # items one after the other with a zero after each; zeros to read past the end
        self.item_start = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1].astype(np.int64)
        self.a = np.zeros(int((lengths + 1).sum()) + self.depth + 1, np.int32)
        for (_, w), s in zip(texts, self.item_start):
            self.a[s:s + len(w)] = w
        self.sa = suffix_array(self.a[:max(1, len(self.a) - self.depth - 1)], self.depth)
        self.by_size = {}
        size = np.minimum(lengths, window)
        for m in np.unique(size).tolist():
            which = np.flatnonzero(size == m)
            count = lengths[which] - m + 1
            item = np.repeat(which, count)
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            at += self.item_start[item]
            q, kind = np.unique(self.a[at[:, None] + np.arange(m)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack((kind.ravel(), item)), axis=1)
            cuts = np.searchsorted(pairs[0], np.arange(len(q) + 1))
            self.by_size[m] = (q, pairs[1], cuts)      # items of window k: pairs[1][cuts[k]:cuts[k + 1]]
        self.shortest = min(self.by_size, default=window)

    def numbers(self, text: list[bytes]) -> np.ndarray:
        get = self.names.get
        return np.fromiter((get(w, 0) for w in text), np.int32, len(text))

    def scan(self, docs: list[np.ndarray]):
        """Per document: hit mask, items, (length, start, item, item start) of the longest match."""
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(lengths + 1)))
        full = np.zeros(first[-1] + 1, np.int32)
        for d, s in zip(docs, first):
            full[s:s + len(d)] = d
        zero = np.flatnonzero(full == 0)
        gap = np.diff(zero, prepend=-1) - 1            # length of the run before each zero
        keep = np.repeat(gap >= self.shortest, gap + 1)
        orig = np.flatnonzero(keep)                    # kept runs with the zero after each
        hit = np.zeros(len(full) + 1, np.int64)
        found_doc, found_item = [], []
        best: dict[int, tuple] = {}
        if len(orig) and self.by_size:
            a = np.concatenate((full[orig], np.zeros(self.depth + 1, np.int32)))
            sa = suffix_array(a[:len(orig)], self.depth)
            at_window = np.zeros(len(orig), bool)
            for m, (q, items, cuts) in self.by_size.items():
                lo, hi = bound(a, sa, q, False), bound(a, sa, q, True)
                for k in np.flatnonzero(hi > lo):
                    places = sa[lo[k]:hi[k]]
                    at_window[places] = True
                    np.add.at(hit, orig[places], 1)
                    np.add.at(hit, orig[places] + m, -1)
                    doc = np.unique(np.searchsorted(first, orig[places], "right") - 1)
                    for item in items[cuts[k]:cuts[k + 1]]:
                        found_doc.append(doc)
                        found_item.append(np.full(len(doc), item))
            best = self._longest(a, orig, np.flatnonzero(at_window), first)
        mask = np.cumsum(hit)[:-1] > 0
        named: dict[int, set] = {}
        for d, i in zip(found_doc, found_item):
            for x, y in zip(d.tolist(), i.tolist()):
                named.setdefault(x, set()).add(y)
        for k, s in enumerate(first[:-1]):
            yield (mask[s:s + lengths[k]], {self.items[i] for i in named.get(k, ())}, best.get(k))

    def _longest(self, a, orig, places, first) -> dict[int, tuple]:
        """Longest verbatim match per document, from the search of hit places in the test suffixes."""
        best: dict[int, tuple] = {}
        if not len(places):
            return best
        step = max(1, _CHUNK // max(1, self.depth))
        for s in range(0, len(places), step):
            p = places[s:s + step]
            q = a[p[:, None] + np.arange(self.depth)]
            spot = bound(self.a, self.sa, q, False)
            length, where = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            for side in (spot - 1, spot):
                t = self.sa[np.clip(side, 0, len(self.sa) - 1)]
                n = _common(a, p, self.a, t, self.depth)
                where = np.where(n > length, t, where)
                length = np.maximum(n, length)
            at = orig[p]
            doc = np.searchsorted(first, at, "right") - 1
            order = np.lexsort((at, -length, doc))
            for i in order[np.unique(doc[order], return_index=True)[1]]:
                d = int(doc[i])
                item = int(np.searchsorted(self.item_start, where[i], "right") - 1)
                new = (int(length[i]), int(at[i] - first[d]), self.items[item],
                       int(where[i] - self.item_start[item]))
                if d not in best or (new[0], -new[1]) > (best[d][0], -best[d][1]):
                    best[d] = new
        return best


_LAST: dict[str, Block] = {}


def _block(key: str, items: list[tuple], window: int) -> Block:
    """The block of this pass; a worker keeps the last one it built for its next tasks."""
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Block(items, window)
    return _LAST[key]


RESULT = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("longest_match", T.LongType()), T.StructField("match_start", T.LongType()),
    T.StructField("match_item", T.StringType()), T.StructField("match_item_start", T.LongType()),
]
_STATE = [T.StructField("__hits", T.BinaryType()),
          T.StructField("__items", T.ArrayType(T.StringType())),
          T.StructField("__best", T.StringType())]


def _blocks(bench: DataFrame, item_id: str, text: str, size: int) -> list[DataFrame]:
    """Row sets of at most about ``size`` bytes; the hash deals whole items."""
    b = bench.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    total = b.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = 2 * (total // size) + 1
    if n == 1:
        return [b]
    deal = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [b.where(deal == i) for i in range(n)]


def scan(docs: DataFrame, bench: DataFrame, keep: list[str], text: str = "text",
         item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns of every row of ``docs`` plus the columns of ``RESULT``."""
    bounded_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name in keep]
    blocks = _blocks(bench, item_id, item_text, block_bytes)
    df = docs.select(*(f.name for f in kept), F.col(text).alias("__text"),
                     F.lit(None).cast("binary").alias("__hits"),
                     F.lit(None).cast("array<string>").alias("__items"),
                     F.lit(None).cast("string").alias("__best"))
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        items = [(r["item"], r["text"]) for r in block.distinct().collect()]  # at most a block
        df = _one_pass(df, kept, sorted(items, key=repr), window, last)
        if not last:
            df = written(df, "decontamination")
    return df


def _one_pass(df, kept, items, window, last) -> DataFrame:
    fields = RESULT if last else [T.StructField("__text", T.StringType()), *_STATE]
    schema = T.StructType([*kept, *fields])
    types = [f.type for f in to_arrow_schema(T.StructType(fields))]
    names = [f.name for f in schema.fields]
    sent, key = df.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches):
        block, held, n = _block(key, sent.value, window), [], 0
        for batch in batches:
            texts = utf8(batch.column("__text"))
            at = 0
            while at < len(texts):
                docs, size, start = [], 0, at
                while at < len(texts) and size < SHARD_WORDS:
                    docs.append(block.numbers(words(texts[at])))
                    size += len(docs[-1])
                    at += 1
                held.append((batch.slice(start, at - start), docs))
                n += size
                if n >= SHARD_WORDS:
                    yield from flush(block, held)
                    held, n = [], 0
        if held:
            yield from flush(block, held)

    def flush(block, held):
        found = block.scan([d for _, docs in held for d in docs])
        for batch, docs in held:
            before = [batch.column(f.name).to_pylist() for f in _STATE]
            out = [_add(d, next(found), s, last) for d, s in zip(docs, zip(*before))]
            cols = list(zip(*out)) if out else [[] for _ in types]
            if not last:
                cols = [None, *cols]
            new = [batch.column("__text") if c is None else pa.array(list(c), t)
                   for c, t in zip(cols, types)]
            new = [x.cast(t) if x.type != t else x for x, t in zip(new, types)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), *new], names=names)

    return df.mapInArrow(run, schema)


def _add(doc, found, state, last):
    """This block's hits on top of the earlier blocks'; the result after the last."""
    mask, items, best = found
    hits, before, longest = state
    if hits is not None:
        mask = mask | np.unpackbits(np.frombuffer(hits, np.uint8),
                                    count=len(doc)).astype(bool)
    items = items | {None if i == "" else i[1:] for i in before or ()}
    if longest is not None:
        n, s, i, t = longest.split("\x00")
        old = (int(n), int(s), i[1:] if i else None, int(t))
        if best is None or (old[0], -old[1]) >= (best[0], -best[1]):
            best = old
    if not last:
        packed = None if best is None else "\x00".join(
            [str(best[0]), str(best[1]), "" if best[2] is None else f"i{best[2]}", str(best[3])])
        return (np.packbits(mask).tobytes(), ["" if i is None else f"i{i}" for i in items], packed)
    named = sorted(i for i in items if i is not None)
    n_hit = int(mask.sum())
    return (len(doc), n_hit, len(named),
            hashlib.sha256(",".join(named).encode()).hexdigest(), n_hit > 0,
            *(best or (0, None, None, None)))


def remove(docs: DataFrame, bench: DataFrame, text: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no window of the benchmark."""
    return rows_where(docs, text, lambda df, keep, t: scan(df, bench, keep, t, **kw),
                      "NOT contaminated")
