"""Elements of large JSON array files, many tasks per file.

The text reader with ``}`` as record separator splits a file anywhere, so each
task gets a run of pieces (a chunk) that starts after some ``}``.  Whether it
starts inside a text, and how deep, depends on all chunks before it:

1. every chunk is summed up for both cases, outside and inside a text: change
   of depth, lowest depth, and whether it ends inside a text;
2. the sums of a file are chained from its start (one small row per chunk);
3. every chunk is read again from its known state and gives its elements;
   the piece of an element that a chunk does not hold whole is joined with the
   pieces after it.

A root object is one element.  What is not an element of a whole array stays
visible as an element that does not parse: the unfinished last element of a
broken-off file, text after the root, and a root that is neither.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

END = b"}"
_TEXT = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*("?)', re.DOTALL)
_REST_OF_TEXT = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
_TOKEN = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*("?)|[\[\]{},]', re.DOTALL)
_NO_BRACKET = bytes(set(range(256)) - set(b"[]{}"))
SUMS = ("file string, start long, size long, bytes long, pieces long, first binary, "
        "delta0 long, low0 long, text0 boolean, delta1 long, low1 long, text1 boolean")
STATES = ("file string, start long, depth long, inside boolean, root binary, over boolean, "
          "last boolean, sealed boolean")
FOUND = "file string, start long, place long, raw binary, opens boolean, closes boolean"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", END.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("start"),
                       F.col("_metadata.file_size").alias("size"),
                       F.col("value").cast("binary").alias("piece"))


def _chunks(batches, extra: tuple[str, ...] = ()):
    """(file, start, extra values, iterator of pieces) per chunk; pieces arrive in file order."""
    def rows():
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("file", "start", *extra, "piece")]
            yield from zip(*cols)

    held = None
    source = rows()

    def of_chunk(key, first):
        nonlocal held
        yield first
        for row in source:
            if row[:2] != key:
                held = row
                return
            yield row[-1]
        held = None

    held = next(source, None)
    while held is not None:
        row, held = held, None
        pieces = of_chunk(row[:2], row[-1])
        yield row[0], row[1], row[2:-1], pieces
        for _ in pieces:            # what the caller left
            pass


def _walk(piece: bytes, inside: bool) -> tuple[int, int, bool]:
    """(change of depth, lowest depth, ends inside a text) of one piece."""
    if inside:
        m = _REST_OF_TEXT.match(piece)
        if m is None:
            return 0, 0, True
        piece = piece[m.end():]
    open_text = False

    def drop(m):
        nonlocal open_text
        open_text = open_text or not m[1]
        return b""

    brackets = _TEXT.sub(drop, piece).translate(None, _NO_BRACKET)
    if not brackets:
        return 0, 0, open_text
    b = np.frombuffer(brackets, np.uint8)
    depth = np.cumsum(np.where((b == ord("[")) | (b == ord("{")), 1, -1))
    return int(depth[-1]), min(0, int(depth.min())), open_text


def _sum_up(batches):
    for file, start, (size,), pieces in _chunks(batches, ("size",)):
        case = [[0, 0, False], [0, 0, True]]
        n = many = 0
        first = b""
        for piece in pieces:
            n, many = n + len(piece), many + 1
            first = first or piece.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] or END
            for c in case:
                delta, low, c[2] = _walk(piece + END, c[2])
                c[1] = min(c[1], c[0] + low)
                c[0] += delta
        row = [file, start, size, n, many, first, *case[0], *case[1]]
        yield pa.RecordBatch.from_pylist([dict(zip(_names(SUMS), row))], schema=_arrow(SUMS))


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _arrow(ddl: str) -> pa.Schema:
    kind = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kind[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _chain(sums):
    """State at the start of every chunk of one file (a pandas group, one row per chunk)."""
    sums = sums.sort_values("start")
    root = sums["first"].iloc[0]
    base = 1 if root == b"[" else 0
    # the last piece had a separator if pieces and separators fill the file
    sealed = int((sums["bytes"] + sums["pieces"]).sum()) <= int(sums["size"].iloc[0])
    depth, inside, over, out = 0, False, False, []
    for i, r in enumerate(sums.itertuples(index=False)):
        out.append((r.file, r.start, depth, inside, root, over, i == len(sums) - 1, sealed))
        delta, low, text = (r.delta1, r.low1, r.text1) if inside else (r.delta0, r.low0, r.text0)
        # the first chunk of an array starts at depth 0 and must not count as closed
        over = over or depth + low < (0 if base == 0 or i == 0 else 1)
        over = over or (base == 1 and i == 0 and depth + delta < 1)
        depth, inside = depth + delta, text
    import pandas as pd

    return pd.DataFrame(out, columns=_names(STATES))


class _Reader:
    """Elements of one chunk, from its known start."""

    def __init__(self, depth: int, inside: bool, root: bytes, over: bool):
        self.base = 1 if root == b"[" else 0
        self.depth, self.inside, self.over = depth, inside, over
        self.odd = root not in (b"[", b"{")
        # the element that is open at the start began in an earlier chunk
        self.mine = not (over or inside or depth > self.base)
        self.text: list[bytes] = []
        self.place = 0

    def _end(self, closes: bool):
        raw = b"".join(self.text)
        self.text = []
        if self.mine and not raw.strip():
            return []
        opens, self.mine = self.mine, True
        self.place += opens
        return [(self.place - 1 if opens else -1, raw, opens, closes)]

    def read(self, piece: bytes):
        if self.over or self.odd:
            self.text.append(piece)
            return
        at = mark = 0
        if self.inside:
            m = _REST_OF_TEXT.match(piece)
            if m is None:
                self.text.append(piece)
                return
            at, self.inside = m.end(), False
        for m in _TOKEN.finditer(piece, at):
            token = piece[m.start():m.start() + 1]
            if token == b'"':
                self.inside = not m[1]
            elif token in b"[{":
                self.depth += 1
                if self.base == 1 and self.depth == 1:          # the root itself
                    mark, self.text = m.end(), []
            elif token == b",":
                if self.depth == self.base:
                    self.text.append(piece[mark:m.start()])
                    yield from self._end(True)
                    mark = m.end()
            else:
                self.depth -= 1
                if self.depth < self.base:
                    self.text.append(piece[mark:m.start()])
                    yield from self._end(True)
                    self.over, mark = True, m.end()
                    break
                if self.depth == self.base:
                    self.text.append(piece[mark:m.end()])
                    yield from self._end(True)
                    mark = m.end()
        self.text.append(piece[mark:])

    def leave(self, last: bool):
        """What is open at the end of the chunk."""
        if last and not self.over and not self.odd and self.depth > 0 and self.mine \
                and not b"".join(self.text).strip():
            self.text = [b"["]              # the array never ends
        if self.over or self.odd or self.inside or self.depth > self.base or not self.mine or last:
            yield from self._end(last and not self.over and not self.odd and self.depth == 0)


def _elements(batches):
    extra = ("depth", "inside", "root", "over", "last", "sealed")
    for file, start, (depth, inside, root, over, last, sealed), pieces in _chunks(batches, extra):
        reader = _Reader(depth, inside, root, over)
        done, held = [], None

        def batch(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * len(rows)), pa.array([start] * len(rows), pa.int64()),
                 *(pa.array(c, f.type) for c, f in zip(cols, list(_arrow(FOUND))[2:]))],
                names=_names(FOUND))

        for piece in pieces:
            if held is not None:
                done += reader.read(held + END)
                if len(done) >= 1000:
                    yield batch(done)
                    done = []
            held = piece if held is not None or start else piece.removeprefix(b"\xef\xbb\xbf")
        done += reader.read(held + (END if sealed or not last else b""))
        done += reader.leave(last)
        if done:
            yield batch(done)


def elements(spark: SparkSession, path: str) -> DataFrame:
    """-> file, idx (position in its file), raw (text of the element; null where it never ends)."""
    pieces = _pieces(spark, path)
    sums = pieces.mapInArrow(_sum_up, SUMS)
    states = materialize(sums.groupBy("file").applyInPandas(_chain, STATES))
    # one row per task of the scan: as small as the scheduler's own list
    known = pieces.join(F.broadcast(states), ["file", "start"])
    found = materialize(known.mapInArrow(_elements, FOUND))

    per_chunk = found.groupBy("file", "start").agg((F.max("place") + 1).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    base = per_chunk.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    whole = found.where("opens AND closes").select("file", "start", "place", F.col("raw").cast("string").alias("raw"))
    cut = found.where("NOT (opens AND closes)")
    # an element's pieces are numbered without their text, which may be long
    so_far = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
    number = cut.select("file", "start", "place", F.sum(F.col("opens").cast("int")).over(so_far).alias("no"))
    joined = (cut.join(number, ["file", "start", "place"]).groupBy("file", "no")
                 .agg(F.min_by(F.struct("start", "place"), F.struct(~F.col("opens"), "start")).alias("at"),
                      F.bool_or("closes").alias("ends"),
                      F.sort_array(F.collect_list(F.struct("start", "place", "raw"))).alias("parts"))
                 .withColumn("raw", F.array_join(F.transform("parts", lambda p: p["raw"].cast("string")), "")))
    text = F.trim(F.regexp_replace("raw", r"\s+", " "))
    joined = joined.where(F.col("ends") | (text != "")).select(
        "file", "at.start", "at.place", F.when(F.col("ends"), F.col("raw")).alias("raw"))
    return (whole.unionByName(joined).join(base, ["file", "start"])
                 .select("file", (F.col("base") + F.col("place")).alias("idx"), "raw"))
