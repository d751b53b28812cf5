"""Licence scan: winnowed fingerprints pick candidates, banded alignment reports them.

Templates (a fixed list, sent to every task) are cut into ``K``-word shingles;
of each ``WINDOW`` consecutive shingles the one with the smallest hash, the
last on ties, is a fingerprint, and the inverted index maps it to (template,
word position).  Documents are winnowed the same way, so a shared passage of
``K + WINDOW - 1`` words shares a fingerprint.  Shingles with a word of no
template cannot match and only bound the windows.

Hits of one template whose diagonals lie within the band of each other make a
candidate; the template is then aligned with the document words around it
inside that band (matches +1, everything else -1/2, best local path).  Reported are
template, covered share of its words and the span in code points, end
exclusive, where the share is ``COVERAGE`` or more.  A span inside another
template's span is not reported; of equal spans the one with more words is.  All places of a text are found.

Words are letters and digits (non-ASCII characters count as letters), A-Z
lower-cased.  Null and empty texts have no licence.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns
from .license_texts import TEMPLATES

K = 3
WINDOW = 2
COVERAGE = 0.8

_WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32
                    for c in bytes(range(256)).lower())
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def shingles(ids: np.ndarray) -> np.ndarray:
    """Hash of each K-gram of word numbers; ``_NONE`` where one of them is 0."""
    n = len(ids) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for j in range(K):
            part = ids[j:j + n]
            known &= part > 0
            h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    h[~known] = _NONE
    return h


def winnowed(h: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints."""
    if len(h) < WINDOW:
        at = np.flatnonzero(h == h.min()) if len(h) else np.zeros(0, np.int64)
        return at[h[at] != _NONE]
    view = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    last = WINDOW - 1 - view[:, ::-1].argmin(axis=1)
    at = np.unique(np.arange(len(view)) + last)
    return at[h[at] != _NONE]


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [n for n, _ in templates]
        self.numbers: dict[bytes, int] = {}
        self.texts = [np.array([self.numbers.setdefault(w, len(self.numbers) + 1)
                                for w in words(t.encode())], dtype=np.int64) for _, t in templates]
        self.index: dict[int, list] = {}
        for t, ids in enumerate(self.texts):
            h = shingles(ids)
            for p in winnowed(h).tolist():
                self.index.setdefault(int(h[p]), []).append((t, p))
        self.keys = np.array(sorted(self.index), dtype=np.uint64)

    def band(self, t: int) -> int:
        return 4 + len(self.texts[t]) // 10

    def candidates(self, ids: np.ndarray):
        """(template, lowest diagonal, highest diagonal) with enough fingerprints."""
        h = shingles(ids)
        at = winnowed(h) if (h != _NONE).any() else ()
        if not len(at):
            return
        spot = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hits: dict[int, list] = {}
        for p in at[self.keys[spot] == h[at]].tolist():
            for t, q in self.index[int(h[p])]:
                hits.setdefault(t, []).append((p - q, q))
        for t, found in hits.items():
            found.sort()
            need = max(1, len(self.texts[t]) // (8 * K))
            group = [found[0]]
            for d in [*found[1:], None]:
                if d is not None and d[0] - group[-1][0] <= self.band(t):
                    group.append(d)
                    continue
                if len({q for _, q in group}) >= need:
                    yield t, group[0][0], group[-1][0]
                group = [d]

    def align(self, ids: np.ndarray, t: int, low: int, high: int):
        """(covered words, first word, end word) of the best local path in the band."""
        text, pad = self.texts[t], self.band(t)
        low, width = low - pad, high - low + 2 * pad + 1
        # a cell is (score, matches, first word); its diagonal is low + column
        above: list[tuple] = [(0.0, 0, -1)] * (width + 2)
        best = (0.0, 0, -1, -1)
        for i, w in enumerate(text.tolist()):
            row: list[tuple] = [(0.0, 0, -1)] * (width + 2)
            for c in range(width):
                j = i + low + c
                if not 0 <= j < len(ids):
                    continue
                score, n, first = above[c + 1]
                if ids[j] == w:
                    cell = (score + 1, n + 1, j if first < 0 else first)
                    if cell[0] > best[0]:
                        best = (*cell, j + 1)
                else:
                    cell = (score - 0.5, n, first)
                for other in (above[c + 2], row[c]):
                    if other[0] - 0.5 > cell[0]:
                        cell = (other[0] - 0.5, other[1], other[2])
                row[c + 1] = cell if cell[0] > 0 else (0.0, 0, -1)
            above = row
        return best[1:]

    def scan(self, text: bytes) -> list[dict]:
        get = self.numbers.get
        ids = np.array([get(w, 0) for w in words(text)], dtype=np.int64)
        found = []
        for t, low, high in self.candidates(ids):
            n, first, end = self.align(ids, t, low, high)
            if n >= COVERAGE * len(self.texts[t]):
                found.append((first, end, n, t))
        if not found:
            return []
        found.sort(key=lambda f: (f[0], -f[1], -f[2], f[3]))
        kept, reach = [], -1
        for f in found:
            if f[1] > reach:
                kept.append(f)
                reach = f[1]
        spans = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))]
        return [{"license": self.names[t], "coverage": round(n / len(self.texts[t]), 4),
                 "start": spans[first][0], "end": spans[end - 1][1]}
                for first, end, n, t in kept]


@lru_cache(maxsize=2)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates)


RESULT = T.ArrayType(T.StructType([
    T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, keep: list[str], text: str = "text",
         templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``keep`` plus ``licenses``: every licence found in each whole text."""
    fixed = tuple(sorted(templates.items()))

    def rows(texts):
        s = scanner(fixed)
        return [[s.scan(t) for t in texts]]

    return append_columns(docs, keep, text, [T.StructField("licenses", RESULT)], rows)
