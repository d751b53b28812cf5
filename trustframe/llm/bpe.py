"""Byte-level BPE encoding and decoding with the tiktoken library.

The rank file is local and its path a parameter; nothing is trained.  Texts
longer than ``PART_CHARS`` are cut where the split pattern always ends a match
(a letter or digit before white space or punctuation: no match reads across
that point, forwards or backwards), so the parts encode exactly like the whole
and the library never holds the matches of a very long text at once.  A text
without such a point after the limit is encoded in one part.

Null and empty texts give no tokens; decoding joins the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

PART_CHARS = 1 << 16
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[\s\p{P}])")


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {v: k for k, v in ranks.items()}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks,
                                          special_tokens={})

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in parts(text):
            ids += self.encoding.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def parts(text: str, size: int = PART_CHARS):
    """Consecutive parts of at least ``size`` characters, cut at safe points only."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker."""
    return Codec(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, keep: list[str],
                  text: str = "text") -> DataFrame:
    """``keep`` plus ``ids`` (array<int>) and ``decoded`` (binary) of each whole text."""
    def rows(texts):
        c = codec(path, pattern)
        ids = [c.encode(t.decode("utf-8", "replace")) for t in texts]
        return [ids, [c.decode(i) for i in ids]]

    return append_columns(docs, keep, text, [
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("decoded", T.BinaryType())], rows)


def digests(docs: DataFrame, path: str, pattern: str, keep: list[str],
            text: str = "text") -> DataFrame:
    """``keep`` plus token count and SHA-256 of the ids and of the decoded bytes.

    The same codec as ``encode_decode``; ids are reduced where they are made.
    """
    def rows(texts):
        c = codec(path, pattern)
        n, of_ids, of_bytes = [], [], []
        for t in texts:
            ids = c.encode(t.decode("utf-8", "replace"))
            n.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return [n, of_ids, of_bytes]

    return append_columns(docs, keep, text, [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType())], rows)
