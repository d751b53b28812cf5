"""Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from trustframe.llm import merkle
from trustframe.llm.queries import ORACLE, QUERIES

from ..oracle_check import compare, duck

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, item int, idx string"


def enc(v):
    if v is None:
        return b"-"
    b = str(v).encode()
    return str(len(b)).encode() + b":" + b


def sha(parts):
    return hashlib.sha256(b"".join(p if isinstance(p, bytes) else p.encode() for p in parts)).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def plain(rows, claim_of):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, sha(map(enc, r))))
        trees[s] = levels([sha(map(enc, r)) for r in sources[s]])
    upper = levels([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, r in enumerate(sources[s]):
            h, siblings = sha(map(enc, claim_of(r))), []
            for tree, j in ((trees[s], i), (upper, at)):
                for row in tree[:-1]:
                    run = row[j // 3 * 3:j // 3 * 3 + 3]
                    siblings += run[:j % 3] + run[j % 3 + 1:]
                    h, j = sha(run[:j % 3] + [h] + run[j % 3 + 1:]), j // 3
            root = upper[-1][0]
            out.append((r[0], trees[s][0][i], trees[s][-1][0], root, sha(siblings), h, h == root))
    return sorted(out, key=repr)


def cut(r):
    drop = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
    return (*r[:4], r[4].replace("\n", "")) if drop else r


def checked(spark, rows, claim=None):
    df = spark.createDataFrame([(*r, "t", 1, "i") for r in rows], SCHEMA)
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0,
                  F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.verified(df, FIELDS, "source", "doc_id", {"text": text})
    return sorted(map(tuple, got.collect()), key=repr)


def test_query_equals_sql_and_plain_python(spark, sf_dir):
    problems, n = compare(spark, duck(sf_dir), QUERIES["op11_merkle"], ORACLE["op11_merkle"], sf_dir)
    assert not problems and n > 0
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS).collect()]
    got = QUERIES["op11_merkle"](spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, cut)


def test_null_columns_ties_repeated_rows_and_long_texts(spark):
    rows = [(1, None, None, None, None), (None, None, "en", 3, "a\nb"), (None, "s", "en", 3, "\n"),
            (2, "", "de", 0, ""), (3, "s", "fr", -5, "é\n" * 20_000), (4, "10:é", "x", 1, "\n\n")]
    rows += [(7, "s", "en", 2, "a\n")] * 5 + [(7, "s", "en", 2, f"t{i}\n") for i in range(4)]
    rows += [(i, "hot", "en", i, f"line {i}\nline") for i in range(40)]
    assert checked(spark, rows) == plain(rows, cut)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_tree_sizes(spark, n):
    rows = [(i, "s", "en", 1, "x\ny") for i in range(n)]
    assert checked(spark, rows) == plain(rows, cut)


def test_many_sources_and_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 1)         # a pack per run: five rounds for the largest tree
    monkeypatch.setattr(merkle, "SPAN", 3)
    rows = [(i, f"s{i % 13}" if i % 3 else "big", "en", i, f"{i}\n") for i in range(300)]
    assert checked(spark, rows) == plain(rows, cut)


def test_empty_table(spark):
    assert checked(spark, []) == []


def test_store_and_descent(spark):
    """Records lead from the root to every leaf; a wrong digest leads nowhere."""
    leaves = spark.createDataFrame([(i, "s" if i % 4 else "t") for i in range(50)], "doc_id long, source string")
    leaves = leaves.select("doc_id", "source", merkle.digest(F.col("doc_id")).alias("digest"),
                           F.col("doc_id").alias("item"))
    m = merkle.manifest(leaves, ["doc_id"])
    store = {r["digest"]: r["children"] for r in m.records().collect()}
    found, level = [], [m.root().first()["root"]]
    while level:
        below = [c for d in level for c in store.get(d, [])]
        found += [d for d in level if d not in store]
        level = below
    assert sorted(found) == sorted(sha([enc(i)]) for i in range(50))
    assert all(sha(children) == digest for digest, children in store.items())
    assert [(r["source"], r["leaves"]) for r in m.subroots().orderBy("source").collect()] == [("s", 37), ("t", 13)]
    with pytest.raises(KeyError):
        merkle.descend(b"x" * 32, {}, 0, 1)
