"""N-gram Jaccard join against all pairs of whole sets."""

import itertools
import random
import re

import numpy as np
import pytest

from trustframe.llm import ngram_join as nj
from trustframe.llm.queries import ORACLE, QUERIES

from ..oracle_check import compare, duck
from .test_operators import docs_of


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 90 * len(a | b)


def plain(texts):
    """(set size, smallest reachable position) of every text, by all pairs."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(range(len(texts)), 2):
        if similar(sets[a], sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        at = rnd.randrange(len(out))
        act = rnd.randrange(3)
        if act == 0:
            out[at] = f"new{rnd.randrange(10**6)}"
        elif act == 1:
            out.insert(at, f"ins{rnd.randrange(10**6)}")
        elif len(out) > 1:
            del out[at]
    return out


def corpus(seed=7):
    """Copies, near copies on both sides of the threshold, chains and shared passages."""
    rnd = random.Random(seed)

    def prose(n):
        return [f"w{rnd.randrange(3000)}" for _ in range(n)]
    texts = []
    for size in (1, 2, 3, 5, 11, 14, 20, 33, 60, 120, 400):
        base = prose(size)
        texts += [" ".join(base)] * 2 + [" ".join(edited(rnd, base, k)) for k in (1, 1, 2, 3, size // 60, size // 50)]
    walk = prose(200)
    for _ in range(25):                              # a chain: neighbours link, ends do not
        walk = edited(rnd, walk, 2)
        texts.append(" ".join(walk))
    shared = prose(80)                               # one passage in many otherwise different texts
    texts += [" ".join(shared + prose(rnd.choice((4, 9, 15)))) for _ in range(40)]
    rnd.shuffle(texts)
    return texts


def found(spark, texts, **columns):
    rows = nj.near_duplicates(docs_of(spark, texts)).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    return [got[i] for i in range(len(texts))]


def test_table_equals_sql(spark, sf_dir):
    problems, n = compare(spark, duck(sf_dir), QUERIES["op13_jaccard_join"], ORACLE["op13_jaccard_join"], sf_dir)
    assert not problems and n > 0


@pytest.mark.parametrize("block", [3, nj.BLOCK])
def test_components_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK", block)          # postings of many blocks
    texts = corpus()
    assert found(spark, texts) == plain(texts)


def test_linked_sets_share_a_signature(spark):
    rnd = random.Random(3)
    sizes = [10, 12, 13, 19, 25, 50, 99, 150, 320]
    pairs = []
    for size in sizes:
        for _ in range(40):
            a = [int(x) for x in np.random.default_rng(rnd.randrange(10**9)).integers(0, 2**64, size, dtype=np.uint64)]
            lost = rnd.randrange(0, size // 9 + 1)
            b = a[lost:] + [rnd.randrange(2**64) for _ in range(rnd.randrange(0, size // 9 + 1))]
            if similar(set(a), set(b)) and set(a) != set(b):
                pairs.append((np.unique(np.array(a, np.uint64)), np.unique(np.array(b, np.uint64))))
    assert len(pairs) > 50
    for a, b in pairs:
        parts = []
        for s in (a, b):
            band, low, high = nj.instances(len(s))
            parts.append({band: nj.part_digests(s, low), band + 1: nj.part_digests(s, high)})
        shared = parts[0].keys() & parts[1].keys()
        assert shared and any(
            all(x[i * nj.PARTS + p] == y[i * nj.PARTS + p] for p in subset)
            for j in shared for x, y in [(parts[0][j], parts[1][j])]
            for i in range(len(x) // nj.PARTS) for subset in nj._SUBSETS)


def test_bands_hold_linked_sizes():
    first, last = nj.bands(5000)
    assert first[0] == 1 and all(a == b + 1 for a, b in zip(first[1:], last))
    for n in range(1, 3000):
        least = -(-n * nj.NUM // nj.DEN)             # smallest partner
        assert nj.instances(n)[0] - nj.instances(least)[0] in (0, 1)


def test_edges(spark):
    long = "word " * 30_000 + "end"
    texts = [None, "", " \t\n", "One", "one", "a b", "A b", "x y z", "x  y\nz", long, long + " more", None]
    got = found(spark, texts)
    assert got == [(n, r if n else i) for i, (n, r) in enumerate(plain(texts))]
    assert got[0] == (0, 0) and got[11] == (0, 11) and got[4] == (1, 3) and got[9][0] == 2


def test_repeated_and_null_ids(spark):
    base = " ".join(f"w{i}" for i in range(50))
    docs = docs_of(spark, [base, base, base + " more", "other", None], [4, 4, 9, None, None])
    got = sorted(map(tuple, nj.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == sorted([(4, 48, 4), (4, 48, 4), (9, 49, 4), (None, 1, None), (None, 0, None)], key=repr)


def test_empty_table(spark):
    assert nj.near_duplicates(docs_of(spark, ["x"]).limit(0)).count() == 0
