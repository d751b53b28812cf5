"""Token alignment against both libraries and plain loops over whole texts."""

import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trustframe.llm import token_alignment as ta
from trustframe.llm.queries import QUERIES

from .test_operators import docs_of, table

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain():
    """Groups of a whole text, by loops over token byte ends."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    names = {i: e for e, i in a.get_vocab().items()}
    letters = ta.byte_letters()

    def groups(text):
        if not text:
            return []
        of_a = [(i, bytes(letters[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        of_b = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            of_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        if not (b"".join(x for _, x in of_a) == b"".join(x for _, x in of_b) == (" " + text).encode()):
            return []
        out, ga, gb, ea, eb, j = [], [], [], 0, 0, 0
        for i, x in of_a:
            ga.append(i)
            ea += len(x)
            while j < len(of_b) and eb < ea:
                gb.append(of_b[j][0])
                eb += len(of_b[j][1])
                j += 1
            if ea == eb:
                out.append((ga, gb))
                ga, gb = [], []
        return out

    return groups


def expected(groups_of):
    """doc -> the query's columns, with corpus counts over all given groups."""
    links = {d: collections.Counter((x, y) for a, b in g for x in a for y in b) for d, g in groups_of.items()}
    held = collections.Counter(p for c in links.values() for p in c)
    most = collections.defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return {d: (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links[d].values()),
                sum(n for p, n in links[d].items() if held[p] == most[p[0]]),
                sum(n * held[p] for p, n in links[d].items()),
                hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b))
                                        for a, b in g).encode()).hexdigest() if g else "")
            for d, g in groups_of.items()}


COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [None, "", " ", "a", "  two  spaces ", " lead", "trail ", "tab\there \n\n new\r\nline \x0b x", "naïve café – ﬁ ½",
         "日本語 テキスト 🙂🙂 👩‍👩‍👧 x", "<|endoftext|> <s> </s> <unk> <0x0A> ▁ ▁▁a", "\x00 nul \x1f unit\x85 next　wide",
         "I'll don't they've 's", "a" * 5000, "ab " * 3000, "one\ntwo\n\nthree \nfour\n five\n", "\nlead", "\n", "x\n's y\n're\n\tz",
         "x\u2028y z\nw\x00\nv", "🙂" * 400, "don't stop " * 2000, "same words", "same words"]


def test_table(spark, sf_dir, plain):
    want = expected({r["doc_id"]: plain(r["text"]) for r in table(spark, sf_dir, "documents")})
    got = QUERIES["op12_token_alignment"](spark, sf_dir).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COLS) for r in got} == want


@pytest.mark.parametrize("limit", [0, ta.BROADCAST_PAIRS])
def test_edges_and_both_joins(spark, plain, limit):
    docs = docs_of(spark, TEXTS).withColumnRenamed("fp", "pairs").withColumnRenamed("range", "n_a")
    want = expected({i: plain(t) for i, t in enumerate(TEXTS)})
    got = {r["doc_id"]: tuple(r[c] for c in COLS)
           for r in ta.scored(docs, A, B, ["doc_id", "pairs", "n_a"], broadcast_pairs=limit).collect()}
    assert got == want
    assert got[0] == got[1] == (0, 0, 0, 0, 0, 0, "")


def test_groups_are_those_of_the_library(spark, plain):
    rows = ta.align(docs_of(spark, TEXTS), A, B, ["doc_id"]).collect()
    assert {r["doc_id"]: [(g["a"], g["b"]) for g in r["groups"]] for r in rows} == \
        {i: plain(t) for i, t in enumerate(TEXTS)}


def test_a_small_memo_changes_nothing(monkeypatch, plain):
    monkeypatch.setattr(ta, "MEMO_PARTS", 2)
    of = ta.Aligner(A, B)
    for _ in range(2):
        for t in TEXTS[3:]:
            found = of.align([t.encode(), b"other words"])
            assert ";".join(p[0] for p in found[0]) == ";".join(
                ",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in plain(t))


def test_bytes_that_are_no_text_have_no_tokens():
    assert ta.Aligner(A, B).align([b"\xff\xfe", b"ok"])[0] == []


def test_cuts_are_common_ends():
    assert list(ta.cuts([1, 3, 6], [2, 3, 6])) == [(3, 0, 2, 0, 2), (6, 2, 3, 2, 3)]
    assert list(ta.cuts([4], [1, 2, 4])) == [(4, 0, 1, 0, 3)] and list(ta.cuts([], [])) == []


def test_repeated_rows_and_empty_table(spark, plain):
    twice = docs_of(spark, ["a b", "a b", "a b"], [5, 5, None])
    got = sorted(map(tuple, ta.scored(twice, A, B, ["doc_id"]).select("doc_id", "n_a", "count_sum").collect()), key=repr)
    n = sum(len(a) for a, _ in plain("a b"))
    assert got == sorted([(5, n, 6), (5, n, 6), (None, n, 6)], key=repr)
    assert ta.scored(twice.limit(0), A, B, ["doc_id"]).count() == 0
