"""The corpus pipeline against a brute-force version of each stage on its own input."""

import hashlib
import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from .test_operators import (docs_of, groups_plain, hits_plain, reference_codec, simhash_plain,
                             table)
from .test_pii import plain


def test_stages_on_the_small_tables(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "personal_data", "tokens"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)

    clean = stage["toxicity"](spark, docs, sf_dir)
    assert clean.columns == docs.columns
    assert clean.count() >= 0.8 * docs.count()

    rows = docs.orderBy("doc_id").collect()
    one = stage["near_duplicates"](spark, docs, sf_dir)
    assert one.columns == docs.columns
    ids = [r["doc_id"] for r in rows]
    groups = groups_plain(ids, [simhash_plain(r["text"]) for r in rows])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(groups))

    left = stage["decontamination"](spark, docs, sf_dir)
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark")]
    want = hits_plain([(r["doc_id"], r["text"]) for r in rows], items)
    assert {r["doc_id"] for r in left.collect()} == {i for i, w in want.items() if not w[4]}

    masked = {r["doc_id"]: r for r in stage["personal_data"](spark, docs, sf_dir).collect()}
    assert len(masked) == len(rows)
    for r in rows:
        text = masked[r["doc_id"]]["text"]
        assert masked[r["doc_id"]]["n_chars"] == len(text)
        if not plain(r["text"]) and not re.search("[A-Z]{2}[0-9]{2}", r["text"]):
            assert text == r["text"]
        for s, _, e, kind in plain(r["text"]):
            assert kind == "ip" or r["text"][s:e] not in text


def test_run_ends_with_the_tokens_of_what_is_left(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents")}
    enc = reference_codec()
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(out) < len(docs)
    same = 0
    for r in out:
        ids = enc.encode_ordinary(docs[r["doc_id"]])
        same += r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert plain(docs[r["doc_id"]]) or r["n_tokens"] > 0
    assert same >= 0.5 * len(out)


def test_stages_on_edge_rows(spark, sf_dir):
    rnd = random.Random(1)
    texts = [None, "", " ", "same text here " * 30, "same text here " * 30, "mail a@b.example now",
             " ".join(rnd.choice("abcdefgh") for _ in range(20_000))]
    docs = docs_of(spark, texts, [0, None, 2, 3, 3, 5, 6]).withColumn("n_chars", F.lit(0).cast("long"))
    for name, f in corpus_pipeline.STAGES:
        got, none = f(spark, docs, sf_dir), f(spark, docs.limit(0), sf_dir)
        assert none.count() == 0
        if name != "tokens":
            assert got.columns == docs.columns
        assert got.count() == (4 if name == "near_duplicates" else 7), name
