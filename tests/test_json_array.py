"""Large array files: elements found by many tasks equal those of one parse."""

import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from trustframe.session import scratch_path
from trustframe.sources.json_array import elements
from trustframe.sources.raw_json import accepted_raw, read_raw_accounts, rejected_raw, unwrap_accounts


@pytest.fixture
def folder(spark):
    path = scratch_path(spark, f"tests/json-{uuid.uuid4().hex}").removeprefix("file:")
    os.makedirs(path)
    return path


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _put(folder, name, text):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def _value(rnd, depth=0):
    """JSON values with brackets, quotes and escapes in their texts."""
    kind = rnd.randrange(8 if depth < 3 else 5)
    if kind == 0:
        return rnd.randrange(10**6)
    if kind == 1:
        return rnd.choice([None, True, False, 1.5])
    if kind < 5:
        return "".join(rnd.choice(['}', '{', ']', '[', ',', '"', "\\", "é", "\n", "x", " ", "🙂"]) for _ in range(rnd.randrange(12)))
    if kind == 5:
        return [_value(rnd, depth + 1) for _ in range(rnd.randrange(4))]
    return {f"k{i}}}": _value(rnd, depth + 1) for i in range(rnd.randrange(4))}


def _found(spark, path):
    rows = elements(spark, path).orderBy("file", "idx").collect()
    return [(r["idx"], None if r["raw"] is None else json.loads(r["raw"])) for r in rows]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("indent", [None, 1])
def test_elements_equal_one_parse(spark, folder, small_splits, seed, indent):
    rnd = random.Random(seed)
    values = [_value(rnd) for _ in range(rnd.choice((1, 40, 120)))]
    values.insert(len(values) // 2, {"long": "}" * 3000, "deep": [[[{"a": ['"', "\\"]}]]]})
    _put(folder, "a.json", json.dumps(values, indent=indent, ensure_ascii=seed % 2 == 0))
    assert _found(spark, folder) == list(enumerate(values))
    assert spark.read.option("lineSep", "}").text(folder).rdd.getNumPartitions() > 1


def test_a_broken_off_file_keeps_its_whole_elements(spark, folder, small_splits):
    whole = [{"id": i, "t": "a}b" * (i % 7)} for i in range(60)]
    text = json.dumps(whole).encode()
    for cut in (*range(len(text) - 40, len(text)), 1, 200, 700, 1501):
        kept = 0
        for i in range(60):     # how many elements end before the cut
            end = len(json.dumps(whole[:i + 1])) - 1
            kept += end <= cut
        _put(folder, f"cut-{cut:06}.json", text[:cut])
        got = _found(spark, f"{folder}/cut-{cut:06}.json")
        assert got[:kept] == list(enumerate(whole[:kept])) and [v for _, v in got[kept:]] == [None], cut


def test_roots_and_trailing_text(spark, folder, small_splits):
    big = {"id": 1, "x": [{"y": "}"}] * 300}
    texts = {"a-object": "﻿\n " + json.dumps(big), "b-none": "[]", "c-blank": " \n", "d-empty": "",
             "e-scalars": '[1, "a}b", null, [], {}, "]"]', "f-two": '{"id": 1} {"id": 2}\n'}
    want = {"a-object": [big], "b-none": [], "c-blank": [], "d-empty": [],
            "e-scalars": [1, "a}b", None, [], {}, "]"], "f-two": [{"id": 1}, {"id": 2}]}
    for name, text in texts.items():
        _put(folder, name, text)
    for name in texts:
        assert [v for _, v in _found(spark, f"{folder}/{name}")] == want[name], name
    for text in ("no json } at { all }" * 100, '[{"id": 1}] tail } {' + "}" * 900):
        _put(folder, "odd", text)
        raw = [r["raw"] for r in elements(spark, f"{folder}/odd").orderBy("idx").collect()]
        assert raw[-1] is None and len(raw) == (2 if text[0] == "[" else 1)


def test_many_tasks_read_one_array_into_accounts(spark, folder, small_splits):
    accounts = [[i, {"id": i, "profile": {"description": "{[}]" * (i % 5)}}] if i % 2 else {"id": i} for i in range(300)]
    _put(folder, "a.json", json.dumps(accounts + [5, ["x"]]))
    u = unwrap_accounts(read_raw_accounts(spark, folder))
    ids = sorted(r[0] for r in accepted_raw(u).select(F.try_variant_get("obj", "$.id", "int")).collect())
    assert ids == list(range(300))
    assert sorted(r["idx"] for r in rejected_raw(u).collect()) == [300, 301]
