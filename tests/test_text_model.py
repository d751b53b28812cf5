import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from trustframe.functions.text import strip_ws
from trustframe.operators.validation import validate_text
from trustframe.plans import text_model as TM

ODD = ["", " ", None, "a", " a ", "\n", "\x1c\x85\xa0 　", "​", "\x00", " \n\t x　", "\x0b\x0c", "é",
       "\U0001f600", "a  b", "a \n b", "a\n\nb", "\t a\x0b \r\nb  ", "A\xa0B", " \n", "a b c", "x\r\ny", "  a b  "]


def test_blank_texts_and_collapsed_spaces(spark):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choices(" \n\t\x0b\x0c\r\xa0\x85aB", k=12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = validate_text(df).select(
        "text", "is_valid", "reject_reason",
        (F.length(strip_ws(F.coalesce("text", F.lit("")))) > 0).alias("want_valid"),
        TM.clean_text().alias("clean"),
        F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")).alias("want_clean")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["is_valid"] == r["want_valid"] == (r["reject_reason"] is None), r
        assert r["clean"] == r["want_clean"], r


def test_the_fit_cuts_texts_once(spark, monkeypatch):
    """Every stage after the term counts reads them back; the model is that of the plain pipeline."""
    docs = spark.createDataFrame(
        [(i, f"good fine word{i % 7}  text" if i % 2 else f"bad\nawful word{i % 5} text", float(i % 2))
         for i in range(60)], "doc_id long, text string, label double")
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        seen.add(1)
        return text

    texts = docs.withColumn("text", F.udf(counted, "string")("text"))
    model = TM.train_text(texts.select("doc_id", "text", "label"))
    assert seen.value == 60
    assert isinstance(model, PipelineModel) and len(model.stages) == 4
    plain = TM.text_pipeline().fit(docs.withColumn("clean", TM.clean_text()))
    rows = [{r["doc_id"]: (r["predicted_label"], r["confidence"])
             for r in TM.classify(m, docs.select("doc_id", "text")).collect()} for m in (model, plain)]
    assert rows[0].keys() == rows[1].keys() and len(rows[0]) == 60
    for i, (label, confidence) in rows[0].items():
        assert label == rows[1][i][0] == i % 2 and confidence == pytest.approx(rows[1][i][1], abs=1e-9)
