"""Text classification: cleaning, TF-IDF + logistic regression, batch predict."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

NUM_FEATURES = 1 << 18   # fixed value: hashed vocabulary size


def clean_text(col: str = "text") -> F.Column:
    """Lower-case and collapse whitespace (blank texts are rejected by validation).

    A run that is one space already is not matched: most are.
    """
    return F.trim(F.regexp_replace(F.lower(F.col(col)), r"[\t\n\x0B\f\r]\s*| \s+", " "))


def text_pipeline(label: str = "label") -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol="clean", outputCol="tokens", pattern=r"\W+", minTokenLength=2),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=NUM_FEATURES),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(labelCol=label, featuresCol="features", maxIter=100, regParam=0.01),
    ])


def train_text(docs: DataFrame, label: str = "label") -> PipelineModel:
    """The fitted pipeline; texts are cut into term counts once, and the later stages read those."""
    *cut, idf, lr = text_pipeline(label).getStages()
    counts = materialize(PipelineModel(cut).transform(docs.withColumn("clean", clean_text())).select(label, "tf"))
    fitted = Pipeline(stages=[idf, lr]).fit(counts)
    return PipelineModel([*cut, *fitted.stages])


def classify(model, docs: DataFrame) -> DataFrame:
    """predicted_label and confidence = max class probability."""
    p = model.transform(docs.withColumn("clean", clean_text()))
    return p.select(*[c for c in docs.columns if c != "text"],
                    F.col("prediction").cast("int").alias("predicted_label"),
                    F.array_max(vector_to_array("probability")).alias("confidence"))
