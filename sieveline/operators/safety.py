"""A safety classifier trained on labelled texts: the in-house stand-in for an external safety model."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows learned from at most: those whose hashed id is smallest.
SAMPLE = 50_000


def train_safety_classifier(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
                            sample: int = SAMPLE, features: int = 1 << 16) -> PipelineModel:
    """Logistic regression over hashed words, with both labels weighing the same.

    Rows without a text, or labelled neither 0 nor 1, are not learned from; of the texts of one id, one is. The same rows give
    the same model.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64(key), key, "label").limit(sample)
    # One text of an id, so that an id of very many rows stays one example.
    texts = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("text")).join(F.broadcast(chosen.select(key).distinct()), key)
    one = texts.groupBy(key).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.join(F.broadcast(chosen), key).persist(StorageLevel.MEMORY_AND_DISK)
    share = rows.agg(F.avg("label")).first()[0]
    try:
        if share is None or share in (0.0, 1.0):
            raise ValueError("labelled texts of both kinds are needed")
        weighed = rows.withColumn("weight", F.when(F.col("label") == 1, 1 - share).otherwise(share))
        return Pipeline(stages=[
            RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}]+", toLowercase=True),
            HashingTF(inputCol="words", outputCol="features", numFeatures=features, binary=True),
            LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=40)]).fit(weighed)
    finally:
        rows.unpersist()


def score_safety(model: PipelineModel, docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, unsafe_score, unsafe`` for every row; a null text counts as empty."""
    given = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    scored = model.transform(given).select(key, vector_to_array("probability")[1].alias("unsafe_score"))
    return scored.withColumn("unsafe", F.col("unsafe_score") >= 0.5)
