"""Noise classifier: TF-IDF over words and word pairs, linear support vector machine."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 18


def train(rows: DataFrame, text: str = "text", label: str = "label") -> PipelineModel:
    """Fit on (text, label 0/1). Hashing keeps the model's size fixed however large the vocabulary is."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_w0", pattern=r"\b\w\w+\b", gaps=False, toLowercase=True),
        StopWordsRemover(inputCol="_w0", outputCol="_w1"),
        NGram(n=2, inputCol="_w1", outputCol="_w2"),
        SQLTransformer(statement="SELECT *, concat(_w1, _w2) AS _terms FROM __THIS__"),
        HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=FEATURES),
        IDF(inputCol="_tf", outputCol="_idf", minDocFreq=1),
        Normalizer(inputCol="_idf", outputCol="_x"),
        LinearSVC(featuresCol="_x", labelCol=label, maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(rows.withColumn(label, F.col(label).cast("double")))


def margins(model: PipelineModel, rows: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, margin); margin is null when the text has no known feature, which keeps the text."""
    scored = model.transform(rows.select(id_col, F.col(text).alias("text")))
    margin = vector_to_array("rawPrediction")[1]
    # a text without a known feature is a zero vector, whose margin is exactly the intercept
    return scored.select(id_col, F.when(margin != F.lit(model.stages[-1].intercept), margin).alias("margin"))


def keep(model: PipelineModel, rows: DataFrame, id_col: str, text: str = "text", floor: float = -0.8) -> DataFrame:
    return margins(model, rows, id_col, text).withColumn("keep", F.col("margin").isNull() | (F.col("margin") > floor))
