"""The same fit and predict steps with a linear model from Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_logistic(
    docs: DataFrame, num_features: int = 1 << 12, max_iter: int = 20, reg: float = 0.01
) -> PipelineModel:
    """Fit on ``docs(label, tokens)``, always from scratch."""
    stages = [
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(maxIter=max_iter, regParam=reg, family="multinomial"),
    ]
    return Pipeline(stages=stages).fit(docs.select("label", "tokens"))


def predict_logistic(docs: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``probs`` and ``prediction`` to ``docs(tokens, …)``."""
    out = model.transform(docs.select(*docs.columns))
    return out.select(
        *docs.columns,
        vector_to_array("probability").alias("probs"),
        F.col("prediction").cast("int").alias("prediction"),
    )
