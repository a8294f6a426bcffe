"""A linear baseline trained on Spark, and scoring with any model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_baseline(train: DataFrame, columns: Sequence[str], label: str = "label_y", rounds: int = 20) -> PipelineModel:
    """Logistic regression on standardised columns of labelled rows."""
    rows = train.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in columns], (F.col(label) > 0.5).cast("double").alias("_label"))
    stages = [
        VectorAssembler(inputCols=list(columns), outputCol="_raw_x", handleInvalid="skip"),
        StandardScaler(inputCol="_raw_x", outputCol="_x", withMean=True),
        LogisticRegression(featuresCol="_x", labelCol="_label", rawPredictionCol="_margin", probabilityCol="_p", predictionCol="_y", regParam=1e-3, maxIter=rounds),
    ]
    return Pipeline(stages=stages).fit(rows)


def score_baseline(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows).withColumn("logit", vector_to_array("_margin")[1])
    return out.drop("_raw_x", "_x", "_margin", "_p", "_y")


def score_with(rows: DataFrame, columns: Sequence[str], predict: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """rows' trade_uid and a logit from the caller's own function of feature columns,
    a batch at a time."""
    names = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"trade_uid": b["trade_uid"], "logit": predict(b[names]).to_numpy(float)})

    return rows.select("trade_uid", *names).mapInPandas(run, "trade_uid string, logit double")
