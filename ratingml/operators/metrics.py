"""Scores as aggregations, and timing of an action."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rmse(df: DataFrame, label: str = "rating", pred: str = "pred") -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(pred) - F.col(label), 2))).alias("rmse"))


def rmsle(df: DataFrame, label: str = "rating", pred: str = "pred") -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.log1p(pred) - F.log1p(label), 2))).alias("rmsle"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.agg(F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"))


def regression_evaluator(label: str = "rating", pred: str = "pred") -> RegressionEvaluator:
    return RegressionEvaluator(labelCol=label, predictionCol=pred, metricName="rmse")


def classification_evaluator(
    label: str = "label", pred: str = "pred", metric: str = "accuracy"
) -> MulticlassClassificationEvaluator:
    """``metric`` may also be "f1" or "weightedPrecision"."""
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol=pred, metricName=metric)


def evaluator_for(kind: str) -> Evaluator:
    return classification_evaluator() if kind == "classifier" else regression_evaluator()


def fit_report(model, sets: dict[str, DataFrame], label: str = "rating", pred: str = "pred") -> DataFrame:
    """RMSE of a fitted model on each named data set, as ``(set, rmse)``."""
    rows = [rmse(model.transform(df), label, pred).select(F.lit(name).alias("set"), "rmse") for name, df in sets.items()]
    return reduce(DataFrame.unionByName, rows)


def timed(spark: SparkSession, action: Callable[[], object], info: str) -> tuple[object, DataFrame]:
    """Result of ``action`` and one row ``(info, seconds)``."""
    start = time.perf_counter()
    result = action()
    seconds = time.perf_counter() - start
    return result, spark.createDataFrame([(info, seconds)], "info string, seconds double")
