"""Scores and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.selection import safe_corr


def rmsle(pred: DataFrame, label: str = "visitors", prediction: str = "prediction", by: str | None = None) -> DataFrame:
    """sqrt(mean((y - yhat)^2)); labels are already log1p."""
    e = F.sqrt(F.avg(F.pow(F.col(label) - F.col(prediction), 2))).alias("rmsle")
    return pred.groupBy(by).agg(e) if by else pred.agg(e)


def r_squared(pred: DataFrame, label: str = "visitors", prediction: str = "prediction", by: str | None = None) -> DataFrame:
    """Squared Pearson correlation of label and prediction."""
    e = F.pow(safe_corr(F.col(label), F.col(prediction)), 2).alias("r2")
    return pred.groupBy(by).agg(e) if by else pred.agg(e)


def leaderboard(scores: DataFrame) -> DataFrame:
    """K2 + A18: (method, rmsle) sorted ascending with rank and the best flag.
    One row per method, so the ranking window is bounded by the method count."""
    w = Window.orderBy(F.col("rmsle").asc_nulls_last(), F.col("method"))
    return (scores.withColumn("rank", F.row_number().over(w).cast("int"))
            .withColumn("is_best", (F.col("rank") == 1) & F.col("rmsle").isNotNull())
            .orderBy("rank"))


def scores_frame(spark: SparkSession, results: dict[str, float | None], status: dict[str, str] | None = None) -> DataFrame:
    """Leaderboard input from a dict of method -> rmsle (None = failed)."""
    status = status or {}
    rows = [(m, None if v is None else float(v), status.get(m, "ok" if v is not None else "failed"))
            for m, v in results.items()]
    return spark.createDataFrame(rows, "method string, rmsle double, status string")


def stage_gains(stages: DataFrame) -> DataFrame:
    """Per stage, RMSLE, gain over the previous stage and over the first.
    Input (stage int, name string, rmsle double): one row per stage."""
    w = Window.orderBy("stage")
    first = F.first("rmsle").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (stages.withColumn("gain", F.lag("rmsle").over(w) - F.col("rmsle"))
            .withColumn("total_gain", first - F.col("rmsle")))


def feature_importance(spark: SparkSession, model, features: Sequence[str], top: int = 20) -> DataFrame:
    """M21 + K3: the ``top`` largest importances with their feature names."""
    imp = model.importances()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature")).limit(top)


def ensemble_mean(preds: Sequence[DataFrame], keys: Sequence[str], col: str = "prediction") -> DataFrame:
    """Row-wise mean of several prediction frames (union + groupBy)."""
    u = None
    for i, p in enumerate(preds):
        part = p.select(*keys, F.col(col).cast("double").alias("_p"))
        u = part if u is None else u.unionByName(part)
    return u.groupBy(*keys).agg(F.avg("_p").alias(col))
