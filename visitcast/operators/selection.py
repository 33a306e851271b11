"""Feature and row selection.

Per-feature tables (correlations, similarities, scores) have one row per
feature column, so their size is bounded by the schema, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import show_workers_the_package

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.BooleanType, T.DecimalType)
# Fixed value: the columns that are never features.
DEFAULT_EXCLUDE = ("store_id", "visit_date", "visitors", "origin")


def safe_corr(x, y):
    """Pearson correlation that is NULL (not an ANSI division error) when a
    side is constant: covar_samp / (stddev_samp * stddev_samp)."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def numeric_feature_columns(df: DataFrame, exclude: Sequence[str] = DEFAULT_EXCLUDE) -> list[str]:
    """Every numeric (or boolean) column not excluded, in schema order."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in ex and isinstance(f.dataType, NUMERIC_TYPES)]


def numeric_projection(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Keep numeric columns; report the dropped ones."""
    keep = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
    dropped = [c for c in df.columns if c not in keep]
    return df.select(*keep), dropped


def missing_columns(frames: dict[str, DataFrame], expected: Sequence[str]) -> list[tuple[str, str]]:
    """(dataset, column) for every expected column a frame lacks."""
    return [(name, c) for name, f in frames.items() for c in expected if c not in f.columns]


def time_split(df: DataFrame, date_col: str = "visit_date", valid_days: int = 7) -> DataFrame:
    """K1: cutoff = the ``valid_days``-th latest distinct date; rows on or
    after it are validation.  Raises if there are not more distinct dates
    than ``valid_days``.  Adds boolean ``is_valid``."""
    dates = df.select(date_col).where(F.col(date_col).isNotNull()).distinct()
    latest = dates.orderBy(F.col(date_col).desc()).limit(valid_days + 1).collect()  # bounded: k+1 rows
    if len(latest) <= valid_days:
        raise ValueError(f"not enough dates for splitting: {len(latest)} distinct, "
                         f"{valid_days} requested for validation")
    cutoff = latest[valid_days - 1][0]
    return df.withColumn("is_valid", F.col(date_col) >= F.lit(cutoff))


def label_correlations(df: DataFrame, features: Sequence[str], label: str, by: str | None = None) -> DataFrame:
    """Pearson correlation of ``label`` with every feature, long form
    (``by``, feature, corr).  One aggregation pass, then an unpivot."""
    y = F.col(label).cast("double")
    aggs = [safe_corr(F.col(f).cast("double"), y).alias(f"c{i}") for i, f in enumerate(features)]
    wide = df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)
    stack = "stack({}, {}) AS (feature, corr)".format(
        len(features), ", ".join(f"'{f}', c{i}" for i, f in enumerate(features)))
    return wide.selectExpr(*([by] if by else []), stack)


def feature_similarity(source: DataFrame, target: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """D1 (+J6): similarity = 1 - |corr_source - corr_target| per feature."""
    cs = label_correlations(source, features, label).withColumnRenamed("corr", "corr_source")
    ct = label_correlations(target, features, label).withColumnRenamed("corr", "corr_target")
    return (cs.join(ct, "feature")
              .withColumn("similarity", F.lit(1.0) - F.abs(F.col("corr_source") - F.col("corr_target"))))


def _defined(c: str):
    return F.col(c).isNotNull() & ~F.isnan(F.col(c))


def _by_feature(sim: DataFrame | dict[str, float | None]) -> dict[str, float | None]:
    """Similarities by feature (one row per feature: bounded by the schema)."""
    if not isinstance(sim, dict):
        sim = {r["feature"]: r["similarity"] for r in sim.select("feature", "similarity").collect()}
    return {f: None if v is None or v != v else v for f, v in sim.items()}


def top_ratio_features(sim: DataFrame | dict[str, float | None], ratio: float) -> list[str]:
    """K4: the int(n * ratio) most similar features (n = all features).
    Ties break on the feature name; NaN/NULL similarity is never chosen and
    k = 0 chooses nothing (the original's [-0:] slice chose everything)."""
    found = _by_feature(sim)
    k = max(0, int(len(found) * ratio))
    return [f for _, f in sorted((-v, f) for f, v in found.items() if v is not None)[:k]]


def threshold_features(sim: DataFrame | dict[str, float | None], threshold: float) -> list[str]:
    """K5: features with similarity > threshold; all features if none pass."""
    found = _by_feature(sim)
    return sorted(f for f, v in found.items() if v is not None and v > threshold) or sorted(found)


def _pair_sums(x: np.ndarray, there: np.ndarray, y: np.ndarray, labelled: np.ndarray) -> np.ndarray:
    """(10, features): count, mean and centred squares of the feature's values;
    the same of the label's; count, both means and centred products of the pairs."""
    def centred(values, mask):
        n = mask.sum(axis=0)
        mean = np.where(mask, values, 0.0).sum(axis=0) / np.maximum(n, 1)
        return n, mean, np.where(mask, values - mean, 0.0)

    wide = np.broadcast_to(y[:, None], x.shape)
    n, mean, off = centred(x, there)
    m, centre, away = centred(y[:, None], labelled[:, None])
    if there.all() and labelled.all():
        k, mx, my, product = n, mean, np.full(len(n), centre[0]), off.T @ away[:, 0]
    else:
        k, mx, dx = centred(x, there & labelled[:, None])
        _, my, dy = centred(wide, there & labelled[:, None])
        product = (dx * dy).sum(axis=0)
    full = np.ones(len(n))
    return np.stack([n, mean, (off * off).sum(axis=0), full * m, full * centre, full * (away * away).sum(), k, mx, my, product]).astype(float)


def _joined_sums(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    """The sums of two sets of rows."""
    if a is None or b is None:
        return b if a is None else a
    out = np.empty_like(a)
    for at in (0, 3):
        n, m = a[at], b[at]
        share, step = m / np.maximum(n + m, 1), b[at + 1] - a[at + 1]
        out[at], out[at + 1] = n + m, a[at + 1] + step * share
        out[at + 2] = a[at + 2] + b[at + 2] + step * step * n * share
    n, m = a[6], b[6]
    share, dx, dy = m / np.maximum(n + m, 1), b[7] - a[7], b[8] - a[8]
    out[6], out[7], out[8] = n + m, a[7] + dx * share, a[8] + dy * share
    out[9] = a[9] + b[9] + dx * dy * n * share
    return out


def f_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Univariate regression F statistic per feature:
    F = r^2 / (1 - r^2) * (n - 2) with n the non-null pair count.

    One pass: tasks add up counts, means and centred sums of all features an
    Arrow batch at a time (hundreds of aggregates in one SQL aggregation run
    without compiled code) and Spark merges one small matrix a task in a tree."""
    spark, d = df.sparkSession, len(features)
    show_workers_the_package(spark)
    values = ", ".join(f"CAST(`{f}` AS DOUBLE)" for f in features)
    rows = df.select(F.expr(f"array({values})").alias("x"), F.col(label).cast("double").alias("y"))

    def sums(batches):
        import pyarrow as pa
        held = None
        for batch in batches:
            flat, y = batch.column("x").flatten(), batch.column("y")
            if len(y):
                with np.errstate(invalid="ignore", over="ignore"):
                    held = _joined_sums(held, _pair_sums(
                        flat.to_numpy(zero_copy_only=False).reshape(-1, d), flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, d),
                        y.to_numpy(zero_copy_only=False), y.is_valid().to_numpy(zero_copy_only=False)))
        if held is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([held.tobytes()], pa.binary())})

    total = None
    if d:
        total = rows.mapInArrow(sums, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"]).reshape(-1, d)) \
            .treeAggregate(None, _joined_sums, _joined_sums)
    found = []
    for i, f in enumerate(features):
        n, _, xx, m, _, yy, pairs, _, _, xy = total[:, i] if total is not None else np.zeros(10)
        r = None
        if n > 1 and m > 1 and pairs > 1:
            spread = np.sqrt(xx / (n - 1)) * np.sqrt(yy / (m - 1))
            r = float(xy / (pairs - 1) / spread) if spread != 0 else None
        score = None if r is None or 1 - r * r == 0 else r * r / (1 - r * r) * (pairs - 2)
        found.append((f, r, int(pairs), None if score is None else float(score)))
    return spark.createDataFrame(found, "feature string, r double, n long, f_score double")


def f_score_topk(df: DataFrame, features: Sequence[str], label: str, k: int = 30) -> DataFrame:
    """The k features with the largest F statistic (name breaks ties)."""
    return (f_scores(df, features, label).where(_defined("f_score"))
            .orderBy(F.col("f_score").desc(), F.col("feature")).limit(k))
