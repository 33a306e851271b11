"""Sample weights.

Means per part (train/valid, domain) are a groupBy with partial aggregation
whose result has one row per part, joined back (AQE broadcasts it after
measuring it), so no window ever holds a whole part in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the weighting rules.
RECENCY_EPS = 1e-8
SOURCE_DOMAIN_WEIGHT = 0.5
TARGET_DOMAIN_WEIGHT = 1.0
WDA_SOURCE_FACTOR = 0.3
WDA_TARGET_FACTOR = 0.7


def normalize_by_part_mean(df: DataFrame, col: str, part: str | None) -> DataFrame:
    """Divide ``col`` by its mean within each value of ``part`` (or overall)."""
    # One row per part value (train / valid, domain): a bound of the caller's
    # column, so the means are broadcast and no row is shuffled.
    if not part:
        mean = df.agg(F.avg(col)).first()[0]  # one number
        return df.withColumn(col, F.col(col) / F.lit(mean))
    means = df.groupBy(part).agg(F.avg(col).alias("_mean"))
    return df.join(F.broadcast(means), on=part, how="left").withColumn(col, F.col(col) / F.col("_mean")).drop("_mean")


def recency_weight(df: DataFrame, gap_col: str = "day_gap", part: str | None = "is_valid",
                   eps: float = RECENCY_EPS, out: str = "weight") -> DataFrame:
    """M1: w = 1 / (1 + |gap| + eps), divided by its mean within each part."""
    w = df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.abs(F.col(gap_col)) + F.lit(eps)))
    return normalize_by_part_mean(w, out, part)


def domain_weights(source: DataFrame, target: DataFrame, out: str = "weight",
                   source_w: float = SOURCE_DOMAIN_WEIGHT, target_w: float = TARGET_DOMAIN_WEIGHT) -> DataFrame:
    """Union of both domains, weight 0.5 source / 1.0 target, over the global mean."""
    both = (source.withColumn(out, F.lit(source_w)).withColumn("domain", F.lit("source"))
            .unionByName(target.withColumn(out, F.lit(target_w)).withColumn("domain", F.lit("target"))))
    return normalize_by_part_mean(both, out, None)


def weighted_da_weights(source: DataFrame, target: DataFrame, gap_col: str = "day_gap", out: str = "weight",
                        source_f: float = WDA_SOURCE_FACTOR, target_f: float = WDA_TARGET_FACTOR,
                        eps: float = RECENCY_EPS) -> DataFrame:
    """Recency weights normalized within each domain, times 0.3 (source)
    or 0.7 (target), then the union."""
    s = recency_weight(source, gap_col, None, eps, out).withColumn(out, F.col(out) * source_f)
    t = recency_weight(target, gap_col, None, eps, out).withColumn(out, F.col(out) * target_f)
    return s.withColumn("domain", F.lit("source")).unionByName(t.withColumn("domain", F.lit("target")))
