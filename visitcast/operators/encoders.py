"""Categorical encoders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import global_row_number

def label_codes(values: DataFrame, col: str, code_col: str = "code") -> DataFrame:
    """Sorted distinct non-null values of ``col`` -> 0..k-1 (a dictionary frame)."""
    distinct = values.select(col).where(F.col(col).isNotNull()).distinct()
    return global_row_number(distinct, [col], out=code_col).select(col, F.col(code_col).cast("int"))


def multi_label_codes(df: DataFrame, cols: Sequence[str]) -> dict[str, DataFrame]:
    """Label codes of several columns from one global numbering:
    (column, value) pairs are numbered once, then shifted per column."""
    pairs = None
    for c in cols:
        p = df.select(F.lit(c).alias("_col"), F.col(c).cast("string").alias("_val")).where(F.col("_val").isNotNull())
        pairs = p if pairs is None else pairs.unionByName(p)
    numbered = global_row_number(pairs.distinct(), ["_col", "_val"], out="_rn")
    first = numbered.groupBy("_col").agg(F.min("_rn").alias("_first"))
    coded = numbered.join(F.broadcast(first), "_col").select(
        "_col", "_val", (F.col("_rn") - F.col("_first")).cast("int").alias("_code"))
    return {c: coded.where(F.col("_col") == c).select(F.col("_val").alias(c), F.col("_code").alias("code"))
            for c in cols}


def encode_labels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """E2 for several string columns with one numbering job."""
    codes = multi_label_codes(df, cols)
    out = df
    for c in cols:
        out = (out.join(codes[c].withColumnRenamed("code", "_code"), on=c, how="left")
                  .withColumn(c, F.col("_code")).drop("_code"))
    return out.select(*df.columns)


def encode_label(df: DataFrame, col: str) -> DataFrame:
    """Replace ``col`` by its rank among the sorted distinct values.
    Nulls stay null (the dictionary has no null entry)."""
    codes = label_codes(df, col, "_code")
    return (df.join(codes, on=col, how="left")
              .withColumn(col, F.col("_code")).drop("_code")
              .select(*df.columns))


def encode_joint(frames: Sequence[DataFrame], col: str) -> list[DataFrame]:
    """One label encoding over the union of several frames, values cast
    to string first (so "10" sorts before "2"); every frame gets the same codes."""
    as_str = [f.withColumn(col, F.col(col).cast("string")) for f in frames]
    union = as_str[0].select(col)
    for f in as_str[1:]:
        union = union.unionByName(f.select(col))
    codes = label_codes(union, col, "_code")
    return [f.join(codes, on=col, how="left").withColumn(col, F.col("_code")).drop("_code").select(*f.columns)
            for f in as_str]


def encode_onehot(df: DataFrame, col: str, values: Sequence | None = None) -> DataFrame:
    """Drop ``col`` and add one 0/1 column ``{col}_{value}`` per sorted
    distinct value; a null value gives 0 in every indicator.  The columns of the
    result are the values, so these are looked up first unless ``values`` names
    them (then no job runs, and a value not named gives 0 everywhere)."""
    if values is None:
        values = sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect())
    ind = [F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{col}_{v}") for v in values]
    return df.select(*[c for c in df.columns if c != col], *ind)
