"""Readers and sinks.

Parquet is the format between stages; CSV only where the modelled workflow
reads or writes CSV.  Every path is expected on shared storage.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schemas of the CSV inputs of the modelled workflow (FIXTURES.md section 1).
RESERVE_SCHEMA = T.StructType([
    T.StructField("air_store_id", T.StringType()), T.StructField("visit_datetime", T.TimestampType()),
    T.StructField("reserve_datetime", T.TimestampType()), T.StructField("reserve_visitors", T.LongType())])
# The same with the times as the text 'date time' they come as.
RAW_RESERVE_SCHEMA = T.StructType([
    T.StructField("air_store_id", T.StringType()), T.StructField("visit_datetime", T.StringType()),
    T.StructField("reserve_datetime", T.StringType()), T.StructField("reserve_visitors", T.DoubleType())])
VISIT_SCHEMA = T.StructType([
    T.StructField("air_store_id", T.StringType()), T.StructField("visit_date", T.DateType()),
    T.StructField("visitors", T.LongType())])
DATE_INFO_SCHEMA = T.StructType([
    T.StructField("calendar_date", T.DateType()), T.StructField("day_of_week", T.StringType()),
    T.StructField("holiday_flg", T.IntegerType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: CSV with a header and a declared schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename columns by position (``toDF``)."""
    if len(names) != len(df.columns):
        raise ValueError(f"expected {len(df.columns)} names, got {len(names)}")
    return df.toDF(*names)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header (small reports or interchange only)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines report sink."""
    df.write.mode(mode).json(path)


def is_materialized(spark: SparkSession, path: str) -> bool:
    """True when a previous job finished writing ``path`` (its _SUCCESS marker
    exists), through the Hadoop file system of the session (any shared store)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def materialize(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> DataFrame:
    """Write ``df`` once; if a finished copy exists, reuse it.  Returns a
    frame reading the stored copy (lineage cut at the file boundary)."""
    spark = df.sparkSession
    if not is_materialized(spark, path):
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.format(fmt).save(path)
    return spark.read.format(fmt).load(path)


def write_feature_tables(features: DataFrame, relation: DataFrame, path: str, test_begin,
                         mode: str = "overwrite") -> None:
    """One Parquet table partitioned by domain and split, so a reader of
    one domain x split prunes to its folder."""
    ids = relation.select(F.col("source_id").alias("store_id")).distinct().withColumn("_t", F.lit(True))
    out = (features.join(ids, "store_id", "left")
           .withColumn("domain", F.when(F.col("_t"), "target").otherwise("source")).drop("_t")
           .withColumn("split", F.when(F.col("origin") == F.lit(test_begin), "test").otherwise("train")))
    out.write.mode(mode).partitionBy("domain", "split").parquet(path)


def load_feature_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The feature tables by (domain, split); partition pruning keeps each
    read to its own folder."""
    base = spark.read.parquet(path)
    return {f"{d}_{s}": base.where((F.col("domain") == d) & (F.col("split") == s)).drop("domain", "split")
            for d in ("source", "target") for s in ("train", "test")}


def fingerprint(df: DataFrame, *parameters) -> str:
    """A name for the content of a frame and the parameters of a stage.
    Schema, row count and the sum of the rows' hashes (one pass, whatever the
    order of rows) go into it, so a changed row gives another name."""
    columns = ", ".join(f"`{c}`" for c in df.columns)
    n, total = df.selectExpr("count(*)", f"sum(CAST(xxhash64({columns}) AS DECIMAL(38, 0)))").first()
    return hashlib.sha256(repr((df.schema.simpleString(), n, total, parameters)).encode()).hexdigest()[:24]


def materialize_by_content(df: DataFrame, folder: str, *parameters) -> tuple[DataFrame, str]:
    """The stored copy of exactly these rows under ``folder``; written if
    there is none yet.  Returns it and its path."""
    path = f"{folder.rstrip('/')}/{fingerprint(df, *parameters)}"
    return materialize(df, path), path
