"""Exact global row numbers without a single-partition window.

``Window.orderBy(..)`` with no partition key runs in one task.  Here the rows
are range-partitioned on the order key (balanced by sampling) and sorted inside
each partition; ``monotonically_increasing_id`` then holds the partition and
the place in it, and the row counts of the preceding partitions (a table with
one row per partition, so its broadcast size is bounded by the partition
count) make the places global.  One shuffle in all.  The sorted frame is
checkpointed to the shared checkpoint folder first, so both uses see the same
numbers even if tasks are retried on other executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def global_row_number(df: DataFrame, order_cols: Sequence[str], out: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    """0-based row number over a total order given by ``order_cols``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
        .withColumn("_id", F.monotonically_increasing_id()).checkpoint(eager=True)
        .withColumn("_pid", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
                  .withColumn(out, F.col("_off") + F.col("_place"))
                  .drop("_id", "_pid", "_place", "_off"))
