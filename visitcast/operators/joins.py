"""Join helpers (J1-J5 building blocks)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

# Byte bound under which a frame of fixed-width columns is broadcast.
BROADCAST_BYTES = 64 << 20


def broadcast_checked(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` (fixed-width columns) only after its size is known.

    The frame is checkpointed in the shared folder, so the check and the join
    read the same rows; its size is its rows times eight bytes a column.  Above
    the bound it is returned without a hint and joined by shuffling.
    """
    df = reliable_checkpoint(df)
    return F.broadcast(df) if df.count() * 8 * (len(df.columns) + 1) <= max_bytes else df


def lookup_fill(df: DataFrame, lookup: DataFrame, on, fill: int = -1) -> DataFrame:
    """J2/J3 + P13: left lookup join; every numeric null of the result -> ``fill``."""
    return df.join(lookup, on=on, how="left").na.fill(fill)


def domain_split(df: DataFrame, members: DataFrame, key: str, member_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in ``members`` (target) and the rest (source).

    Semi/anti joins on the distinct member ids; no NOT IN, so a null member id
    cannot empty the source side.  Rows with a null key go to the source side.
    """
    ids = members.select(F.col(member_key or key).alias(key)).where(F.col(key).isNotNull()).distinct()
    return df.join(ids, on=key, how="left_semi"), df.join(ids, on=key, how="left_anti")


def domain_tag(df: DataFrame, members: DataFrame, key: str, member_key: str | None = None, out: str = "domain") -> DataFrame:
    """J5 in one pass: ``out`` is 'target' for rows whose key is in ``members``
    and 'source' for all others (null keys, too)."""
    ids = members.select(F.col(member_key or key).alias(key)).where(F.col(key).isNotNull()).distinct().withColumn("_member", F.lit(True))
    return df.join(ids, on=key, how="left").withColumn(out, F.when(F.col("_member"), "target").otherwise("source")).drop("_member")
