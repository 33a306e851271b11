"""Shards by jump consistent hashing, in DataFrame expressions alone.

The jump function walks the shard counts 1, 2, 3, ... with a 64-bit congruential
generator seeded by the key and remembers the last count at which the key moved,
so no ring table exists and a key moves to a new shard with probability 1 / n
only when shard n is appended.  The 64-bit product is built from 16-bit halves,
because a plain one overflows.  Nothing is shuffled to find a shard; places
inside a shard come from one range shuffle of narrow rows (key, size, checksum),
never from a window over a shard, and equal keys are spread by a row number, so
neither a shard nor a hot key is held by one task.

Defined results: an integral key is taken as it stands, any other by its
XXH64, a null key counts as 0; a null text has no bytes; rows that repeat a key
get the same shard and places of their own; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import global_row_number
from .common import checkpointed, table

SHARDS = 24
ROW_BYTES = 8
# Fixed value: multiplier of the generator of jump consistent hashing.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF


def key_number(key: Column, kind: T.DataType) -> Column:
    """The 64-bit number that is hashed."""
    whole = isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    return F.coalesce(key.cast("long") if whole else F.when(key.isNotNull(), F.xxhash64(key)), F.lit(0).cast("long"))


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def _product(half: Column, factor: int) -> Column:
    """half * factor modulo 2^32 and a little more, for two 32-bit numbers."""
    return F.shiftleft(_low(F.shiftright(half, 16) * factor, 16), 16) + _low(half, 16) * factor


def _next(s: Column, shards: int) -> Column:
    """One step: the key moves to ``j``; key * MULTIPLIER + 1 modulo 2^64 from
    its halves gives the next count at which it moves."""
    t0 = _low(s["lo"], 16) * _LOW + 1
    t1 = F.shiftright(s["lo"], 16) * _LOW + F.shiftright(t0, 16)
    hi = _low(F.shiftright(t1, 16) + _product(s["hi"], _LOW) + _product(s["lo"], _HIGH), 32)
    moved = F.struct(
        hi.alias("hi"), F.shiftleft(_low(t1, 16), 16).bitwiseOR(_low(t0, 16)).alias("lo"),
        s["j"].alias("last"), s["last"].alias("before"),
        ((s["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1))).cast("long").alias("j"))
    return F.when(s["j"] > shards, s).otherwise(moved)


def jump(number: Column, shards: int) -> Column:
    """struct(shard, grown): the shard among ``shards`` and among one more."""
    start = F.struct(F.shiftrightunsigned(number, 32).alias("hi"), _low(number, 32).alias("lo"),
                     *[F.lit(v).cast("long").alias(n) for n, v in (("last", -1), ("before", -1), ("j", 0))])
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(shards)), start, lambda s, _: _next(s, shards),
        lambda s: F.struct(F.when(s["last"] == shards, s["before"]).otherwise(s["last"]).cast("int").alias("shard"),
                           s["last"].cast("int").alias("grown")))


def assign(docs: DataFrame, shards: int = SHARDS, key_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard``; no shuffle."""
    found = jump(key_number(F.col(key_col), docs.schema[key_col].dataType), shards)
    return docs.withColumn("shard", found["shard"]).withColumn("grown_shard", found["grown"])


def place(docs: DataFrame, shards: int = SHARDS, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per input row: key, size, checksum, shard, place in the
    shard (rows of a shard in the order of key, size and checksum)."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    narrow = assign(docs.select(
        F.col(key_col).alias("key"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row")), shards, "key")
    ranked = global_row_number(checkpointed(narrow), ["shard", "key", "size", "text_crc32", "row"], out="place")
    first = ranked.groupBy("shard").agg(F.min("place").alias("first"))        # one row per shard
    return ranked.join(F.broadcast(first), "shard").select(
        F.col("key").alias(key_col), "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key_col: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """The rows themselves as Parquet, a folder per shard.  Tasks write to the
    shards they meet (no shuffle); a shard has as many files as it needs."""
    assign(docs, shards, key_col).drop("grown_shard").write.option("maxRecordsPerFile", rows_per_file) \
        .partitionBy("shard").parquet(path)


def op13_jump_shards(spark, sf_dir) -> DataFrame:
    """All ``documents``, shards 0 to 23, law ``key``."""
    found = place(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
