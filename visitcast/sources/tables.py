"""S1 catalog load and the domain views over the driver tables.

Every domain table is a lazy DataFrame derived from the given parquet tables,
so all work grows with them.  Mapping (see FIXTURES.md section 3):

store(store_id, genre, area)                supplier JOIN nation
visits(store_id, visit_date, visitors)      lineitem per (supplier, ship day)
reservations(store_id, visit_dt, reserve_dt, reserve_visitors, system)
                                            lineitem JOIN orders, ship >= order
relation(source_id, other_id)               stores with suppkey % 5 = 0
calendar(visit_date, day_of_week, holiday_flg)  distinct ship days
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed values of the fixture mapping.
GENRE_MODULUS = 7          # genre = 'G' || (suppkey % 7)
TARGET_MODULUS = 5         # target-domain stores: suppkey % 5 = 0
OTHER_ID_PREFIX = "h_"     # id of a target store in the second booking system
TEST_BEGIN = dt.date(2001, 10, 1)
NDAY = 35
HISTORY_DAYS = 420
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    """One lazy parquet scan per named table."""
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return s.join(n, s.s_nationkey == n.n_nationkey, "inner").select(
        F.col("s_suppkey").alias("store_id"),
        F.concat(F.lit("G"), (F.col("s_suppkey") % GENRE_MODULUS).cast("string")).alias("genre"),
        F.col("n_name").alias("area"),
    )


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (
        li.groupBy(F.col("l_suppkey").alias("store_id"), F.to_date("l_shipdate").alias("visit_date"))
        .agg(F.sum("l_quantity").alias("visitors"))
    )


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey, "inner")
        .where(F.col("l_shipdate") >= F.col("o_orderdate"))
        .select(
            F.col("l_suppkey").alias("store_id"),
            F.to_date("l_shipdate").alias("visit_dt"),
            F.to_date("o_orderdate").alias("reserve_dt"),
            F.col("l_quantity").alias("reserve_visitors"),
            (F.col("l_linenumber") % 2).alias("system"),
        )
    )


def booking_systems(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two booking systems: system 0 keyed by store id, system 1 by its own id."""
    r = reservations(spark, sf_dir)
    first = r.where("system = 0").select("store_id", "visit_dt", "reserve_dt", "reserve_visitors")
    second = r.where("system = 1").select(
        F.concat(F.lit(OTHER_ID_PREFIX), F.col("store_id").cast("string")).alias("other_id"),
        "visit_dt", "reserve_dt", "reserve_visitors")
    return first, second


def relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    return s.where(F.col("s_suppkey") % TARGET_MODULUS == 0).select(
        F.col("s_suppkey").alias("source_id"),
        F.concat(F.lit(OTHER_ID_PREFIX), F.col("s_suppkey").cast("string")).alias("other_id"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("visit_date")).distinct()
    return d.select(
        "visit_date",
        F.date_format("visit_date", "EEEE").alias("day_of_week"),
        F.when(F.dayofmonth("visit_date") == 1, 1).otherwise(0).cast("int").alias("holiday_flg"),
    )


def origin_dates(test_begin: dt.date = TEST_BEGIN, nday: int = NDAY, history_days: int = HISTORY_DAYS) -> list[dt.date]:
    """test_begin - i for i = nday, 2*nday, ... history_days, then test_begin."""
    steps = range(nday, nday * (history_days // nday + 1), nday)
    return [test_begin - dt.timedelta(days=i) for i in steps] + [test_begin]


def origins(spark: SparkSession, sf_dir: str | None = None, test_begin: dt.date = TEST_BEGIN,
            nday: int = NDAY, history_days: int = HISTORY_DAYS) -> DataFrame:
    """W1 as a frame; the list has history_days // nday + 1 entries (parameter bound)."""
    rows = [(d, d == test_begin) for d in origin_dates(test_begin, nday, history_days)]
    return spark.createDataFrame(rows, "origin date, is_test boolean")
