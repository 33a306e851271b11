import datetime as dt
import math

from pyspark.sql import functions as F

from visitcast.functions import dates


def _one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_guarded_log(spark):
    got = _one(spark, dates.guarded_log1p("x"), [(-1.0,), (0.0,), (math.e - 1,), (None,)], "x double")
    assert got[0] == 0 and got[1] == 0 and abs(got[2] - 1) < 1e-12 and got[3] == 0


def test_feb29_and_month_edges(spark):
    days = [dt.date(2016, 2, 29), dt.date(2017, 1, 1), dt.date(2017, 1, 7), dt.date(2017, 1, 8),
            dt.date(2017, 1, 23), dt.date(2017, 1, 24), dt.date(2017, 1, 31)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    rows = df.select(dates.days_to_side("d").alias("s"), dates.day_bucket("d").alias("b")).collect()
    assert rows[0]["s"] == -1 and rows[0]["b"] == 2          # Feb 29: February fixed at 28 days
    assert [r["b"] for r in rows[1:]] == [0, 0, 1, 1, 2, 2]  # days 1, 7, 8, 23, 24, 31


def test_weekday_monday_zero(spark):
    got = _one(spark, dates.weekday("d"), [(dt.date(2017, 3, 6),), (dt.date(2017, 3, 12),)], "d date")
    assert got == [0, 6]


def test_day_number_and_holiday(spark):
    df = spark.createDataFrame([("Saturday", 0), ("Monday", 1), ("Monday", 0), ("Noday", None)], "n string, f int")
    rows = df.select(dates.day_number("n").alias("k"),
                     dates.holiday_from_number(dates.day_number("n"), "f").alias("h")).collect()
    assert [r["k"] for r in rows] == [6, 1, 1, None]
    assert [r["h"] for r in rows] == [1, 1, 0, 0]   # null compares as false
