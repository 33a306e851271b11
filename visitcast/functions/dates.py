"""Scalar column expressions (P3-P12).  All are built-in Spark expressions,
so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month lengths used by days_to_side (February is always 28),
# day-of-month bucket limits and the day-name numbering.
MONTH_DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
FIRST_BUCKET_LAST_DAY = 7     # day <= 7  -> 0
LAST_BUCKET_FIRST_DAY = 24    # day >= 24 -> 2, else 1
DAY_NUMBER = {"Monday": 1, "Tuesday": 2, "Wednesday": 3, "Thursday": 4,
              "Friday": 5, "Saturday": 6, "Sunday": 7}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def guarded_log1p(c) -> Column:
    """log1p(x) for x > 0, else 0 (null and NaN give 0)."""
    x = _c(c).cast("double")
    return F.when(x > 0, F.log1p(x)).otherwise(F.lit(0.0))


def to_day(c) -> Column:
    """Date part of a timestamp or 'yyyy-MM-dd HH:mm:ss' string."""
    return F.to_date(_c(c))


def day_gap(date_col, origin_col) -> Column:
    """Signed days from origin to date; negative is the past."""
    return F.datediff(_c(date_col), _c(origin_col))


def weekday(c) -> Column:
    """Monday = 0."""
    return F.weekday(_c(c))


def day_bucket(c) -> Column:
    """Third of the month: 0, 1 or 2."""
    d = F.dayofmonth(_c(c))
    return (F.when(d <= FIRST_BUCKET_LAST_DAY, 0)
            .when(d >= LAST_BUCKET_FIRST_DAY, 2).otherwise(1))


def days_to_side(c) -> Column:
    """P10: min(day, month length - day), with February fixed at 28 days."""
    d = F.dayofmonth(_c(c))
    month_len = F.element_at(F.array(*[F.lit(n) for n in MONTH_DAYS]), F.month(_c(c)))
    return F.least(d, month_len - d)


def day_number(c) -> Column:
    """Day name -> 1..7; unknown names give NULL."""
    m = F.create_map(*[x for k, v in DAY_NUMBER.items() for x in (F.lit(k), F.lit(v))])
    return m[_c(c)]


def holiday_from_number(dow, flg) -> Column:
    """P12 (calendar form): weekend (day number >= 6) or flag 1; null compares false."""
    return (F.coalesce(_c(dow) >= 6, F.lit(False)) | F.coalesce(_c(flg) == 1, F.lit(False))).cast("int")


def holiday_from_weekday(wd, flg) -> Column:
    """P12 (weekday form): weekday >= 5 (Mon = 0) or flag 1."""
    return (F.coalesce(_c(wd) >= 5, F.lit(False)) | F.coalesce(_c(flg) == 1, F.lit(False))).cast("int")
