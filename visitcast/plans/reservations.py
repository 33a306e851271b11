"""Reservation consolidation and booking features."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..operators.windows import explode_origins, trailing_stats, value_cuts

# Booking windows (days before the origin) of W6.
RESERVE_WINDOWS = (35, 63, 140)
HEAD = ["store_id", "visit_dt", "reserve_dt", "reserve_visitors"]


def translate_ids(second: DataFrame, relation: DataFrame) -> DataFrame:
    """Map second-system ids to store ids; unmapped bookings drop out."""
    return (relation.join(second, on="other_id", how="inner")
            .select(F.col("source_id").alias("store_id"), "visit_dt", "reserve_dt", "reserve_visitors"))


def consolidate(first: DataFrame, second: DataFrame, relation: DataFrame) -> DataFrame:
    """Union both systems on one header and sum per (store, visit, booking)."""
    both = first.select(*HEAD).unionByName(translate_ids(second, relation).select(*HEAD))
    return (both.groupBy("store_id", "visit_dt", "reserve_dt")
            .agg(F.sum("reserve_visitors").alias("reserve_visitors")))


def with_lead(res: DataFrame) -> DataFrame:
    """P5: lead days = visit date - booking date."""
    return res.withColumn("lead", F.datediff("visit_dt", "reserve_dt"))


def point_features(res: DataFrame, label_origin, test_begin: dt.date, reserve_as_of_origin: bool = True,
                   split_ranges: int | None = 64) -> list[tuple[list[str], DataFrame]]:
    """Booking statistics for the label day itself.

    Label slices tile the timeline, so a booking's visit day names its origin
    (no join); it counts for that origin only if booked before it (or, with
    ``reserve_as_of_origin=False``, any time for the test origin, as the
    original pipeline did).
    Returns [(join keys, frame)] with keys in label column names.
    The (origin, day) key pools every store's bookings of a day, so its
    kernel median ranks inside value ranges (``split_ranges``).
    """
    r = with_lead(res).withColumn("origin", label_origin(F.col("visit_dt")))
    keep = F.col("reserve_dt") < F.col("origin")
    if not reserve_as_of_origin:
        keep = keep | (F.col("origin") == F.lit(test_begin))
    r = r.where(F.col("origin").isNotNull() & keep).withColumnRenamed("visit_dt", "visit_date")
    k_store = ["origin", "store_id", "visit_date"]
    k_date = ["origin", "visit_date"]
    lead = trailing_stats(r, k_store, "lead", [None], ["sum", "kermed"],
                          name=lambda s, w: {"sum": "air_reserve_datetime_diff_sum",
                                             "kermed": "air_reserve_datetime_diff_mean"}[s])
    vis = trailing_stats(r, k_store, "reserve_visitors", [None], ["sum", "kermed"],
                         name=lambda s, w: {"sum": "air_reserve_visitors_sum",
                                            "kermed": "air_reserve_visitors_mean"}[s])
    cuts = value_cuts(r, "reserve_visitors", split_ranges) if split_ranges else None
    day = trailing_stats(r, k_date, "reserve_visitors", [None], ["sum", "kermed"],
                         name=lambda s, w: {"sum": "air_date_reserve_visitors_sum",
                                            "kermed": "air_date_reserve_visitors_mean"}[s],
                         value_bounds=cuts)
    return [(k_store, lead), (k_store, vis), (k_date, day)]


POINT_COLUMNS = ["air_reserve_datetime_diff_sum", "air_reserve_datetime_diff_mean",
                 "air_reserve_visitors_sum", "air_reserve_visitors_mean",
                 "air_date_reserve_visitors_sum", "air_date_reserve_visitors_mean"]


def window_feature_names(windows: Sequence[int] = RESERVE_WINDOWS) -> list[str]:
    out = []
    for w in windows:
        for key in ("weekday", "holiday"):
            for stat in ("sum", "mean", "count"):
                out.append(f"air_reserve_visitors_{stat}_{key}_mean_{w}")
    return out


def window_features(res: DataFrame, calendar: DataFrame, origins: Sequence[dt.date], test_begin: dt.date,
                    reserve_as_of_origin: bool = True, windows: Sequence[int] = RESERVE_WINDOWS) -> list[tuple[list[str], DataFrame]]:
    """Two-level booking windows.

    Level 1: per (origin, store, visit day) and booking window w (booking day
    within w days before the origin): sum, count and kernel median of booked
    visitors.  Level 2: mean of those per (origin, store, weekday) and per
    (origin, store, holiday) of the visit day, over the visit days that have a
    booking in w.
    """
    leak = [] if reserve_as_of_origin else [test_begin]
    r = explode_origins(res, "reserve_dt", origins, lookback=max(windows), lookahead_any=leak, gap_col="r_gap")
    lvl1 = trailing_stats(r, ["origin", "store_id", "visit_dt"], "reserve_visitors", windows,
                          ["sum", "count", "kermed"], name=lambda s, w: f"_{s}_{w}", gap_col="r_gap")
    cal = calendar.select(F.col("visit_date").alias("visit_dt"), "holiday_flg")
    lvl1 = (lvl1.join(cal, on="visit_dt", how="left")
                .withColumn("holiday_flg", F.coalesce("holiday_flg", F.lit(-1)))
                .withColumn("weekday", dates.weekday("visit_dt"))
                .withColumn("holiday", dates.holiday_from_weekday("weekday", "holiday_flg")))
    outs = []
    for key in ("weekday", "holiday"):
        aggs = []
        for w in windows:
            has = F.col(f"_count_{w}") > 0
            aggs += [F.avg(F.when(has, F.col(f"_sum_{w}"))).alias(f"air_reserve_visitors_sum_{key}_mean_{w}"),
                     F.avg(F.when(has, F.col(f"_kermed_{w}"))).alias(f"air_reserve_visitors_mean_{key}_mean_{w}"),
                     F.avg(F.when(has, F.col(f"_count_{w}"))).alias(f"air_reserve_visitors_count_{key}_mean_{w}")]
        keys = ["origin", "store_id", key]
        outs.append((keys, lvl1.groupBy(*keys).agg(*aggs)))
    return outs
