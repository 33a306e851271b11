"""The feature pipeline (W1-W10): raw daily tables -> one feature table for
every forecast origin, in one Spark job.

Row identity: (origin, store_id, visit_date).  Train origins are
test_begin - nday*i (i = 1 .. history_days // nday); their label slices
(0 <= day_gap < nday) tile the past, so each train visit belongs to exactly
one origin, computed from its date.  The test origin is test_begin; its
labels are all visits from test_begin on.

Plan shape
----------
* labels: a column expression assigns the origin -- no join.
* history: each past visit is paired with the origins after it by a
  generator over the 13-entry origin list -- no join, no shuffle.
* one fused ``trailing_stats`` per key set without the store (4 for W8, 1 for
  W5) and booking key set (1+2 for W6, 2 for W5), each two shuffles, the first
  after partial aggregation.
* store-keyed visit statistics (3 for W8, 2 for W7) by ``partition_stats``: no
  visit is paired with the origins, no shuffle but that of the results.
* every store-keyed result is partitioned by (origin, store_id), as are the
  labels, so their joins need no further exchange; the other key sets are a
  few rows per origin and AQE broadcasts them after measuring them.
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions import dates
from ..operators.encoders import encode_labels
from ..operators.joins import broadcast_checked
from ..operators.windows import explode_origins, partition_stats, segmented, trailing_stats, value_cuts
from ..session import partitioned_checkpoint, reliable_checkpoint
from ..sources import tables
from . import reservations as R

# Trailing visit windows (days) and the W8 column catalogue
# (key set, name prefix, statistics in output order).
VISIT_WINDOWS = (21, 35, 63, 140, 280, 350, 420)
W8_CATALOGUE = [
    (("store_id",), "air", ("median", "mean", "kermed", "max", "min", "std", "count")),
    (("store_id", "weekday"), "air_week", ("kermed", "max", "min", "std", "count")),
    (("store_id", "holiday"), "air_holiday", ("kermed", "max", "min", "count")),
    (("genre", "holiday"), "air_genre_name_holiday", ("kermed", "max", "min", "count")),
    (("genre", "weekday"), "air_genre_name_weekday", ("kermed", "max", "min", "count")),
    (("area", "holiday"), "air_area_name_holiday", ("kermed", "max", "min", "count")),
    (("area", "genre", "holiday"), "air_area_genre_name_holiday", ("kermed", "max", "min", "count")),
]
# All-history kernel medians by (store, month third, weekday / holiday).
W7_CATALOGUE = [
    (("store_id", "day", "weekday"), "air_day_mean"),
    (("store_id", "day", "holiday"), "air_holiday_mean"),
]
THREADS = 4
LOOKUP_COLUMNS = ["genre", "area", "holiday_flg", "holiday"]
BASE_COLUMNS = ["origin", "store_id", "visit_date", "day_gap", "visitors", "weekday", "day",
                "days_to_side", "genre", "area", "holiday_flg", "holiday"]


@dataclass
class Inputs:
    visits: DataFrame          # store_id, visit_date, visitors (raw counts)
    reservations: DataFrame    # store_id, visit_dt, reserve_dt, reserve_visitors (consolidated)
    store: DataFrame           # store_id, genre, area (strings)
    calendar: DataFrame        # visit_date, day_of_week (name), holiday_flg


def fixture_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    first, second = tables.booking_systems(spark, sf_dir)
    res = R.consolidate(first, second, tables.relation(spark, sf_dir))
    return Inputs(tables.visits(spark, sf_dir), res, tables.store(spark, sf_dir), tables.calendar(spark, sf_dir))


def encoded_store(store: DataFrame) -> DataFrame:
    """Store attributes with genre and area label-encoded."""
    return encode_labels(store.select("store_id", "genre", "area"), ["genre", "area"])


def calendar_facts(calendar: DataFrame) -> DataFrame:
    """visit_date, holiday_flg, holiday (weekend by day number or flag)."""
    return calendar.select(
        "visit_date", F.col("holiday_flg").cast("int").alias("holiday_flg"),
        dates.holiday_from_number(dates.day_number("day_of_week"), "holiday_flg").alias("holiday"))


def decorate(df: DataFrame, store_enc: DataFrame, cal: DataFrame, date_col: str = "visit_date") -> DataFrame:
    """Weekday, month-third bucket, days_to_side, store attributes and
    calendar facts; lookup misses become -1.

    Only the looked-up columns are filled: the other columns of the frames
    decorated here hold no nulls, and rewriting a key column (even by a no-op
    coalesce) would make Spark forget the frame's store partitioning."""
    out = (df.withColumn("weekday", dates.weekday(date_col))
             .withColumn("day", dates.day_bucket(date_col))
             .withColumn("days_to_side", dates.days_to_side(date_col))
             .join(store_enc, on="store_id", how="left")
             .join(cal.withColumnRenamed("visit_date", date_col), on=date_col, how="left"))
    return out.na.fill(-1, subset=LOOKUP_COLUMNS)


def label_origin_fn(test_begin: dt.date, nday: int, history_days: int):
    n_orig = history_days // nday

    def label_origin(date: Column) -> Column:
        d = F.datediff(F.lit(test_begin), date)
        i = F.ceil(d / F.lit(nday)).cast("int")
        return (F.when(d <= 0, F.lit(test_begin))
                 .when(d <= n_orig * nday, F.date_sub(F.lit(test_begin), i * nday)))
    return label_origin


def feature_columns(nday_windows=VISIT_WINDOWS, reserve_windows=R.RESERVE_WINDOWS) -> list[str]:
    cols = list(R.POINT_COLUMNS) + R.window_feature_names(reserve_windows)
    cols += [name for _, name in W7_CATALOGUE]
    for w in nday_windows:
        for _, prefix, stats in W8_CATALOGUE:
            cols += [f"{prefix}_{s}_{w}" for s in stats]
    return cols


class FeatureJob:
    """Builds the shared frames once; each part is a (join keys, frame) pair
    that can be joined to the labels alone (tests, checks) or all together."""

    def __init__(self, inp: Inputs, test_begin: dt.date = tables.TEST_BEGIN, nday: int = tables.NDAY,
                 history_days: int = tables.HISTORY_DAYS, reserve_as_of_origin: bool = True,
                 windows=VISIT_WINDOWS, checkpoint: bool = True, split_ranges: int | None = 64):
        self.inp = inp
        self.split_ranges = split_ranges
        self._visit_cuts = None
        self.test_begin = test_begin
        self.reserve_as_of_origin = reserve_as_of_origin
        self.windows = tuple(windows)
        self.partitions = int(inp.visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.origins = tables.origin_dates(test_begin, nday, history_days)
        self.label_origin = label_origin_fn(test_begin, nday, history_days)
        store_enc = encoded_store(inp.store)
        # One row per calendar day: checked, then broadcast so that joining it
        # keeps the store partitioning below.
        self.cal = broadcast_checked(calendar_facts(inp.calendar))

        # The only shuffle of the visit history: by store.  A store has at most
        # one row per day, so no store is a hot key.  Every store-keyed
        # statistic and every join back to the labels runs inside this
        # partitioning.
        vis = (inp.visits.select("store_id", "visit_date", dates.guarded_log1p("visitors").alias("visitors"))
               .repartition(self.partitions, "store_id"))
        base = decorate(vis, store_enc, self.cal)
        if checkpoint:
            # Cut the lineage once in the shared checkpoint folder: every part
            # below reads these rows instead of repeating the scan, aggregation
            # and lookups, and a lost executor does not recompute them.  The
            # checkpoint keeps the store partitioning.
            base = partitioned_checkpoint(base)
        self.base = base
        # Consolidated bookings feed five parts: computed once, lineage cut.
        # They keep their (store, visit day, booking day) distribution: one
        # store may hold a large share of all bookings, so they are not
        # partitioned by store.
        self.reservations = reliable_checkpoint(inp.reservations) if checkpoint else inp.reservations
        labels = (base.withColumn("origin", self.label_origin(F.col("visit_date")))
                      .where(F.col("origin").isNotNull())
                      .withColumn("day_gap", F.datediff("visit_date", "origin")))
        self.labels = labels.select(*BASE_COLUMNS)
        hist = base.where(F.col("visit_date") < F.lit(test_begin))
        # Only the longest window back from each origin: older pairs would be
        # built and thrown away.
        self.hist = explode_origins(hist, "visit_date", self.origins, lookback=max(self.windows))

    @property
    def visit_cuts(self) -> list[float]:
        """Value ranges for key sets that can be hot (no store in the key)."""
        if self._visit_cuts is None:
            self._visit_cuts = value_cuts(self.base, "visitors", self.split_ranges)
        return self._visit_cuts

    def w8(self, index: int) -> tuple[list[str], DataFrame]:
        keys, prefix, stats = W8_CATALOGUE[index]
        k = ["origin", *keys]
        name = lambda s, w: f"{prefix}_{s}_{w}"
        if "store_id" in keys:
            return k, partition_stats(self.base, keys, "visitors", "visit_date", self.origins, self.windows, stats, name)
        # Pooled over stores: summed up by segment first, then paired with the
        # origins, so no visit is copied.
        past = self.base.where(F.col("visit_date") < F.lit(self.test_begin))
        parts = segmented(past, keys, "visitors", "visit_date", self.origins, self.windows)
        hist = explode_origins(parts, "visit_date", self.origins, lookback=max(self.windows))
        return k, trailing_stats(hist, k, "visitors", self.windows, stats, name, count_col="n_rows",
                                 value_bounds=self.visit_cuts if self.split_ranges else None)

    def w7(self) -> list[tuple[list[str], DataFrame]]:
        """All history before each origin."""
        return [(["origin", *keys], partition_stats(self.base, keys, "visitors", "visit_date", self.origins, [None], ["kermed"],
                                                    lambda s, w, name=name: name)) for keys, name in W7_CATALOGUE]

    def w5(self) -> list[tuple[list[str], DataFrame]]:
        return R.point_features(self.reservations, self.label_origin, self.test_begin,
                                self.reserve_as_of_origin, self.split_ranges)

    def w6(self) -> list[tuple[list[str], DataFrame]]:
        return R.window_features(self.reservations, self.cal, self.origins, self.test_begin, self.reserve_as_of_origin)

    def by_store(self, parts: list[tuple[list[str], DataFrame]]) -> list[tuple[list[str], DataFrame]]:
        """Parts with the store, moved to the labels' store partitioning."""
        return [(k, f.repartition(self.partitions, "store_id") if "store_id" in k else f) for k, f in parts]

    def all_parts(self) -> list[tuple[list[str], DataFrame]]:
        return self.w5() + self.w6() + self.w7() + [self.w8(i) for i in range(len(W8_CATALOGUE))]

    def table(self, parts=None, base_columns=BASE_COLUMNS) -> DataFrame:
        """Labels left-joined with ``parts`` (all by default); missing -> 0.

        Parts without the store (rows per origin and dictionary entry) come
        first, while the label rows are narrow: their size is checked, then
        they are broadcast, so the labels keep their store partitioning for the
        store-keyed parts.
        """
        parts = self.all_parts() if parts is None else parts
        parts = sorted(self.by_store(parts), key=lambda p: "store_id" in p[0])
        out = self.labels
        feats: dict[str, str] = {}
        # The pooled parts are small jobs of many stages: they run side by side.
        with ThreadPoolExecutor(THREADS) as pool:
            checked = inheritable_thread_target(out.sparkSession)(broadcast_checked)
            pooled = [pool.submit(checked, frame) for keys, frame in parts if "store_id" not in keys]
            pooled = [p.result() for p in pooled]
        for i, (keys, frame) in enumerate(parts):
            # The statistics of a part travel as one struct: a join copies a few
            # fields a row, not the hundreds of columns joined before it.
            names = [c for c in frame.columns if c not in keys]
            frame = (pooled[i] if i < len(pooled) else frame).select(*keys, F.struct(*names).alias(f"_part{i}"))
            if "store_id" in keys:
                # Hash the (narrow) part per partition and stream the labels: a
                # sort-merge join would re-sort the label rows at every step.
                frame = frame.hint("shuffle_hash")
            out = out.join(frame, on=keys, how="left")
            feats |= {c: f"_part{i}" for c in names}
        canonical = [c for c in feature_columns(self.windows) if c in feats]
        types = {c: t for _, f in parts for c, t in f.dtypes}
        zero = {"double": "if(isnan({0}), 0.0D, coalesce({0}, 0.0D))", "bigint": "coalesce({0}, 0L)"}
        return out.selectExpr(*base_columns, *[zero[types[c]].format(f"`{feats[c]}`.`{c}`") + f" AS `{c}`" for c in canonical])


def feature_table(inp: Inputs, test_begin: dt.date = tables.TEST_BEGIN, nday: int = tables.NDAY,
                  history_days: int = tables.HISTORY_DAYS, reserve_as_of_origin: bool = True,
                  windows=VISIT_WINDOWS) -> DataFrame:
    """Every label row of every origin with all features."""
    return FeatureJob(inp, test_begin, nday, history_days, reserve_as_of_origin, windows).table()


def split(features: DataFrame, test_begin: dt.date = tables.TEST_BEGIN) -> tuple[DataFrame, DataFrame]:
    """(train, test) by origin."""
    is_test = F.col("origin") == F.lit(test_begin)
    return features.where(~is_test), features.where(is_test)
