"""Grouped aggregates joined back to a frame.

Two families with the same statistics:

* ``merge_agg``: aggregate a frame by ``keys`` and left-join the result back to
  the same frame; nothing is filled, a null key gets a null.
* ``feat_agg``: aggregate ``df_feature`` by ``keys`` and left-join to another
  frame, then fill nulls with 0 (the whole frame's numeric columns by default).

Every statistic is a built-in Spark aggregate with map-side partial
aggregation, so a hot key never moves its raw rows to one task before being
combined.  The kernel median is the exception that needs ranks; it first
collapses each group to its distinct values with multiplicities (partial
aggregation again), then ranks those with a running window, optionally inside
value ranges of the group (see ``operators.windows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATS = ("count", "nunique", "median", "mean", "sum", "max", "min", "std", "var", "quantile", "kermed")

# Output suffix of each statistic in default feature names.  Fixed value: the
# kernel median is named with the "mean" suffix.
SUFFIX = {s: s for s in STATS}
SUFFIX["kermed"] = "mean"


# Value ranges of the rank statistics: a group that holds a large share of all
# rows is ranked in so many tasks (None: one task per group).
SPLIT_RANGES = 64


def stat_expr(fn: str, value: str, q: float | None = None) -> Column:
    v = F.col(value)
    if fn == "count":
        return F.count(v)
    if fn == "nunique":
        return F.countDistinct(v)
    if fn == "median":
        return F.median(v)
    if fn == "mean":
        return F.avg(v)
    if fn == "sum":
        # pandas sums an all-null group to 0
        return F.coalesce(F.sum(v), F.lit(0))
    if fn == "max":
        return F.max(v)
    if fn == "min":
        return F.min(v)
    if fn == "std":
        return F.stddev_samp(v)
    if fn == "var":
        return F.var_samp(v)
    if fn == "quantile":
        if q is None:
            raise ValueError("quantile needs q")
        # exact, linear interpolation (pandas default)
        return F.percentile(v, F.lit(float(q)))
    raise ValueError(f"unknown statistic {fn!r}")


def _not_null(keys) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def grouped(df: DataFrame, keys: list[str], value: str, fn: str, out: str, q: float | None = None,
            split_ranges: int | None = SPLIT_RANGES) -> DataFrame:
    """One statistic per non-null key group (pandas drops null keys)."""
    keys = list(keys)
    if fn in ("kermed", "median", "quantile"):
        # rank statistics: distinct values + spillable running windows (and
        # value ranges for hot keys) instead of one in-memory map per group
        return rank_statistic(df, keys, value, fn, out, q, split_ranges)
    src = df.where(_not_null(keys)).select(*keys, value)
    return src.groupBy(*keys).agg(stat_expr(fn, value, q).alias(out))


def merge_agg(df: DataFrame, keys: list[str], value: str, fn: str, cname: str, q: float | None = None,
              split_ranges: int | None = SPLIT_RANGES) -> DataFrame:
    """A1-A9 ``merge_*``: aggregate ``df`` and join the statistic back to it.
    ``split_ranges`` value ranges split hot groups of the rank statistics."""
    return df.join(grouped(df, keys, value, fn, cname, q, split_ranges), on=list(keys), how="left")


def feat_agg(df: DataFrame, df_feature: DataFrame, keys: list[str], value: str, fn: str,
             name: str = "", q: float | None = None, fill_all: bool = True,
             split_ranges: int | None = SPLIT_RANGES) -> DataFrame:
    """A1-A11 ``feat_*``: aggregate ``df_feature``, left-join to ``df``, fill 0.
    ``split_ranges`` value ranges split hot groups of the rank statistics."""
    keys = list(keys)
    out = name or f"{value}_{'_'.join(keys)}_{SUFFIX[fn]}"
    res = df.join(grouped(df_feature, keys, value, fn, out, q, split_ranges), on=keys, how="left")
    if fill_all:
        return res.na.fill(0)
    return res.withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def _wrap_merge(fn):
    def f(df, columns, value, cname):
        return merge_agg(df, columns, value, fn, cname)
    f.__name__ = f"merge_{fn}"
    f.__doc__ = f"merge_{fn}(df, columns, value, cname): {fn} by columns joined back, no fill."
    return f


def _wrap_feat(fn):
    def f(df, df_feature, fe, value, name=""):
        return feat_agg(df, df_feature, fe, value, fn, name)
    f.__name__ = f"feat_{fn}"
    f.__doc__ = f"feat_{fn}(df, df_feature, fe, value, name=''): {fn} of df_feature joined, nulls -> 0."
    return f


merge_count = _wrap_merge("count")
merge_nunique = _wrap_merge("nunique")
merge_median = _wrap_merge("median")
merge_mean = _wrap_merge("mean")
merge_sum = _wrap_merge("sum")
merge_max = _wrap_merge("max")
merge_min = _wrap_merge("min")
merge_std = _wrap_merge("std")
merge_var = _wrap_merge("var")

feat_count = _wrap_feat("count")
feat_nunique = _wrap_feat("nunique")
feat_median = _wrap_feat("median")
feat_mean = _wrap_feat("mean")
feat_sum = _wrap_feat("sum")
feat_max = _wrap_feat("max")
feat_min = _wrap_feat("min")
feat_std = _wrap_feat("std")
feat_var = _wrap_feat("var")
feat_kermed = _wrap_feat("kermed")


def feat_quantile(df, df_feature, fe, value, n, name=""):
    return feat_agg(df, df_feature, fe, value, "quantile", name, q=n)


# ---------------------------------------------------------------------------
# Kernel median
# ---------------------------------------------------------------------------

def rank_statistic(df: DataFrame, keys: list[str], value: str, fn: str, out: str, q: float | None = None,
                   split_ranges: int | None = SPLIT_RANGES) -> DataFrame:
    """kermed, median or q-quantile per non-null key group, exact."""
    from .windows import membership_stats, value_cuts
    if fn == "quantile" and q is None:
        raise ValueError("quantile needs q")
    cuts = value_cuts(df.where(F.col(value).isNotNull()), value, split_ranges) if split_ranges else None
    return membership_stats(df, list(keys), value, [(None, "TRUE")], [fn], lambda s, w: out,
                            value_bounds=cuts, q=0.5 if q is None else float(q))


def kernel_median(df: DataFrame, keys: list[str], value: str, out: str = "kermed",
                  split_ranges: int | None = SPLIT_RANGES) -> DataFrame:
    """Exact kernel median of ``value`` per non-null key group.

    n = 1: x; n = 2: the mean; n >= 3: Epanechnikov weights on the ranks,
    w_k = 1 + 1.5 (n-1)/(n-2) (1 - u_k^2), u_k = (k - (n-1)/2) / ((n-1)/2).
    Computed by the fused window operator with one all-rows set: distinct
    values with multiplicities (partial aggregation first), ranks by a running
    window, closed form from the rank moments.  ``split_ranges`` splits every
    group into that many value ranges for the rank step (for hot keys).
    """
    return rank_statistic(df, keys, value, "kermed", out, None, split_ranges)
