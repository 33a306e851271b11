"""Origin-relative trailing windows, fused.

A forecast origin sees only its past.  Instead of a loop that re-scans the
history once per origin, each history row is paired with the origins it
precedes by a generator over the (parameter-bounded) origin list -- no join
and no shuffle -- and ``origin`` becomes one more grouping key.

Key sets that pool many stores are summed up before they meet the origins
(``segmented``): all window bounds cut the timeline into segments, a window is a
union of whole segments, and a segment's rows with the same keys and value are
one row with a multiplicity, so the history itself is never copied.

``trailing_stats`` computes, for one key set, every statistic of every
nested trailing window in one pass:

1. ``groupBy(keys, value)`` with one multiplicity per window (rows with
   ``gap >= -w``).  Partial aggregation runs before the shuffle, so a hot key
   or a hot value is collapsed where it is read.
2. Over the distinct values of a group, one ordered running window gives the
   number of smaller values per window (rank offsets) and one unordered
   window gives totals and means.  Both share the hash partitioning of step 3.
3. ``groupBy(keys)`` turns ranks and multiplicities into count, mean, max,
   min, sample std, exact median and the kernel median.

Memory per group in steps 2-3 is the number of distinct values of the group,
the same bound as Spark's own exact ``percentile``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import show_workers_the_package

WINDOW_STATS = ("count", "sum", "mean", "max", "min", "std", "median", "quantile", "kermed")


def origins_array(origins: Sequence[dt.date]) -> Column:
    return F.array(*[F.lit(o) for o in origins])


def explode_origins(df: DataFrame, date_col: str, origins: Sequence[dt.date],
                    lookback: int | None = None, lookahead_any: Sequence[dt.date] = (),
                    gap_col: str = "day_gap") -> DataFrame:
    """Pair each row with every origin t with date < t (and
    date >= t - lookback when given).  Origins listed in ``lookahead_any``
    take every row within the lookback, also rows on or after them.

    Adds ``origin`` and ``gap_col`` = days(date - origin) (< 0 is the past).
    The origin list is a parameter (13 dates), so the expansion factor is bounded.
    """
    d = F.col(date_col)
    leak = set(lookahead_any)

    def keep(t: Column) -> Column:
        past = t > d
        if leak:
            past = past | F.array_contains(origins_array(sorted(leak)), t)
        if lookback is not None:
            past = past & (d >= F.date_sub(t, lookback))
        return past

    return (df.withColumn("origin", F.explode(F.filter(origins_array(origins), keep)))
              .withColumn(gap_col, F.datediff(d, F.col("origin"))))


def segmented(df: DataFrame, keys: Sequence[str], value: str, date_col: str, origins: Sequence[dt.date],
              windows: Sequence[int], count_col: str = "n_rows") -> DataFrame:
    """Rows (keys, value, date_col, count_col): how many rows have these keys
    and value between two neighbouring window bounds; ``date_col`` is the lower
    one.  An origin or a window's first day is a bound, so a row lies in a
    window exactly if its segment does.  Rows before the first bound are in no
    window and left out."""
    bounds = sorted({t for t in origins} | {t - dt.timedelta(days=w) for t in origins for w in windows})
    first = F.array_max(F.filter(origins_array(bounds), lambda b: b <= F.col(date_col)))
    return (df.withColumn(date_col, first).where(F.col(date_col).isNotNull())
            .groupBy(*keys, value, date_col).agg(F.count(F.lit(1)).alias(count_col)))


def _not_null_sql(cols) -> str:
    return " AND ".join([f"`{k}` IS NOT NULL" for k in cols]) or "TRUE"


def _q(c: str) -> str:
    return f"`{c}`"


def kermed_sql(n: str, s0: str, s1: str, s2: str) -> str:
    """Kernel median from the rank moments of a group (k = 0-based rank):
    n = 1: S0; n = 2: S0 / 2; n >= 3 the weights 1 + 1.5 (n-1)/(n-2) (1 - u_k^2)
    sum to 2n and the weighted sum reduces to
    (S0 + 6 ((n-1) S1 - S2) / ((n-1)(n-2))) / (2n), S1 = sum k x, S2 = sum k^2 x."""
    return (f"CASE WHEN {n} IS NULL OR {n} = 0 THEN CAST(NULL AS DOUBLE) "
            f"WHEN {n} = 1 THEN {s0} WHEN {n} = 2 THEN {s0} / 2 "
            f"ELSE ({s0} + 6.0 * (({n} - 1) * {s1} - {s2}) / ((CAST({n} AS DOUBLE) - 1) * ({n} - 2))) "
            f"/ (2.0 * {n}) END")


def trailing_stats(hist: DataFrame, keys: Sequence[str], value: str, windows: Sequence[int | None],
                   stats: Sequence[str], name, gap_col: str = "day_gap",
                   partition_by: Sequence[str] | None = None,
                   value_bounds: Sequence[float] | None = None, q: float = 0.5, count_col: str | None = None) -> DataFrame:
    """Statistics of ``value`` per ``keys`` for nested windows ``gap >= -w``.

    ``windows`` holds day counts; ``None`` means every row of ``hist``.
    """
    gap = _q(gap_col)
    conds = [(w, "TRUE" if w is None else f"{gap} >= -{int(w)}") for w in windows]
    pre = None if None in windows else f"{gap} >= -{int(max(windows))}"
    return membership_stats(hist, keys, value, conds, stats, name, pre, partition_by, value_bounds, q, count_col)


def value_cuts(df: DataFrame, value: str, ranges: int = 64, rel_error: float = 0.001) -> list[float]:
    """Cut points splitting ``value`` into about ``ranges`` equal-count ranges
    (approximate quantiles: one distributed pass, ``ranges`` numbers back)."""
    probs = [i / ranges for i in range(1, ranges)]
    return df.approxQuantile(value, probs, rel_error)


def _split_ranks(d: DataFrame, keys: list[str], rng: list[int], bounds: Sequence[float],
                 need_rank: bool, need_tot: bool) -> DataFrame:
    """Rank offsets and group totals with every group split into value ranges.

    d holds one row per (keys, distinct value _x) with multiplicities _m{i}.
    """
    cuts = sorted({float(b) for b in bounds if b is not None and b == b})
    arr = "array(" + ", ".join(f"CAST({c!r} AS DOUBLE)" for c in cuts) + ")"
    d = d.withColumn("_b", F.expr(f"size(filter({arr}, t -> t < _x))"))
    kb = ", ".join(_q(k) for k in [*keys, "_b"])
    pk = ", ".join(_q(k) for k in keys)
    if need_rank:
        d = d.withColumns({f"_l{i}": F.expr(
            f"coalesce(sum(_m{i}) OVER (PARTITION BY {kb} ORDER BY _x "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)") for i in rng})
    # one row per (group, range): bounded by the number of ranges per group
    per_range = d.groupBy(*keys, "_b").agg(*[F.expr(f"sum(_m{i})").alias(f"_t{i}") for i in rng],
                                           *[F.expr(f"sum(_x * _m{i})").alias(f"_sx{i}") for i in rng])
    cols = {}
    for i in rng:
        cols[f"_o{i}"] = F.expr(f"coalesce(sum(_t{i}) OVER (PARTITION BY {pk} ORDER BY _b "
                                f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
        cols[f"_n{i}"] = F.expr(f"sum(_t{i}) OVER (PARTITION BY {pk})")
        cols[f"_mu{i}"] = F.expr(f"try_divide(sum(_sx{i}) OVER (PARTITION BY {pk}), sum(_t{i}) OVER (PARTITION BY {pk}))")
    offsets = per_range.withColumns(cols).drop(*[f"_t{i}" for i in rng], *[f"_sx{i}" for i in rng])
    d = d.join(offsets, on=[*keys, "_b"], how="inner")
    if need_rank:
        d = d.withColumns({f"_c{i}": F.col(f"_o{i}") + F.col(f"_l{i}") for i in rng})
    return d


def cumulative_stats(hist: DataFrame, keys: Sequence[str], value: str, date_col: str,
                     origins: Sequence[dt.date], stats: Sequence[str], name: str) -> DataFrame:
    """Statistics of all rows before each origin, per ``keys``, as rows
    (origin, keys..., name).  History sets are nested (date < t1 is inside
    date < t2), so one copy of each row with one multiplicity per origin gives
    exact ranks for every origin: no row is repeated per origin.
    ``stats`` must hold one statistic (the output column ``name``)."""
    (stat,) = list(stats)
    d = _q(date_col)
    conds = [(o, f"{d} < DATE '{o.isoformat()}'") for o in origins]
    pre = f"{d} < DATE '{max(origins).isoformat()}'"
    wide = membership_stats(hist, keys, value, conds, [stat, "count"], lambda s, o: f"_{s}_{o:%Y%m%d}", pre)
    stack = "stack({}, {}) AS (origin, {}, _cnt)".format(
        len(origins), ", ".join(f"DATE '{o.isoformat()}', `_{stat}_{o:%Y%m%d}`, `_count_{o:%Y%m%d}`" for o in origins),
        _q(name))
    return (wide.selectExpr(*[_q(k) for k in keys], stack)
                .where("_cnt > 0").select("origin", *keys, name))


def membership_stats(hist: DataFrame, keys: Sequence[str], value: str, conds, stats: Sequence[str], name,
                     prefilter: str | None = None, partition_by: Sequence[str] | None = None,
                     value_bounds: Sequence[float] | None = None, q: float = 0.5, count_col: str | None = None) -> DataFrame:
    """Core of the fused operators: statistics for several nested row sets.

    ``conds`` is a list of (tag, SQL condition); the sets they select must be
    nested for ranks to be exact, which holds for trailing windows of one
    origin and for all-history sets of several origins.  ``quantile`` is the
    exact ``q`` quantile with linear interpolation (``median`` is q = 0.5).

    ``value_bounds`` (sorted cut points of the value) splits every group into
    value ranges for the rank step: ranks are computed inside (group, range)
    and shifted by exact offsets from a per-range count table, so no task
    ever holds a whole group -- use it for key sets that can be hot.  The
    cut points only balance the work; results are exact for any cut points.
    ``count_col`` says how many rows a row of ``hist`` stands for (1 without).

    ``name(stat, w)`` gives the output column name.  Groups with no row in a
    window get count 0 and NULL for the other statistics.  Null values and
    null keys are skipped (pandas group semantics).

    Expressions are written as SQL text: one call per column keeps plan
    construction cheap for the ~50 aggregates of one key set.
    """
    keys = list(keys)
    windows = [tag for tag, _ in conds]
    cond_of = dict(conds)
    order = list(dict.fromkeys(stats))
    stats = set(order)
    bad = stats - set(WINDOW_STATS)
    if bad:
        raise ValueError(f"unsupported statistics {bad}")
    x = f"CAST({_q(value)} AS DOUBLE)"

    def inw(w):
        return cond_of[w]

    cond = f"{_not_null_sql(keys)} AND {x} IS NOT NULL AND NOT isnan({x})"
    if prefilter:
        cond += f" AND {prefilter}"
    base = hist.where(F.expr(cond))
    d = base.groupBy(*[F.col(k) for k in keys], F.expr(x).alias("_x")).agg(
        *[F.expr(f"sum(CASE WHEN {inw(w)} THEN {_q(count_col)} ELSE 0 END)" if count_col
                 else f"count(CASE WHEN {inw(w)} THEN 1 END)").alias(f"_m{i}") for i, w in enumerate(windows)])
    if partition_by:
        d = d.repartition(*partition_by)

    pk = ", ".join(_q(k) for k in keys)
    rng = list(range(len(windows)))
    need_rank = bool({"kermed", "median", "quantile"} & stats)
    need_tot = bool({"std", "median", "quantile"} & stats)
    if value_bounds and (need_rank or need_tot):
        d = _split_ranks(d, keys, rng, value_bounds, need_rank, need_tot)
    else:
        if need_rank:
            d = d.withColumns({f"_c{i}": F.expr(
                f"coalesce(sum(_m{i}) OVER (PARTITION BY {pk} ORDER BY _x "
                f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)") for i in rng})
        if need_tot:
            tot = {f"_n{i}": F.expr(f"sum(_m{i}) OVER (PARTITION BY {pk})") for i in rng}
            tot.update({f"_mu{i}": F.expr(f"try_divide(sum(_x * _m{i}) OVER (PARTITION BY {pk}), "
                                          f"sum(_m{i}) OVER (PARTITION BY {pk}))") for i in rng})
            d = d.withColumns(tot)

    # Level 1: plain moment aggregates, each computed once.
    aggs = []
    for i in rng:
        m = f"_m{i}"
        md = f"CAST(_m{i} AS DOUBLE)"
        c = f"CAST(_c{i} AS DOUBLE)"
        aggs.append(f"sum({m}) AS _cnt{i}")
        if {"sum", "mean", "kermed"} & stats:
            aggs.append(f"sum(_x * {md}) AS _s0{i}")
        if "max" in stats:
            aggs.append(f"max(CASE WHEN {m} > 0 THEN _x END) AS _max{i}")
        if "min" in stats:
            aggs.append(f"min(CASE WHEN {m} > 0 THEN _x END) AS _min{i}")
        if "std" in stats:
            aggs.append(f"sum({md} * (_x - _mu{i}) * (_x - _mu{i})) AS _ss{i}")
        for stat, frac in (("median", 0.5), ("quantile", float(q))):
            if stat in stats:
                # values at ranks floor(p) and ceil(p), p = frac * (n - 1)
                for tag, fn in (("lo", "floor"), ("hi", "ceil")):
                    p = f"{fn}({frac!r}D * (_n{i} - 1))"
                    aggs.append(f"max(CASE WHEN {m} > 0 AND _c{i} <= {p} AND {p} < _c{i} + {m} THEN _x END) "
                                f"AS _{stat}{tag}{i}")
        if "kermed" in stats:
            # ranks c .. c+m-1 of a block of m equal values
            s1 = f"({md} * {c} + {md} * ({md} - 1) / 2)"
            s2 = f"({md} * {c} * {c} + {c} * {md} * ({md} - 1) + ({md} - 1) * {md} * (2 * {md} - 1) / 6)"
            aggs.append(f"sum(_x * {s1}) AS _s1{i}")
            aggs.append(f"sum(_x * {s2}) AS _s2{i}")
    g = d.groupBy(*[F.col(k) for k in keys]).agg(*[F.expr(a) for a in aggs])

    # Level 2: final formulas as a projection.
    outs = []
    for i, w in enumerate(windows):
        cnt = f"_cnt{i}"
        for s in order:
            if s == "count":
                e = cnt
            elif s == "sum":
                e = f"coalesce(_s0{i}, 0.0)"
            elif s == "mean":
                e = f"CASE WHEN {cnt} > 0 THEN _s0{i} / {cnt} END"
            elif s == "max":
                e = f"_max{i}"
            elif s == "min":
                e = f"_min{i}"
            elif s == "std":
                e = f"CASE WHEN {cnt} > 1 THEN sqrt(_ss{i} / ({cnt} - 1)) END"
            elif s in ("median", "quantile"):
                frac = 0.5 if s == "median" else float(q)
                pos = f"{frac!r}D * (_cnt{i} - 1)"
                e = f"_{s}lo{i} + ({pos} - floor({pos})) * (_{s}hi{i} - _{s}lo{i})"
            else:
                e = kermed_sql(cnt, f"_s0{i}", f"_s1{i}", f"_s2{i}")
            outs.append(f"{e} AS {_q(name(s, w))}")
    return g.selectExpr(*[_q(k) for k in keys], *outs)


# ------------------------------------------------ windows inside a partition --

CHUNK_ROWS = 50_000


def _sorted_stats(g, x, stats: Sequence[str], groups: int) -> dict:
    """Statistics of ``x`` per group number; rows are sorted by (g, x)."""
    import numpy as np
    n = np.bincount(g, minlength=groups)
    first = np.cumsum(n) - n
    out: dict = {"count": n}
    some, at = n > 0, np.minimum(first, max(len(x) - 1, 0))
    whole = np.bincount(g, x, groups)
    with np.errstate(divide="ignore", invalid="ignore"):
        if "sum" in stats:
            out["sum"] = whole
        if "mean" in stats:
            out["mean"] = whole / n
        if "std" in stats:
            out["std"] = np.sqrt(np.bincount(g, (x - (whole / n)[g]) ** 2, groups) / (n - 1))
        if "kermed" in stats:
            k = (np.arange(len(x)) - first[g]).astype(float)
            s1, s2 = np.bincount(g, k * x, groups), np.bincount(g, k * k * x, groups)
            m = n.astype(float)
            out["kermed"] = np.where(n > 2, (whole + 6.0 * ((m - 1) * s1 - s2) / ((m - 1) * (m - 2))) / (2.0 * m), whole / m)
    if len(x):
        if "min" in stats:
            out["min"] = x[at]
        if "max" in stats:
            out["max"] = x[np.maximum(np.minimum(first + n, len(x)) - 1, 0)]
        if "median" in stats:
            half = 0.5 * np.maximum(n - 1, 0)
            low, high = (x[np.minimum(at + f(half).astype(np.int64), len(x) - 1)] for f in (np.floor, np.ceil))
            out["median"] = low + (half - np.floor(half)) * (high - low)
    missing = {"std": n < 2, "sum": np.zeros(groups, bool)}
    return {s: (out.get(s, np.zeros(groups)), None if s == "count" else missing.get(s, ~some)) for s in stats}


def partition_stats(hist: DataFrame, keys: Sequence[str], value: str, date_col: str, origins: Sequence[dt.date],
                    windows: Sequence[int | None], stats: Sequence[str], name) -> DataFrame:
    """``trailing_stats`` per (origin, keys...) of a history whose partitions hold
    whole values of ``keys[0]`` (the store).

    ``hist`` has every row once: no row is paired with the origins.  A partition
    is sorted by the store and read as Arrow batches; some whole stores at a time
    are sorted by (keys, value) once, and every origin and window is a filter of
    these rows, which stay sorted, so ranks and extremes are positions.  Memory
    is that of one chunk: CHUNK_ROWS rows or the rows of one store.  A window of
    ``None`` is all history before the origin.
    """
    keys, stats, windows = list(keys), list(stats), list(windows)
    bad = set(stats) - {"count", "sum", "mean", "max", "min", "std", "median", "kermed"}
    if bad:
        raise ValueError(f"unsupported statistics {bad}")
    starts = [(o, (o - dt.date(1970, 1, 1)).days) for o in origins]
    longest = None if None in windows else max(windows)
    days, x = f"datediff({_q(date_col)}, DATE '1970-01-01')", f"CAST({_q(value)} AS DOUBLE)"
    cond = f"{_not_null_sql(keys)} AND {x} IS NOT NULL AND NOT isnan({x}) AND {_q(date_col)} < DATE '{max(origins).isoformat()}'"
    if longest is not None:
        cond += f" AND {_q(date_col)} >= DATE '{(min(origins) - dt.timedelta(days=longest)).isoformat()}'"
    rows = hist.where(F.expr(cond)).selectExpr(*[_q(k) for k in keys], f"{days} AS _day", f"{x} AS _x") \
        .sortWithinPartitions(keys[0])
    types = {f.name: f.dataType.simpleString() for f in hist.schema.fields}
    columns = [(name(s, w), "bigint" if s == "count" else "double") for w in windows for s in stats]
    schema = ", ".join(["origin date", *[f"{_q(k)} {types[k]}" for k in keys], *[f"{_q(c)} {t}" for c, t in columns]])

    def chunk_stats(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        table = table.combine_chunks()
        group = np.zeros(table.num_rows, np.int64)
        for k in keys:
            codes = pc.dictionary_encode(table.column(k)).combine_chunks()
            group = group * max(len(codes.dictionary), 1) + codes.indices.to_numpy()
        day, x = table.column("_day").to_numpy(), table.column("_x").to_numpy() + 0.0
        order = np.lexsort((x, group))
        group, day, x = group[order], day[order], x[order]
        for origin, start in starts:
            age = start - day
            mine = age > 0 if longest is None else (age > 0) & (age <= longest)
            if not mine.any():
                continue
            g, a, v, at = group[mine], age[mine], x[mine], order[mine]
            new = np.diff(g, prepend=-1) != 0
            g, groups = np.cumsum(new) - 1, int(new.sum())
            taken = table.select(keys).take(pa.array(at[new]))
            out = [pa.array([origin], pa.date32()).take(pa.array(np.zeros(groups, np.int64)))]
            out += [taken.column(k).combine_chunks() for k in keys]
            for w in windows:
                inside = slice(None) if w is None or w == longest else a <= w
                found = _sorted_stats(g[inside], v[inside], stats, groups)
                out += [pa.array(found[s][0], pa.int64() if s == "count" else pa.float64(), mask=found[s][1]) for s in stats]
            yield pa.RecordBatch.from_arrays(out, names=["origin", *keys, *[c for c, _ in columns]])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        kept, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            size += batch.num_rows
            if size < CHUNK_ROWS:
                continue
            table = pa.Table.from_batches(kept)
            ids = table.column(keys[0])
            last = ids[len(ids) - 1]
            # Rows of the last store wait for the rest of it.
            cut = int(np.count_nonzero(pc.not_equal(ids, last).to_numpy()))
            if cut:
                yield from chunk_stats(table.slice(0, cut))
                rest = table.slice(cut).combine_chunks()
                kept, size = rest.to_batches(), rest.num_rows
        if kept:
            yield from chunk_stats(pa.Table.from_batches(kept))

    show_workers_the_package(hist.sparkSession)
    return rows.mapInArrow(run, schema)
