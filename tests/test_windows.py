import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from visitcast.operators.windows import explode_origins, trailing_stats

from test_aggregates import reference_kermed

WINDOWS = [3, 7, 20]


def _brute(pdf, keys, w):
    sel = pdf[pdf.gap >= -w]
    out = {}
    for k, g in sel.groupby(keys):
        x = g.x.to_numpy()
        out[k if isinstance(k, tuple) else (k,)] = dict(
            count=len(x), mean=x.mean(), max=x.max(), min=x.min(),
            std=(x.std(ddof=1) if len(x) > 1 else None), median=float(np.median(x)),
            kermed=reference_kermed(list(x)))
    return out


def test_trailing_stats_against_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({"a": rng.integers(0, 4, n), "b": rng.integers(0, 3, n),
                        "gap": -rng.integers(1, 25, n), "x": np.round(rng.normal(3, 1, n), 1)})
    df = spark.createDataFrame(pdf).repartition(3)
    stats = ["count", "mean", "max", "min", "std", "median", "kermed"]
    got = trailing_stats(df, ["a", "b"], "x", WINDOWS, stats, name=lambda s, w: f"{s}_{w}", gap_col="gap").collect()
    got = {(r["a"], r["b"]): r for r in got}
    for w in WINDOWS:
        exp = _brute(pdf, ["a", "b"], w)
        for k, row in got.items():
            if k not in exp:
                assert row[f"count_{w}"] == 0 and row[f"mean_{w}"] is None
                continue
            for s in stats:
                e, g = exp[k][s], row[f"{s}_{w}"]
                assert (e is None and g is None) or abs(e - g) < 1e-9, (k, w, s, e, g)


def test_explode_origins_only_past(spark):
    origins = [dt.date(2020, 1, 10), dt.date(2020, 2, 10)]
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    h = explode_origins(df, "d", origins, lookback=20)
    assert h.where(F.col("d") >= F.col("origin")).count() == 0
    assert h.where(F.col("day_gap") < -20).count() == 0
    assert h.count() == 9 + 20  # 9 days before the first origin, 20 before the second
    leak = explode_origins(df, "d", origins, lookback=20, lookahead_any=[origins[1]])
    assert leak.where((F.col("origin") == F.lit(origins[1])) & (F.col("d") >= F.col("origin"))).count() > 0


def test_split_ranks_equal_plain(spark):
    """Splitting groups into value ranges gives the same exact statistics,
    for any cut points, also with one dominant group and repeated values."""
    rng = np.random.default_rng(11)
    n = 3000
    hot = rng.random(n) < 0.6
    pdf = pd.DataFrame({"a": np.where(hot, 0, rng.integers(1, 5, n)),
                        "gap": -rng.integers(1, 25, n), "x": np.round(rng.gamma(3, 1, n), 1)})
    df = spark.createDataFrame(pdf).repartition(4)
    stats = ["count", "mean", "std", "median", "kermed"]
    name = lambda s, w: f"{s}_{w}"
    plain = {r["a"]: r for r in trailing_stats(df, ["a"], "x", WINDOWS, stats, name, gap_col="gap").collect()}
    for cuts in ([0.5, 1.7, 2.2, 2.9, 4.0, 9.0], [2.5], [100.0]):
        split = {r["a"]: r for r in trailing_stats(df, ["a"], "x", WINDOWS, stats, name, gap_col="gap",
                                                   value_bounds=cuts).collect()}
        assert split.keys() == plain.keys()
        for k in plain:
            for w in WINDOWS:
                for s in stats:
                    a, b = plain[k][f"{s}_{w}"], split[k][f"{s}_{w}"]
                    assert (a is None and b is None) or abs(a - b) < 1e-9, (cuts, k, w, s, a, b)


def test_cumulative_stats_against_brute_force(spark):
    from visitcast.operators.windows import cumulative_stats
    rng = np.random.default_rng(21)
    n = 500
    start = dt.date(2020, 1, 1)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, n),
                        "d": [start + dt.timedelta(days=int(i)) for i in rng.integers(0, 100, n)],
                        "x": np.round(rng.normal(5, 2, n), 1)})
    origins = [start + dt.timedelta(days=i) for i in (10, 40, 70, 101)]
    df = spark.createDataFrame(pdf).repartition(3)
    got = {(r["origin"], r["k"]): r["km"] for r in
           cumulative_stats(df, ["k"], "x", "d", origins, ["kermed"], "km").collect()}
    exp = {}
    for o in origins:
        for k, g in pdf[pdf.d < o].groupby("k"):
            exp[(o, k)] = reference_kermed(list(g.x))
    assert got.keys() == exp.keys()
    for key in exp:
        assert abs(got[key] - exp[key]) < 1e-9, key


def test_segments_give_the_windows_of_single_rows(spark):
    from visitcast.operators.windows import segmented
    rng = np.random.default_rng(4)
    start = dt.date(2020, 1, 1)
    origins = [start + dt.timedelta(days=i) for i in (30, 51, 90)]
    rows = [(int(rng.integers(0, 3)) if i % 50 else None, start + dt.timedelta(days=int(rng.integers(0, 100))),
             None if i % 41 == 0 else float(rng.integers(0, 6))) for i in range(900)]
    df = spark.createDataFrame(rows, "a int, d date, x double").repartition(3)
    stats = ["count", "sum", "mean", "max", "min", "std", "median", "kermed"]
    name = lambda s, w: f"{s}_{w}"

    def of(frame, **options):
        paired = explode_origins(frame, "d", origins, lookback=max(WINDOWS))
        found = trailing_stats(paired, ["origin", "a"], "x", WINDOWS, stats, name, **options)
        return {(r["origin"], r["a"]): r.asDict() for r in found.collect()}

    parts = segmented(df, ["a"], "x", "d", origins, WINDOWS)
    assert parts.count() < df.count() / 2
    plain = of(df)
    for options in ({}, {"value_bounds": [1.5, 3.0]}):
        got = of(parts, count_col="n_rows", **options)
        # The latest window has rows wherever a group appears at all.
        assert {k for k, r in got.items() if r["count_20"]} == {k for k, r in plain.items() if r["count_20"]}
        for k, r in plain.items():
            for c, v in r.items():
                assert v == got[k][c] or abs(v - got[k][c]) < 1e-9, (k, c)


def test_partition_stats_equal_paired_rows(spark, monkeypatch):
    """Chunks of a few rows, a store longer than a chunk, repeated days, nulls and NaN."""
    from visitcast.operators import windows as W
    monkeypatch.setattr(W, "CHUNK_ROWS", 40)
    rng = np.random.default_rng(6)
    start = dt.date(2020, 1, 1)
    origins = [start + dt.timedelta(days=i) for i in (30, 51, 90)]
    rows = [(None if i % 50 == 0 else int(rng.integers(0, 9)) if i % 3 else 4, None if i % 37 == 0 else f"k{rng.integers(0, 3)}",
             start + dt.timedelta(days=int(rng.integers(0, 100))),
             None if i % 41 == 0 else float("nan") if i % 43 == 0 else float(rng.integers(0, 6))) for i in range(900)]
    df = spark.createDataFrame(rows, "s int, a string, d date, x double").repartition(3, "s")
    stats = ["count", "sum", "mean", "max", "min", "std", "median", "kermed"]
    name = lambda s, w: f"{s}_{w}"
    for keys in (["s"], ["s", "a"]):
        for windows, lookback in ((WINDOWS, max(WINDOWS)), ([None], None)):
            paired = explode_origins(df, "d", origins, lookback=lookback)
            want = trailing_stats(paired, ["origin", *keys], "x", windows, stats, name)
            got = W.partition_stats(df, keys, "x", "d", origins, windows, stats, name)
            assert got.dtypes == want.dtypes
            want, got = ({tuple(r[k] for k in ["origin", *keys]): r for r in f.collect()} for f in (want, got))
            assert want.keys() == got.keys()
            for k, r in want.items():
                for c in r.asDict():
                    assert r[c] == got[k][c] or abs(r[c] - got[k][c]) < 1e-9, (keys, k, c)
