import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from visitcast.plans import features as FP
from visitcast.plans import naive
from visitcast.operators import align
from visitcast.sources import tables


@pytest.fixture(scope="module")
def job(spark):
    return FP.FeatureJob(FP.fixture_inputs(spark, SF_SMALL))


def _close(a, b):
    return (a is None and b is None) or (a is not None and b is not None and abs(a - b) < 1e-9)


@pytest.mark.parametrize("index", [0, 3])
def test_fused_equals_naive(job, index):
    keys, prefix, stats = FP.W8_CATALOGUE[index]
    fused = job.table(parts=[job.w8(index)], base_columns=["origin", "store_id", "visit_date"])
    slow = naive.naive_w8(job, index).na.fill(0)
    cols = [c for c in fused.columns if c.startswith(prefix)]
    a = {(r["origin"], r["store_id"], r["visit_date"]): r for r in fused.collect()}
    b = {(r["origin"], r["store_id"], r["visit_date"]): r for r in slow.collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c in cols:
            assert _close(a[k][c], b[k][c]), (k, c, a[k][c], b[k][c])


def test_label_slices_tile(job):
    lab = job.labels
    assert lab.groupBy("store_id", "visit_date").count().where("count > 1").count() == 0
    train = lab.where(F.col("origin") < F.lit(tables.TEST_BEGIN))
    assert train.where((F.col("day_gap") < 0) | (F.col("day_gap") >= tables.NDAY)).count() == 0
    assert job.hist.where(F.col("visit_date") >= F.col("origin")).count() == 0


def test_reserve_leak_flag(spark):
    """Hand-made frame: the driver tables hold no booking on or after the test
    origin (order dates end 2001-08-01), so the leak is built by hand."""
    tb = dt.date(2017, 3, 11)
    days = [tb - dt.timedelta(days=i) for i in range(1, 60)] + [tb + dt.timedelta(days=i) for i in range(3)]
    visits = spark.createDataFrame([(1, d, 10.0) for d in days], "store_id long, visit_date date, visitors double")
    res = spark.createDataFrame([(1, tb + dt.timedelta(days=1), tb, 4.0),                       # booked on the origin day
                                 (1, tb + dt.timedelta(days=1), tb - dt.timedelta(days=2), 3.0)],  # booked before
                                "store_id long, visit_dt date, reserve_dt date, reserve_visitors double")
    store = spark.createDataFrame([(1, "g", "a")], "store_id long, genre string, area string")
    cal = spark.createDataFrame([(d, d.strftime("%A"), 0) for d in days], "visit_date date, day_of_week string, holiday_flg int")
    inp = FP.Inputs(visits, res, store, cal)
    row = (F.col("origin") == F.lit(tb)) & (F.col("visit_date") == F.lit(tb + dt.timedelta(days=1)))
    strict = FP.FeatureJob(inp, test_begin=tb).table().where(row).first()
    leaky = FP.FeatureJob(inp, test_begin=tb, reserve_as_of_origin=False).table().where(row).first()
    assert strict["air_reserve_visitors_sum"] == 3.0
    assert leaky["air_reserve_visitors_sum"] == 7.0
    assert leaky["air_reserve_visitors_sum_weekday_mean_35"] == 7.0


def test_coral_matches_target_moments(spark):
    from visitcast.operators import align
    rng = np.random.default_rng(0)
    s = rng.normal([0, 5], [1, 3], (400, 2))
    t = rng.multivariate_normal([2, -1], [[2.0, 0.8], [0.8, 1.0]], 500)
    sd = spark.createDataFrame([(float(a), float(b)) for a, b in s], "a double, b double")
    td = spark.createDataFrame([(float(a), float(b)) for a, b in t], "a double, b double")
    out = align.coral_align(sd, td, ["a", "b"]).toPandas().to_numpy()
    assert np.allclose(out.mean(axis=0), t.mean(axis=0), atol=1e-6)
    assert np.allclose(np.cov(out.T), np.cov(t.T), atol=1e-4)


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0 and "air_kermed_21" in df.columns


def test_domain_moments_match_numpy(spark):
    from visitcast.operators import align
    rng = np.random.default_rng(5)
    x = rng.normal(1000, [1, 5, 20], (700, 3))   # large means: the centred pass keeps precision
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(6)
    mu, cov, n = align.domain_moments(df, ["a", "b", "c"])
    assert n == 700
    assert np.allclose(mu, x.mean(axis=0), rtol=0, atol=1e-9)
    assert np.allclose(cov, np.cov(x.T), rtol=1e-9, atol=1e-9)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_keyed_parts_need_no_exchange(job):
    """The history is shuffled once (by store, then checkpointed with that
    partitioning); store-keyed statistics must not shuffle again."""
    for k, frame in [job.w8(0), job.w8(1), job.w8(2)] + job.w7():
        assert "store_id" in k
        assert "Exchange" not in _plan(frame), k
    # a hot key set (no store) shuffles pre-aggregated rows and ranks in value ranges
    hot = _plan(job.w8(3)[1])
    assert "Exchange" in hot and "_b" in hot


def test_labels_are_shuffled_once(job):
    """In the plan of the whole table the label rows meet every part where
    they are: no exchange lies above a join."""
    plan = _plan(job.table())
    depth_of_join = None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*"))
        if "Join" in line and depth_of_join is None:
            depth_of_join = depth
        if "Exchange" in line and "BroadcastExchange" not in line and depth_of_join is not None:
            assert depth > depth_of_join, line
    # the stream side below all joins is the checkpoint, not an exchange
    stream = [line for line in plan.splitlines() if "Scan ExistingRDD" in line]
    assert stream and depth_of_join is not None
    assert "SortMergeJoin" not in plan


def test_checkpoint_folder_of_the_context_wins(spark, tmp_path):
    from visitcast import session
    before = session.ensure_checkpoint_dir(spark)
    assert session.ensure_checkpoint_dir(spark) == before == spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        assert str(tmp_path) in session.ensure_checkpoint_dir(spark)
    finally:
        spark.sparkContext.setCheckpointDir(before)


def test_moments_of_one_pass(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(1e6, 1.0, (500, 3)) + np.arange(3)
    x[:, 2] = 4.0                                              # constant
    rows = [(["s", "t"][i % 2], *map(float, r)) for i, r in enumerate(x)] + [("s", None, 1.0, 2.0), ("s", 1.0, None, 2.0)]
    df = spark.createDataFrame(rows, "d string, a double, b double, y double").repartition(7)
    found = align.moments_by(df, ["a", "b", "y"], "d")
    for i, name in enumerate("st"):
        part, m = x[i::2], found[name]
        mean, cov, n = m.cut(["b", "a"])
        assert n == 250 and m.dropped == (2 if name == "s" else 0)
        assert np.allclose(mean, part.mean(0)[[1, 0]]) and np.allclose(cov, np.cov(part[:, [1, 0]].T), atol=1e-6)
        assert m.correlations("y") == {"a": None, "b": None}
        assert abs(m.correlations("b")["a"] - np.corrcoef(part[:, 0], part[:, 1])[0, 1]) < 1e-6
    # With nulls the cut features decide which rows count, as without a store.
    s, t = df.where("d = 's'"), df.where("d = 't'")
    store = align.moment_store({"source": s, "target": t}, ["a", "b"], "y")
    one = align.coral_align(s.where("a is not null"), t, ["a"], moments=store).agg({"a": "avg"}).first()[0]
    two = align.coral_align(s.where("a is not null"), t, ["a"]).agg({"a": "avg"}).first()[0]
    assert abs(one - two) < 1e-3
    assert align.moments_by(df.where("false"), ["a"]) == {}
