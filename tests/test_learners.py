"""Boosting, stored models and recipes on planted signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitcast.plans import learners as L
from visitcast.plans import recipes as RC
from visitcast.plans import report, trainset

FAST = L.GBTParams(max_depth=3, min_leaf=5, step_size=0.3, max_iter=12, patience=4, feature_fraction=1.0, bagging_fraction=1.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x, z = rng.uniform(0, 1, 400), rng.uniform(0, 1, 400)
    data = [(float(a), float(b), float(3 * a + rng.normal(0, 0.05)), 1.0, bool(i % 5 == 0)) for i, (a, b) in enumerate(zip(x, z))]
    return spark.createDataFrame(data, "x double, z double, visitors double, weight double, is_valid boolean").cache()


def error(chain, df):
    return report.rmsle(chain.predict(df)).first()["rmsle"]


def test_rounds_survive_and_the_step_acts(rows):
    fast = L.boost(rows, ["x", "z"], FAST, valid_col="is_valid")
    slow = L.boost(rows, ["x", "z"], FAST.replace(step_size=0.003), valid_col="is_valid")
    start = error(L.Chain(fast.start), rows)
    assert fast.rounds[0] > 1 and error(fast, rows) < 0.3 * start
    moved = [abs(error(c, rows) - start) for c in (fast, slow)]
    assert 0 < moved[1] < 0.1 * moved[0]
    assert fast.parts[0].model.treeWeights == [FAST.step_size] * fast.rounds[0]


def test_validation_rows_are_not_trained_on(rows):
    spoiled = rows.withColumn("visitors", F.when(F.col("is_valid"), 100.0).otherwise(F.col("visitors")))
    a = L.boost(rows, ["x"], FAST.replace(max_iter=3))
    b = L.boost(spoiled, ["x"], FAST.replace(max_iter=3), valid_col="is_valid")
    assert b.start < 10 and a.start < 10


def test_patience_keeps_the_best_prefix(rows):
    noise = rows.withColumn("visitors", F.when(F.col("is_valid"), -F.col("visitors")).otherwise(F.col("visitors")))
    chain = L.boost(noise, ["x"], FAST, valid_col="is_valid")
    assert chain.rounds[0] < FAST.max_iter
    assert error(chain, noise.where("is_valid")) <= error(L.Chain(chain.start), noise.where("is_valid")) + 1e-9


def test_continuing_adds_parts_and_store_round_trip(rows, spark, tmp_path):
    source = L.boost(rows, ["x"], FAST.replace(max_iter=2), valid_col="is_valid")
    tuned = L.boost(rows, ["z", "x"], FAST.replace(max_iter=4), valid_col="is_valid", init=source)
    assert tuned.start == source.start and len(tuned.parts) == 2 and error(tuned, rows) < error(source, rows)
    path = str(tmp_path / "model")
    calls = []
    first = L.train_or_load(path, rows, ["x"], FAST.replace(max_iter=2), valid_col="is_valid")
    again = L.train_or_load(path, rows.where("assert_true(false) is null"), ["x"], FAST, valid_col="is_valid")
    assert first.rounds == again.rounds and abs(error(first, rows) - error(again, rows)) < 1e-12
    kept = first.predict(rows.withColumn("prediction", F.lit(7.0)), "p")
    assert kept.where("prediction <> 7.0").count() == 0 and not calls


def domain(spark, shift, n, seed):
    rng = np.random.default_rng(seed)
    import datetime as dt
    day = dt.date(2001, 1, 1)
    rows = [(day, i % 7, day + dt.timedelta(days=int(i % 40)), float(i % 40), float(a), float(b), float(2 * a + b + shift))
            for i, (a, b) in enumerate(rng.uniform(0, 1, (n, 2)))]
    return spark.createDataFrame(rows, "origin date, store_id int, visit_date date, day_gap double, x double, z double, visitors double") \
        .withColumn("store_id", F.monotonically_increasing_id())


def test_every_recipe_beats_the_mean(spark):
    data = trainset.DomainData(*(domain(spark, s, n, k).checkpoint() for k, (s, n) in
                                 enumerate(((0.3, 300), (0.0, 240), (0.3, 60), (0.0, 60)))), ["x", "z"])
    p = FAST.replace(max_iter=4)
    source = RC.source_model(data, p)
    mean = data.target_train.agg(F.avg("visitors")).first()[0]
    base = report.rmsle(data.target_test.withColumn("prediction", F.lit(mean))).first()["rmsle"]
    small = dict(learning_rate=0.2, rounds=2)
    phases = ((0.3, 2), (0.1, 2))
    options = {"fine_tune": small, "adversarial": small, "sample_transfer": small, "ensemble": {**small, "n": 2},
               "weighted_da": small, "super_ensemble_topk": dict(k=1, phases=phases),
               "super_ensemble_aligned": dict(n_clusters=3, top_ratio=0.5, phases=phases)}
    scores, status = RC.run_all(data, p, source, options)
    assert set(status.values()) == {"ok"}, status
    assert len(scores) == 12 and all(v < base for v in scores.values()), (base, scores)


def test_failure_isolation(spark, rows):
    def fails():
        yield L.Fit(rows, ["x"], FAST.replace(max_iter=1), valid_col="is_valid")
        raise ZeroDivisionError

    def bad_fit():
        yield L.Fit(rows, ["no such column"], FAST.replace(max_iter=1))

    def good():
        model = yield L.Fit(rows, ["x"], FAST.replace(max_iter=2), valid_col="is_valid")
        return RC.Result("good", rows, error(model, rows))

    scores, status = RC.isolated(spark, {"good": good(), "bad": fails(), "fit": bad_fit()})
    assert scores["good"] > 0 and scores["bad"] is None and scores["fit"] is None
    assert status["good"] == "ok" and status["bad"] == "failed: ZeroDivisionError" and status["fit"].startswith("failed: ")


def test_shared_passes_give_the_models_of_separate_fits(rows):
    ask = {str(k): L.Fit(rows, f, FAST.replace(seed=k, max_iter=3 + k, bagging_fraction=b), valid_col="is_valid")
           for k, (f, b) in enumerate(((["x", "z"], 1.0), (["x", "z"], 1.0), (["x"], 1.0)))}
    shared = L.boost_all(ask, ledger_every=2)
    for name, fit in ask.items():
        alone = L.boost_all({name: fit}, ledger_every=50)[name]
        assert alone.rounds == shared[name].rounds and abs(error(alone, rows) - error(shared[name], rows)) < 1e-9


def test_sums_by_shuffle_give_the_same_trees(rows, monkeypatch):
    p = FAST.replace(max_iter=3)
    near = L.boost(rows.coalesce(4), ["x", "z"], p, valid_col="is_valid")
    monkeypatch.setattr(L, "FAN_IN", 0)
    far = L.boost(rows.coalesce(4), ["x", "z"], p, valid_col="is_valid")
    assert near.rounds == far.rounds and abs(error(near, rows) - error(far, rows)) < 1e-9


def test_leaf_limit_and_missing_values(rows):
    p = FAST.replace(max_depth=6, max_leaves=5, max_iter=1)
    tree = L.boost(rows, ["x", "z"], p).parts[0].model.trees[0]
    assert (tree["feature"] < 0).sum() == 5
    gaps = rows.withColumn("x", F.when(F.col("x") > 0.5, F.col("x")))
    chain = L.boost(gaps, ["x"], FAST.replace(max_iter=4))
    assert error(chain, gaps) < 0.7 * error(L.Chain(chain.start), gaps)


def test_tree_by_hand(spark):
    data = [(float(i), 1.0 if i < 30 else 5.0, 1.0 + (i % 2)) for i in range(60)]
    df = spark.createDataFrame(data, "x double, visitors double, weight double")
    tree = L.boost(df, ["x"], FAST.replace(max_depth=1, max_iter=1, step_size=1.0)).parts[0].model.trees[0]
    assert 28 <= tree["threshold"][0] < 31 and tree["feature"].tolist() == [0, -1, -1]
    mean = sum(y * w for _, y, w in data) / sum(w for *_, w in data)
    assert abs(mean + tree["value"][2] - 5.0) < 1e-9


def test_score_ledger_is_read_from_memory(rows, monkeypatch):
    """No pass unpacks the stored blocks again."""
    unpacked = rows.sparkSession.sparkContext.accumulator(0)
    plain = L._unpacked

    def counted(runs_of):
        unpack = plain(runs_of)

        def one(row):
            unpacked.add(1)
            return unpack(row)
        return one

    monkeypatch.setattr(L, "_unpacked", counted)
    L.boost(rows, ["x", "z"], FAST, valid_col="is_valid")
    blocks = unpacked.value
    assert 0 < blocks <= 2 * rows.rdd.getNumPartitions()


def test_blocks_and_ledger_are_zipped_once_a_ledger(rows, monkeypatch):
    """A pass reads the zipped blocks; it does not zip them again."""
    from pyspark import RDD
    zips, plain = [], RDD.zip
    monkeypatch.setattr(RDD, "zip", lambda self, other: zips.append(1) or plain(self, other))
    fit = L.Fit(rows, ["x", "z"], FAST.replace(max_iter=9, patience=9), valid_col="is_valid")
    often = L.boost_all({"one": fit}, ledger_every=4)["one"]
    assert len(zips) == 2
    seldom = L.boost_all({"one": fit}, ledger_every=50)["one"]
    assert len(zips) == 2 and often.rounds == seldom.rounds and abs(error(often, rows) - error(seldom, rows)) < 1e-9


def test_fits_on_different_rows_keep_their_own_borders(rows):
    """Rows are sketched side by side; every fit has the model it has alone."""
    ask = {str(k): L.Fit(rows.withColumn("x", F.col("x") * 10 ** k), ["x", "z"], FAST.replace(max_iter=3), valid_col="is_valid")
           for k in range(6)}
    shared = L.boost_all(ask)
    for k, (name, fit) in enumerate(ask.items()):
        alone, tree = L.boost_all({name: fit})[name], shared[name].parts[0].model.trees[0]
        assert tree["threshold"][0] > 0.1 * 10 ** k
        assert np.allclose(tree["threshold"], alone.parts[0].model.trees[0]["threshold"])


def test_border_sketches_are_merged_by_several_tasks(spark):
    """More than one part, missing values, a feature without any value."""
    d = 2 * L.SKETCH_FEATURES + 3
    df = spark.range(0, 500, 1, 4).select(
        *[F.expr(f"CASE WHEN id % 11 = 3 THEN NULL WHEN id % 13 = 2 THEN double('NaN') ELSE pmod(xxhash64(id, {k}), 900) / 7.0D END").alias(f"f {k}")
          for k in range(d - 1)], F.lit(None).cast("double").alias("none"))
    sketches = L.border_sketches(df, df.columns, 32)
    plan = sketches._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(part" in plan
    assert sketches.count() == 3
    share = ", ".join(f"{i / 31}D" for i in range(1, 31))
    want = df.selectExpr(*[f"percentile_approx(nullif(`{c}`, double('NaN')), array({share}), {L.EDGE_ACCURACY})" for c in df.columns]).first()
    for got, q in zip(L.bin_borders(df, df.columns, 32), want, strict=True):
        assert np.array_equal(got, np.unique(np.array(q or [], float)))
    assert all(len(b) == 0 for b in L.bin_borders(df.where("false"), df.columns, 32)) and L.bin_borders(df, [], 32) == []
    assert [len(b) for b in L.bin_borders(df, df.columns, 2)] == [0] * d


def test_fits_on_the_same_rows_share_their_blocks(rows, monkeypatch):
    """Other features, or another model to go on from, are no reason to store the rows again."""
    starts = [L.boost(rows, [f], FAST.replace(max_iter=2), valid_col="is_valid") for f in ("x", "z")]
    packed, plain = [], L._packed
    monkeypatch.setattr(L, "_packed", lambda number, *a, **k: packed.append(number) or plain(number, *a, **k))
    ask = {str(k): L.Fit(rows, f, FAST.replace(max_iter=4), valid_col="is_valid", init=i)
           for k, (f, i) in enumerate(((["x", "z"], starts[0]), (["z"], starts[1]), (["x"], None), (["z", "x"], starts[0])))}
    shared = L.boost_all(ask, ledger_every=3)
    assert len(packed) == 1
    for name, fit in ask.items():
        alone = L.boost_all({name: fit})[name]
        assert alone.rounds == shared[name].rounds and abs(error(alone, rows) - error(shared[name], rows)) < 1e-9


def test_blocks_are_joined_and_drawn_as_before(rows):
    """Joined blocks keep the rows of every block's own draw."""
    def block(number, block, n):
        v = np.arange(n, dtype=float) + block
        return (number, [(block, n)], np.full((n, 2), block, np.uint8), v, v, v > 1), {7: v, 8: v}

    joined = list(L._joined(iter([block(0, 1, 3), block(1, 2, 4), block(0, 3, 5)])))
    assert [(d, blocks, len(y)) for (d, blocks, _, y, _, _), _ in joined] == [(0, [(1, 3), (3, 5)], 8), (1, [(2, 4)], 4)]
    (_, blocks, bins, y, _, _), scores = joined[0]
    assert bins[:, 0].tolist() == [1] * 3 + [3] * 5 and scores[7] is scores[8] and np.array_equal(scores[7], y)
    alone = [L._drawn(5, 0.5, [b]) for b in blocks]
    assert np.array_equal(L._drawn(5, 0.5, blocks), np.concatenate(alone))


def test_small_trees_route_rows_as_large_ones(monkeypatch):
    rng = np.random.default_rng(3)
    tree = dict(feature=np.array([1, 0, 2, -1, -1, -1, -1], np.int32), bin=np.array([3, 5, 0, -1, -1, -1, -1], np.int32),
                left=np.array([1, 3, 5, -1, -1, -1, -1]), right=np.array([2, 4, 6, -1, -1, -1, -1]), value=rng.normal(size=7))
    bins = np.asfortranarray(rng.integers(0, 9, (200, 3)).astype(np.uint8))
    small = L._routed(tree, bins, tree["value"])
    monkeypatch.setattr(L, "SMALL_TREE", 0)
    assert np.array_equal(small, L._routed(tree, bins, tree["value"]))


def test_plans_share_the_target_set_and_the_f_statistics(spark, monkeypatch):
    data = trainset.DomainData(*(domain(spark, s, n, k).checkpoint() for k, (s, n) in
                                 enumerate(((0.3, 300), (0.0, 240), (0.3, 60), (0.0, 60)))), ["x", "z"])
    p = FAST.replace(max_iter=2)
    source = RC.source_model(data, p)
    calls = {"sets": 0, "scores": 0}
    sets, scores = RC.training_set, RC.f_score_topk
    monkeypatch.setattr(RC, "training_set", lambda *a: calls.update(sets=calls["sets"] + 1) or sets(*a))
    monkeypatch.setattr(RC, "f_score_topk", lambda *a: calls.update(scores=calls["scores"] + 1) or scores(*a))
    found, status = RC.super_ensemble_grid(data, p, source, ks=(1, 2), rates=((0.3, 0.1), (0.2, 0.1)), rounds=(2, 2))
    assert set(status.values()) == {"ok"} and len(found) == 4
    assert calls == {"sets": 1, "scores": 1}


def test_one_task_grows_the_trees_of_the_passes(rows, monkeypatch):
    """A fit on few rows is grown by a task of its own: the same trees, no pass a level."""
    p = FAST.replace(bagging_fraction=0.7, feature_fraction=0.5, max_iter=10)
    start = L.boost(rows, ["x"], p.replace(max_iter=2), valid_col="is_valid")
    ask = {str(k): L.Fit(rows, f, p.replace(seed=k), valid_col=v, init=i) for k, (f, v, i) in
           enumerate(((["x", "z"], "is_valid", None), (["z"], "is_valid", start), (["x", "z"], None, None)))}
    passes = L.boost_all(ask, ledger_every=4)
    far = []
    monkeypatch.setattr(L, "LOCAL_ROUNDS", 1)
    monkeypatch.setattr(L, "_grown_together", lambda *a: far.append(a))
    apart = L.boost_all(ask, ledger_every=4)
    assert not far
    for name in ask:
        a, b = passes[name], apart[name]
        assert a.rounds == b.rounds and a.start == pytest.approx(b.start) and abs(error(a, rows) - error(b, rows)) < 1e-9
    assert L.boost(rows.where("false"), ["x"], p).rounds == [10] or L.boost(rows.where("false"), ["x"], p).start == 0.0


def test_joint_histograms_are_those_of_single_features(monkeypatch):
    rng = np.random.default_rng(4)
    bins, v = np.asfortranarray(rng.integers(0, 6, (500, 5)).astype(np.uint8)), rng.normal(size=500)
    tree = dict(feature=np.array([2, -1, -1], np.int32), bin=np.array([3, -1, -1], np.int32), left=np.array([1, -1, -1]),
                right=np.array([2, -1, -1]), value=np.zeros(3))
    plan = {0: dict(level=1, offset=0.1, pending=[], step=1.0, tree=tree, slots={1: 0, 2: 1}, columns=np.arange(5), seed=3, fraction=0.8, bins=7)}
    blocks = [((0, [(0, 300), (9, 200)], bins, v, np.abs(v), v > 2), {0: np.zeros(500)})]
    few = dict(L._histograms(plan)(blocks))
    monkeypatch.setattr(L, "FEW_CELLS", 0)
    joint = dict(L._histograms(plan)(blocks))
    monkeypatch.setattr(L, "PAIR_CELLS", 0)
    single = dict(L._histograms(plan)(blocks))
    for found in (few, joint):
        assert found.keys() == single.keys() and all(np.allclose(found[k], single[k]) for k in single)
        assert all(np.array_equal(found[k][0], single[k][0]) for k in single)


def test_coral_strategies_share_the_time_split(spark, monkeypatch):
    """The validation days are found once, not behind the linear map of every strategy; rows and weights stay the same."""
    data = trainset.DomainData(*(domain(spark, s, n, k).checkpoint() for k, (s, n) in
                                 enumerate(((0.3, 300), (0.0, 240), (0.3, 60), (0.0, 60)))), ["day_gap", "x", "z"])
    asked, splits, plain, time_split = [], [], RC.L.boost_all, trainset.time_split
    monkeypatch.setattr(trainset, "time_split", lambda *a: splits.append(a) or time_split(*a))
    monkeypatch.setattr(RC.L, "boost_all", lambda fits: asked.append(fits) or plain(fits))
    scores, status = RC.coral_comparison(data, FAST.replace(max_iter=2), ("none", "standard", "partial_50"))
    assert set(status.values()) == {"ok"} and len(splits) == 1 and all(v > 0 for v in scores.values())
    moments = RC.align.moment_store({"source": data.source_train, "target": data.target_train}, data.features, "visitors")
    for (name, _), fit in ((key, fit) for fits in asked for key, fit in fits.items()):
        aligned, _ = RC.CORAL_STRATEGIES[name.removeprefix("coral_")](data.source_train, data.target_train, data.features, moments)
        want = {r["store_id"]: r for r in RC.training_set(aligned).collect()}
        got = fit.rows.collect()
        assert len(got) == len(want) == 300
        for r in got:
            assert all(r[c] == pytest.approx(want[r["store_id"]][c]) for c in ("day_gap", "x", "z", "visitors", "weight", "is_valid"))


def test_adversarial_runs_the_modelled_settings(rows, monkeypatch):
    """no shortened rounds, larger step, shallow trees or short patience, for the source model neither."""
    from visitcast import registry as R
    seen = {}
    data = trainset.DomainData(rows, rows, rows, rows, ["x"])

    def run(data, params, source, **options):
        seen.update(params=params, source=source, options=options)
        return RC.Result("adversarial", rows.selectExpr("current_date() AS origin", "1 AS store_id", "current_date() AS visit_date",
                                                        "visitors", "visitors AS prediction"), 0.0)

    monkeypatch.setattr(R, "planted_data", lambda spark, sf: data)
    monkeypatch.setattr(RC, "source_model", lambda data, params, path: params)
    monkeypatch.setitem(RC.METHODS, "adversarial", run)
    R.QUERIES["adversarial"](rows.sparkSession, "/none")
    assert seen["params"] == seen["source"] == L.GBTParams() and not seen["options"].keys() & {"rounds", "learning_rate"}


def test_planted_rows_are_stored_once(spark, tmp_path, monkeypatch):
    """The feature table is written by domain and split, without a checkpoint before or a copy a part after."""
    import datetime as dt

    from visitcast import registry as R
    sf = str(tmp_path)
    spark.createDataFrame([(i, f"s{i}", i % 3, 0.0) for i in range(10)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double") \
        .write.parquet(f"{sf}/supplier.parquet")
    day = R.TEST_BEGIN
    table = spark.createDataFrame([(o, None if i == 9 else i, day, i % 7, i, float(i)) for i in range(10) for o in (day, day - dt.timedelta(35))],
                                  "origin date, store_id long, visit_date date, weekday int, genre int, visitors double")

    class Job:
        built = 0

        def table(self):
            Job.built += 1
            return table

    kept = []
    monkeypatch.setattr(R, "_job", lambda *a: Job())
    monkeypatch.setattr(type(table), "checkpoint", lambda self, **k: kept.append(self) or self)
    data = R.planted_data(spark, sf)
    assert R.planted_data(spark, sf) is data and Job.built == 1 and not kept
    assert data.features == ["weekday", "genre"]
    for part, stores, test in ((data.source_train, {1, 2, 3, 4, 6, 7, 8, None}, False), (data.target_train, {0, 5}, False),
                               (data.source_test, {1, 2, 3, 4, 6, 7, 8, None}, True), (data.target_test, {0, 5}, True)):
        found = part.collect()
        assert part.columns == table.columns and {r["store_id"] for r in found} == stores and len(found) == len(stores)
        assert all((r["origin"] == day) == test and r["visitors"] == r["weekday"] * 0.5 + 2.0 * (r["genre"] % 2 == 0) for r in found)
