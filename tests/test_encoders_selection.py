import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from visitcast.operators import encoders, joins, sampling, selection
from visitcast.operators import weights as W


def test_joint_codes_string_order(spark):
    a = spark.createDataFrame([(1, 10)], "id int, v int")
    b = spark.createDataFrame([(2, 2)], "id int, v int")
    ea, eb = encoders.encode_joint([a, b], "v")
    assert ea.first()["v"] == 0 and eb.first()["v"] == 1   # "10" < "2"


def test_onehot_null_all_zero(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, c string")
    rows = {r["id"]: (r["c_x"], r["c_y"]) for r in encoders.encode_onehot(df, "c").collect()}
    assert rows == {1: (1, 0), 2: (0, 0), 3: (0, 1)}


def test_label_encoding_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "c string")
    assert sorted(r["c"] for r in encoders.encode_label(df, "c").collect()) == [0, 0, 1, 2]


def test_time_split_and_too_few_dates(spark):
    days = [dt.date(2020, 1, i) for i in range(1, 11)]
    df = spark.createDataFrame([(d,) for d in days], "visit_date date")
    out = selection.time_split(df, "visit_date", 7)
    assert out.where("is_valid").count() == 7
    few = spark.createDataFrame([(d,) for d in days[:7]], "visit_date date")
    with pytest.raises(ValueError):
        selection.time_split(few, "visit_date", 7)


def test_similarity_rules(spark):
    sim = spark.createDataFrame([("a", 0.9), ("b", float("nan")), ("c", 0.5), ("d", 0.1)], "feature string, similarity double")
    assert selection.top_ratio_features(sim, 0.5) == ["a", "c"]     # NaN never chosen
    assert selection.top_ratio_features(sim, 0.0) == []
    assert selection.threshold_features(sim, 0.4) == ["a", "c"]
    assert selection.threshold_features(sim, 0.95) == ["a", "b", "c", "d"]   # none pass -> all


def test_constant_feature_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "f double, y double")
    assert selection.label_correlations(df, ["f"], "y").first()["corr"] is None


def test_recency_weights(spark):
    df = spark.createDataFrame([(0, True), (1, True), (-1, True), (5, False)], "day_gap int, is_valid boolean")
    raw = W.recency_weight(df, part=None, eps=0.0)
    w = {r["day_gap"]: r["weight"] for r in raw.collect()}
    m = (1 + 0.5 + 0.5 + 1 / 6) / 4
    assert abs(w[0] - 1 / m) < 1e-12 and abs(w[1] - 0.5 / m) < 1e-12 and abs(w[-1] - 0.5 / m) < 1e-12
    parts = W.recency_weight(df).groupBy("is_valid").agg(F.avg("weight").alias("m")).collect()
    assert all(abs(r["m"] - 1) < 1e-12 for r in parts)


def test_domain_split_partitions_rows(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    members = spark.createDataFrame([(i,) for i in range(0, 100, 5)] + [(None,)], "m long")
    t, s = joins.domain_split(df, members, "k", "m")
    assert t.count() == 20 and s.count() == 80


def test_exact_sample_count_and_stability(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = sampling.exact_sample(df, ["k"], ratio=0.7, seed=1)
    b = sampling.exact_sample(df.repartition(7), ["k"], ratio=0.7, seed=1)
    ka = sorted(r["k"] for r in a.collect())
    assert len(ka) == 700 and ka == sorted(r["k"] for r in b.collect())


def test_sample_per_group(spark):
    df = spark.range(100).withColumn("g", (F.col("id") % 3 == 0).cast("int"))
    out = sampling.sample_per_group(df, "g", {0: 10, 1: 50}, ["id"])
    got = {r["g"]: r["count"] for r in out.groupBy("g").count().collect()}
    assert got == {0: 10, 1: 34}


def test_f_scores_of_one_pass(spark):
    """Nulls, NaN, a constant and an empty column, against plain aggregates; no SQL aggregate a feature."""
    from visitcast.operators import selection as S
    df = spark.range(0, 900, 1, 5).selectExpr(
        "CASE WHEN id % 7 = 1 THEN NULL ELSE (id * 37 % 101) / 3.0D END AS visitors", "id AS a",
        "CASE WHEN id % 5 = 2 THEN NULL ELSE pmod(xxhash64(id), 50) END AS b", "IF(id = 3, double('NaN'), 1.0D * id) AS c",
        "4 AS same", "CAST(NULL AS DOUBLE) AS none", "id % 2 = 0 AS flag", "CASE WHEN id > 880 THEN id % 9 END AS late")
    features = ["a", "b", "c", "same", "none", "flag", "late"]
    got = {r["feature"]: r for r in S.f_scores(df, features, "visitors").collect()}
    y = F.col("visitors")
    for f in features:
        x = F.col(f).cast("double")
        r, n = df.agg(S.safe_corr(x, y), F.count(F.when(x.isNotNull() & y.isNotNull(), 1))).first()
        assert got[f]["n"] == n
        want = None if r is None else r * r / (1 - r * r) * (n - 2)
        if want is None or want != want:
            assert got[f]["f_score"] is None or got[f]["f_score"] != got[f]["f_score"]
        else:
            assert abs(got[f]["f_score"] - want) <= 1e-9 * (1 + abs(want))
    assert [r["feature"] for r in S.f_score_topk(df, features, "visitors", 9).collect()] == \
        [f for _, f in sorted((-got[f]["f_score"], f) for f in ("a", "b", "flag", "late"))]
    assert S.f_scores(df.where("false"), features, "visitors").where("f_score IS NOT NULL OR n > 0").count() == 0
    assert S.f_scores(df, [], "visitors").count() == 0
