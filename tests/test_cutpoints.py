"""Exact cut points against sorting."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from visitcast.operators import align, cutpoints


def frame(spark, seed=1, n=700):
    rnd = random.Random(seed)
    words = [None, "", "a", "a\x00", "ab", "b", "bé", "b日", "zz", *(f"k{rnd.randrange(90)}" for _ in range(80))]
    rows = [(rnd.choice([0.0, 0.5, 1e-300, -3.25, rnd.gauss(0, 1e6)]), rnd.choice([None, 3, -2 ** 62, 2 ** 62, rnd.randrange(50)]),
             rnd.choice(words), dt.date(1969, 12, 1) + dt.timedelta(days=rnd.randrange(70)), rnd.random() < 0.5, i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "d double, l long, s string, t date, b boolean, i long").repartition(5)


@pytest.mark.parametrize("order", [["d", "l", "i"], ["l", "s", "i"], ["s", "t", "i"], ["t", "b", "i"], ["b", "s", "l", "i"]])
def test_cut_points_against_sorting(spark, monkeypatch, order):
    monkeypatch.setattr(cutpoints, "FETCH", 3)
    rows, df = frame(spark)
    at = [["d", "l", "s", "t", "b", "i"].index(c) for c in order]
    expected = sorted((tuple(r[j] for j in at) for r in rows), key=cutpoints._key)
    ranks = {str(k): k for k in (1, 2, 77, 350, 699, 700, 701)}
    found = cutpoints.cut_points(df.checkpoint(), order, ranks)
    for name, k in ranks.items():
        assert found[name] == (expected[k - 1] if k <= 700 else None), (order, k)
    assert df.where(cutpoints.up_to(order, found["350"])).count() == 350


def test_many_ties_and_groups(spark, monkeypatch):
    monkeypatch.setattr(cutpoints, "FETCH", 10)
    df = spark.range(3000).selectExpr("id % 2 AS g", "1.5D AS v", "id").checkpoint()
    found = cutpoints.cut_points(df, ["v", "id"], {"all": 1500, "g": 1000}, {"g": F.col("g") == 1})
    assert found == {"all": (1.5, 1499), "g": (1.5, 1999)}
    assert cutpoints.cut_points(df.where("id < 0"), ["v", "id"], {"x": 1, "y": 0}) == {"x": None, "y": None}
    same = spark.range(50).selectExpr("7 AS v").checkpoint()
    assert cutpoints.cut_points(same, ["v"], {"x": 20}) == {"x": (7,)}


def test_no_range_shuffle(spark):
    df = spark.range(200).selectExpr("id", "id % 9 AS x", "id % 4 AS y")
    tiers = align.distance_tiers(df, df.where("id > 20"), ["x", "y"], ["id"])
    plan = tiers._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Exchange" not in plan
    assert sorted(r["count"] for r in tiers.groupBy("tier").count().collect()) == [66, 67, 67]
    few = align.distance_tiers(df.where("id < 2"), df, ["x"], ["id"])
    assert sorted(r["tier"] for r in few.collect()) == [1, 2]
