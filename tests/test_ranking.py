from pyspark.sql import functions as F

from visitcast.operators.align import ntile_from_rank
from visitcast.operators.ranking import global_row_number


def test_global_row_number_exact_and_partition_free(spark):
    df = spark.range(5000).withColumn("v", (F.col("id") * 7919) % 1000).repartition(9)
    a = global_row_number(df, ["v", "id"], "rn", num_partitions=7).select("id", "v", "rn").toPandas()
    b = global_row_number(df.repartition(3), ["v", "id"], "rn", num_partitions=4).select("id", "rn").toPandas()
    assert sorted(a.rn) == list(range(5000))
    a = a.sort_values(["v", "id"]).reset_index(drop=True)
    assert (a.rn == range(5000)).all()
    assert dict(zip(a.id, a.rn)) == dict(zip(b.id, b.rn))


def test_ntile_from_rank_matches_definition(spark):
    for n in (1, 2, 3, 10, 11):
        df = spark.range(n).withColumn("t", ntile_from_rank(F.col("id"), n, 3))
        got = [r["t"] for r in df.orderBy("id").collect()]
        q, r = divmod(n, 3)
        exp = []
        for tile in range(1, 4):
            exp += [tile] * (q + (1 if tile <= r else 0))
        assert got == exp, (n, got, exp)
