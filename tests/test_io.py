import os
import tempfile

import pytest
from pyspark.sql import functions as F

from visitcast.sources import io


def test_csv_roundtrip_positional_rename_and_materialize(spark):
    base = tempfile.mkdtemp(prefix="visitcast-io-")
    df = spark.createDataFrame([("2017-01-01", "Sunday", 1), ("2017-01-02", "Monday", 0)],
                               "a string, b string, c int").withColumn("a", F.to_date("a"))
    io.write_csv(df, os.path.join(base, "cal"))
    back = io.rename_positional(io.read_csv(spark, os.path.join(base, "cal"), io.DATE_INFO_SCHEMA),
                                ["visit_date", "day_of_week", "holiday_flg"])
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    with pytest.raises(ValueError):
        io.rename_positional(back, ["only_one"])
    path = os.path.join(base, "mat")
    first = io.materialize(df, path)
    assert io.is_materialized(spark, path) and first.count() == 2
    again = io.materialize(df.limit(1), path)      # finished copy exists: reused, not rewritten
    assert again.count() == 2


def test_reuse_by_content(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "id * 2.0 AS v")
    first, path = io.materialize_by_content(df, str(tmp_path), "p")
    same, again = io.materialize_by_content(df.repartition(3), str(tmp_path), "p")
    assert path == again and same.count() == 50
    changed = df.withColumn("v", F.when(F.col("id") == 7, 1.0).otherwise(F.col("v")))
    assert io.fingerprint(changed) != io.fingerprint(df) and io.fingerprint(df, 1) != io.fingerprint(df, 2)
    other, elsewhere = io.materialize_by_content(changed, str(tmp_path), "p")
    assert elsewhere != path and other.where("id = 7").first()["v"] == 1.0
