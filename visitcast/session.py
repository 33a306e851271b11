"""Session helpers.

Library code never creates its own session; it takes the one it is given.
``local_session`` is for tests, the bench and scripts only.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Session settings the library relies on (all public Spark options).
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime broadcast only after a shuffle stage has measured the side.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    # Joins on (origin, store, x) may reuse a (origin, store) partitioning.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "visitcast") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_conf(spark: SparkSession) -> SparkSession:
    """Give an existing session the recommended runtime SQL settings it has not
    set itself (the partition keeping of joins is needed by the plans)."""
    for k, v in RECOMMENDED_CONF.items():
        if not spark.sparkContext.getConf().contains(k):
            spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder in use.

    A folder that is already set on the context wins, then the one the cluster
    names in ``spark.checkpoint.dir``.  Only where neither is set, as in local
    tests, a private folder is made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="visitcast-ckpt-"))
    return sc.getCheckpointDir()


def show_workers_the_package(spark: SparkSession) -> None:
    """Put the folder this package was imported from on the Python workers'
    path (the driver may have it from ``sys.path`` only)."""
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


@contextmanager
def sql_conf(spark: SparkSession, **settings):
    """Set runtime SQL settings for a block, then restore them."""
    keys = {k.replace("__", "."): v for k, v in settings.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def partitioned_checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (shared checkpoint folder) that keeps the frame's
    hash partitioning visible to later plans.

    With adaptive execution on, a checkpoint records an unknown partitioning
    (the adaptive plan is not final when it is read), so every later
    group-by on the same key would shuffle again; the checkpoint job itself
    therefore runs without it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with sql_conf(spark, **{"spark__sql__adaptive__enabled": "false"}):
        return df.checkpoint(eager=True)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Eager checkpoint into the shared checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
