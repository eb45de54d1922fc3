"""Session helpers: shared checkpoint folder, parallelism, spreading of small inputs."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session the cluster gives."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lintang")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; choose one only where none is set (tests, laptop)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="lintang-checkpoint-")
    sc.setCheckpointDir(configured)


#: Shuffle files of a query go as soon as it has ended, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; it survives a lost executor. Shuffle files are freed."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query takes the setting when it is made
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` returned and nothing reads any more."""
    sc = df.sparkSession.sparkContext
    rdd = df._jdf.queryExecution().logical().rdd()
    sc._jvm.org.apache.spark.rdd.ReliableRDDCheckpointData.cleanCheckpoint(sc._jsc.sc(), rdd.id())


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 4)


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Repartition a scan that has fewer splits than cores, so that Python stages use them all.

    A large input already has many splits and is left alone, so at scale nothing is shuffled.
    """
    spark = df.sparkSession
    wanted = parallelism(spark) * per_core
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted)


def ship(spark: SparkSession, model: Any) -> Callable[[], Any]:
    """Broadcast a model of bounded size, its classes included; call the result on an executor to get it."""
    data = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(data.value)


def default_tokenizer_dir() -> str:
    return os.environ.get("LINTANG_TOKENIZERS", "/opt/tokenizers")
