"""Session helpers shared by the library, its tests and the bench."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(app: str = "quern", cpus: int | str = 8, shuffle_partitions: int = 8, driver_memory: str = "12g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_importable(spark)


def settle(spark: SparkSession) -> SparkSession:
    """Keep unions from passing on their inputs' partitioning: in Spark 4.1 adaptive execution can coalesce the inputs differently, and a window or
    join on top then misses rows, or fails to zip them."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def ensure_importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where they share the file system (elsewhere, submit it with --py-files)."""
    settle(spark)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; a temporary folder serves local masters only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quern-checkpoint-")
    sc.setCheckpointDir(named)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, so that later plans read it instead of computing it again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
