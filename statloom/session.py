"""Session set-up."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it (clusters may ship it with --py-files instead)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, **more: str) -> SparkSession:
    """A session for tests and single machines."""
    conf = {
        "spark.master": f"local[{cores}]", "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.config(map=conf | more).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return importable(spark)


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder that all executors share (spark.checkpoint.dir) and read it back: lineage ends here, and nothing is lost with an executor.

    A session on one machine that names no folder gets one of its own.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if not (folder := context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()):
        import tempfile

        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
