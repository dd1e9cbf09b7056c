"""The folder that driver and executors share, and tables that are written once for several readers."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a folder of the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return base.rstrip("/")


_scratch: list[tuple[SparkSession, str]] = []


def _sweep() -> None:
    for spark, path in _scratch:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_sweep)
    _scratch.append((spark, path))
    return path


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back, for plans that use it several times."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
