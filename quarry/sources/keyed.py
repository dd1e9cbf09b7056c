"""A table in folders by the hash of its key: an upsert rewrites only the folders whose keys change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.corpus import upsert_latest
from quarry.sources.readers import exists

BUCKETS = 64
_STAGED = "_staged"  # readers leave out what begins with an underscore


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def _write(rows: DataFrame, path: str) -> None:
    """Replace the folders that rows has; others stay as they are."""
    rows.repartitionByRange("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def create(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """A new table of the rows with a key; each key must occur once."""
    _write(df.where(F.col(key).isNotNull()).withColumn("bucket", bucket_of(F.col(key), buckets)), path)


def _apply(spark: SparkSession, path: str, schema) -> None:
    staged = f"{path}/{_STAGED}"
    _write(spark.read.schema(schema).parquet(staged), path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def recover(spark: SparkSession, path: str) -> None:
    """Finish an upsert that was stopped after its rows had been staged whole; forget one that was stopped before."""
    if exists(spark, f"{path}/{_STAGED}/_SUCCESS"):
        _apply(spark, path, spark.read.parquet(f"{path}/{_STAGED}").schema)


def upsert(incoming: DataFrame, path: str, key: str, order: str, text: str | None = None, buckets: int = BUCKETS) -> list[int]:
    """Put incoming rows in place of those with equal keys, the last by order, and tell the folders that were rewritten.

    Rows without a key (or with a blank text, if its column is named) are skipped. The folders are
    written beside the table first, and then put in place, so an upsert that is stopped at any point is
    finished by recover(), which the next one begins with. buckets must be the table's.
    """
    spark = incoming.sparkSession
    recover(spark, path)
    latest = upsert_latest(incoming, key, F.desc(order), text=text).drop(order).withColumn("bucket", bucket_of(F.col(key), buckets))
    changed = sorted(r[0] for r in latest.select("bucket").distinct().collect())  # as many as folders at most
    if not changed:
        return []
    table = spark.read.parquet(path)
    kept = table.where(F.col("bucket").isin(changed)).join(latest.select(key, "bucket"), [key, "bucket"], "left_anti")
    kept.select(table.columns).unionByName(latest.select(table.columns)).write.mode("overwrite").parquet(f"{path}/{_STAGED}")
    _apply(spark, path, table.schema)
    return changed
