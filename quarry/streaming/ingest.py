"""Continuous ingestion: new files of documents are upserted into a corpus table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.corpus import clean, first_wins
from quarry.sources.keyed import bucket_of
from quarry.sources.readers import exists
from quarry.sources.storage import scratch


def stream_corpus(spark: SparkSession, folder: str, schema: T.StructType, table: str, checkpoint: str, key: str = "doc_id"):
    """A query that cleans new documents and appends each version of a key's text that the table doesn't have; current() reads the last ones.

    foreachBatch with an anti-join on (key, text_hash): a batch that runs again after a failure adds
    nothing twice. The table lies in folders by the hash of the key, and a batch reads those of its keys only. Of several texts for a key in one batch that with the least hash is taken.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        new = scratch(first_wins(clean(batch), F.col(key), F.col("text_hash")).withColumn("bucket", bucket_of(F.col(key))), "batch")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        if exists(spark, table):
            known = first_wins(spark.read.parquet(table).where(F.col("bucket").isin(touched)), F.col(key), F.desc("epoch"), F.col("text_hash"))
            new = new.join(known.select(key, "text_hash"), [key, "text_hash"], "left_anti")
        new.withColumn("epoch", F.lit(epoch)).write.mode("append").partitionBy("bucket").parquet(table)

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, key: str = "doc_id") -> DataFrame:
    """The last version of each key in a table that stream_corpus wrote."""
    return first_wins(spark.read.parquet(table).drop("bucket"), F.col(key), F.desc("epoch"), F.col("text_hash"))


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by event time window and key; works on streams and on tables alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
