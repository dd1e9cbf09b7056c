"""Positions in a total order, found without a task that holds all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.storage import scratch

_IN_PARTITION = (1 << 33) - 1  # low bits of monotonically_increasing_id


def numbered(df: DataFrame, order: list[str], within: list[str] | tuple[str, ...] = (), name: str = "position", total: str | None = None) -> DataFrame:
    """df with each row's place from 0 by the ascending order, nulls first; within: a numbering of its own for each of these keys.

    Rows are range-partitioned and sorted once and stored with their place in the partition. The
    partitions' counts give what lies before each: one row for each partition and key, so a key
    that most rows share is spread like any other. total: name of a column for the rows of the key.
    df is read twice (range partitioning samples it), so it should be cheap; rows that tie in the
    whole order may take each other's places.
    """
    spark, keys = df.sparkSession, [*within, *order]
    here = {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))}
    placed = scratch(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns(here), "numbered")
    runs = placed.groupBy("_part", *within).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_start"))
    if within:
        w = Window.partitionBy(*within)
        runs = runs.withColumns({"_before": F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_n").over(w)})
    else:  # a row for each partition
        found = sorted((r["_part"], r["_n"]) for r in runs.collect())
        sums = accumulate((n for _, n in found), initial=0)
        known = spark.createDataFrame([(p, b) for (p, _), b in zip(found, sums, strict=False)], "_part int, _before long")
        runs = runs.join(F.broadcast(known), "_part").withColumn("_total", F.lit(sum(n for _, n in found)).cast("long"))
    own = {c: f"_{k}_key" for k, c in enumerate(within)}
    match = F.col("_part") == F.col("_of")
    for c, k in own.items():
        match = match & F.col(c).eqNullSafe(F.col(k))
    out = placed.join(runs.select(F.col("_part").alias("_of"), *[F.col(c).alias(k) for c, k in own.items()], "_start", "_before", "_total"), match)
    out = out.withColumn(name, F.col("_at") - F.col("_start") + F.col("_before"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_part", "_at", "_of", *own.values(), "_start", "_before", "_total")


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with running sums of columns (name -> column) by an order that tells rows apart; null counts as 0.

    Like numbered(): partitions by range, whose totals (a row for each) give what lies before, so no task holds all rows.
    """
    spark = df.sparkSession
    placed = scratch(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "running")
    totals = placed.groupBy("_part").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in sums.items()])
    found = sorted(map(tuple, totals.collect()))
    before = [list(accumulate((r[k + 1] for r in found), initial=0)) for k in range(len(sums))]
    known = spark.createDataFrame([(r[0], *[b[i] for b in before]) for i, r in enumerate(found)], "_part int, " + ", ".join(f"_before{k} long" for k in range(len(sums))))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(known), "_part")
    out = out.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"_before{k}") for k, (n, c) in enumerate(sums.items())})
    return out.drop("_part", *[f"_before{k}" for k in range(len(sums))])
