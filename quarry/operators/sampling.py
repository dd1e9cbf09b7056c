"""Repeatable sampling and splitting: order by md5(seed | key) stands for a seeded shuffle.

Sizes are exact. Where a fixed number of rows is wanted, top-k plans keep only k rows of
each task, so no task sorts the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.order import numbered


def shuffle_key(key: Column | str, seed: int | str = 42) -> Column:
    return F.md5(F.encode(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), "utf-8"))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in shuffled order (a range-partitioned sort)."""
    return df.orderBy(shuffle_key(key, seed), F.col(key))


def sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """min(k, n) rows without replacement; a top-k plan."""
    return df.orderBy(shuffle_key(key, seed), F.col(key)).limit(k)


def stratified(df: DataFrame, stratum: str, key: str, sizes: dict | int, seed: int = 42, strict: bool = False) -> DataFrame:
    """Exactly sizes[s] rows of each stratum (all, if there are fewer). strict: too few rows fail the query when it runs.

    row_number() <= k keeps k rows of each stratum in each task before the shuffle (WindowGroupLimit).
    """
    if isinstance(sizes, dict):
        wanted = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col(stratum)]
        df, most = df.where(F.col(stratum).isin(*sizes)), max(sizes.values())
    else:
        wanted, most = F.lit(sizes), sizes
    w = Window.partitionBy(stratum).orderBy(shuffle_key(key, seed), F.col(key))
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).where(F.col("_rn") <= wanted)
    if strict and isinstance(sizes, dict):
        counts = df.groupBy(stratum).count().agg(F.map_from_entries(F.collect_list(F.struct(stratum, "count"))).alias("m"))
        short = [F.when(F.coalesce(F.col("m")[s], F.lit(0)) < n, F.lit(f"{s} has fewer than {n} rows")) for s, n in sizes.items()]
        checked = counts.select(F.concat_ws("; ", *short).alias("_short")).select(F.assert_true(F.col("_short") == "", F.col("_short")).alias("_ok"))
        out = out.join(F.broadcast(checked), F.col("_ok").isNull(), "left_semi")
    return out.drop("_rn")


def _bands(hashed: DataFrame) -> DataFrame:
    """(_band, _k, _before): rows by the first four digits of the hash (65,536 bands at most), and the rows of lower bands."""
    bands = hashed.groupBy(F.substring("_h", 1, 4).alias("_band")).agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bands.withColumn("_before", before)


def positions(df: DataFrame, key: str, seed: int = 42, name: str = "position") -> DataFrame:
    """df with each row's place in the shuffled order, from 0: counted by bands of the hash and ranked inside them, so no task holds all rows."""
    hashed = df.withColumn("_h", shuffle_key(key, seed))
    inside = Window.partitionBy("_band").orderBy("_h", key)
    ranked = hashed.withColumn("_band", F.substring("_h", 1, 4)).withColumn("_rn", F.row_number().over(inside))
    return ranked.join(F.broadcast(_bands(hashed)), "_band").withColumn(name, F.col("_before") + F.col("_rn") - 1).drop("_h", "_band", "_rn", "_k", "_before")


def split_train_val(df: DataFrame, key: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """df with split = val for the first floor(n * ratio) rows of the shuffle, else train.

    The cut is found by counting: rows are counted in bands of the hash, bands below and above the
    cut are settled as they are, and only the band that holds the cut is ranked.
    """
    hashed = df.withColumn("_h", shuffle_key(key, seed))
    bands = _bands(hashed)
    total = bands.agg(F.floor(F.sum("_k") * F.lit(ratio)).alias("_n"))
    cut = bands.join(F.broadcast(total)).select("_band", F.greatest(F.lit(0), F.least("_k", F.col("_n") - F.col("_before"))).alias("_take"), "_k")
    rows = hashed.withColumn("_band", F.substring("_h", 1, 4)).join(F.broadcast(cut), "_band")
    split = F.col("_take") % F.col("_k") != 0
    settled = rows.where(~split).withColumn("split", F.when(F.col("_take") > 0, F.lit("val")).otherwise(F.lit("train")))
    ranked = rows.where(split).withColumn("_rn", F.row_number().over(Window.partitionBy("_band").orderBy("_h", key)))
    ranked = ranked.withColumn("split", F.when(F.col("_rn") <= F.col("_take"), F.lit("val")).otherwise(F.lit("train"))).drop("_rn")
    return settled.unionByName(ranked).drop("_h", "_band", "_take", "_k")


def _draw(draw: Column, seed: int, j: Column) -> Column:
    """A hashed number for a draw and a step."""
    return F.conv(F.substring(F.md5(F.encode(F.concat(F.lit(f"{seed}|"), draw.cast("string"), F.lit("|"), j.cast("string")), "utf-8")), 1, 14), 16, 10).cast("long")


def few_shot(draws: DataFrame, seeds: DataFrame, draw: str, key: str, k: int = 4, seed: int = 42) -> DataFrame:
    """k different seeds for each draw, in order (shot); all of them, if there are fewer.

    Each draw takes its own k places of the n there are, every set of places alike often: for j from n - k on,
    a hashed place up to j, or j itself if that one is taken already. Places are joined with the seeds
    by an equi-join, so no pairs of draws and seeds are made, and the pool may be of any size.
    """
    ring = positions(seeds, key, seed, "_place")
    size = F.broadcast(seeds.agg(F.count(F.lit(1)).alias("_n")))
    wanted = draws.select(draw).join(size).where("_n > 0")

    def take(held: Column, j: Column) -> Column:
        place = _draw(F.col(draw), seed, j) % (j + 1)
        return F.concat(held, F.array(F.when(F.array_contains(held, place), j).otherwise(place)))

    places = F.aggregate(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("_n") - k), F.col("_n") - 1), F.array().cast("array<bigint>"), take)
    rows = wanted.select(draw, F.posexplode(places).alias("_shot", "_place"))
    return rows.select(draw, "_place", (F.col("_shot") + 1).alias("shot")).join(ring, "_place").drop("_place")


def numbered_ids(df: DataFrame, order: list[str], name: str = "id", pattern: str = "q_%06d") -> DataFrame:
    """Ids from 1-based positions in an order that tells all rows apart; positions are counted by range partitions."""
    return numbered(df, order, name="_position").withColumn(name, F.format_string(pattern, F.col("_position") + 1)).drop("_position")
