"""Generation in rounds until there are enough different valid results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.corpus import first_wins, head
from quarry.sources.readers import exists


class TooFew(ValueError):
    """No more new results came before there were enough."""


def finished_rounds(spark: SparkSession, path: str) -> int:
    """Rounds at path that were written whole, counted from the first one on."""
    k = 0
    while exists(spark, f"{path}/round={k}/_SUCCESS"):
        k += 1
    return k


def generate_until(spark: SparkSession, path: str, n: int, propose: Callable[[int], DataFrame], key: Column, order: str, patience: int = 3, most_rounds: int = 1000) -> DataFrame:
    """Exactly n rows with different keys, the first ones by round and order, with the round that gave them.

    propose(round) gives a round's valid rows; rows whose key is null are left out. What is new in a round, by an
    anti-join with the keys of the rounds before, is stored at path as a round of its own. A run that is
    stopped and started again goes on behind the last whole round; a part of a round is written anew.
    patience: so many rounds in a row without anything new end the search with TooFew.
    """
    k, idle = finished_rounds(spark, path), 0
    whole = lambda: spark.read.option("basePath", path).parquet(*[f"{path}/round={i}" for i in range(k)])
    found = whole().count() if k else 0
    while found < n:
        if idle == patience or k == most_rounds:
            raise TooFew(f"{found} of {n} rows after {k} rounds")
        new = first_wins(propose(k).withColumn("key", F.sha2(F.encode(key.cast("string"), "utf-8"), 256)).where("key IS NOT NULL"), F.col("key"), F.col(order))
        if k:
            new = new.join(whole().select("key"), "key", "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/round={k}")
        k += 1
        total = whole().count()
        found, idle = total, idle + 1 if total == found else 0
    return head(whole(), n, "round", order).drop("key")
