"""Stateful operators of streams: first rows of keys, and running rates, kept by Spark's state store.

They give, batch by batch, what `corpus.first_wins` and `metrics.running_rate` give for a table
whose rows come in the same order; a query that is started again goes on with the state of its
checkpoint. Rows of a key are ordered within a batch only: what comes in a later batch is later.

Rows are dealt to groups of keys, whose rows of a batch are taken together: a call costs as much for
a row as for thousands. Each key has its own entry in the state, and a batch touches those of its keys only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.sources.keyed import bucket_of

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Groups of keys. A checkpoint goes on with the number it began with; a group's rows of one batch are held in memory.
GROUPS = 256

_GROUP, _KEY = "running_group", "running_key"


def with_state_store(spark: SparkSession) -> None:
    """The state store that these operators need, where the session names no other."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(key, "HDFSBacked"):
        spark.conf.set(key, _STORE)


class _First(StatefulProcessor):
    """The first row of each key of a group; a key is forgotten after `expiry` milliseconds, if that is given."""

    def __init__(self, order: str, expiry: int | None) -> None:
        self.order, self.expiry = order, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "known boolean", self.expiry)

    def _least(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(self.order, kind="stable").drop_duplicates(_KEY)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802, Spark's name
        first = self._least(pd.concat([self._least(pdf) for pdf in rows]))
        new = [not self.seen.containsKey((k,)) for k in first[_KEY]]
        first = first[new]
        for k in first[_KEY]:
            self.seen.updateValue((k,), (True,))
        yield first.drop(columns=[_GROUP, _KEY])

    def close(self) -> None:
        pass


class _Rate(StatefulProcessor):
    """Rows of a group with the rows of their key so far, and the rate of hits among these."""

    def __init__(self, order: str, hit: str, expiry: int | None) -> None:
        self.order, self.hit, self.expiry = order, hit, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getMapState("sums", "key string", "seen long, hits long", self.expiry)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802, Spark's name
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")  # one group's rows of one batch
        place, found = pd.factorize(batch[_KEY], use_na_sentinel=False)
        keys = [(None if pd.isna(k) else k,) for k in found]
        held = np.array([self.sums.getValue(k) if self.sums.containsKey(k) else (0, 0) for k in keys], dtype="int64")
        of_key = batch[self.hit].groupby(place)
        seen = held[place, 0] + of_key.cumcount().to_numpy() + 1
        hits = held[place, 1] + of_key.cumsum().to_numpy()
        for k, n, h in zip(keys, (held[:, 0] + of_key.size()).tolist(), (held[:, 1] + of_key.sum()).tolist(), strict=True):
            self.sums.updateValue(k, (n, h))
        yield batch.assign(seen=seen, rate=hits / seen).drop(columns=[self.hit, _GROUP, _KEY])

    def close(self) -> None:
        pass


def _grouped(rows: DataFrame, key: str):
    """rows by groups of keys; the key goes along as text, in which nulls stay nulls."""
    return rows.withColumns({_GROUP: bucket_of(F.col(key), GROUPS), _KEY: F.col(key).cast("string")}).groupBy(_GROUP)


def first_of_keys(stream: DataFrame, key: str, order: str, expiry: int | None = None) -> DataFrame:
    """The first row of each key over the life of the stream; rows without a key are left out. expiry: milliseconds after which a key may come again."""
    with_state_store(stream.sparkSession)
    rows = stream.where(F.col(key).isNotNull())
    return _grouped(rows, key).transformWithStateInPandas(_First(order, expiry), stream.schema, "Append", "ProcessingTime" if expiry else "None")


def running_rates(stream: DataFrame, hit: Column, order: str, key: str, expiry: int | None = None) -> DataFrame:
    """stream with seen and rate: rows of the key so far, and the part of them that are hits; null keys are a key of their own."""
    with_state_store(stream.sparkSession)
    rows = stream.withColumn("running_hit", F.coalesce(hit, F.lit(False)).cast("long"))
    schema = T.StructType([*stream.schema.fields, T.StructField("seen", T.LongType()), T.StructField("rate", T.DoubleType())])
    return _grouped(rows, key).transformWithStateInPandas(_Rate(order, "running_hit", expiry), schema, "Append", "ProcessingTime" if expiry else "None")
