"""Helpers shared by the operators: shared storage, worker-lived caches, column names."""

from __future__ import annotations

import atexit
import pickle
import sys
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.storage import shared_folder

_written: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    if not _written:
        atexit.register(_remove_all)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001, the JVM may be gone already
            continue


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what stored() wrote, once nothing reads it any more."""
    drop_path(df.sparkSession, df._stored_path)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, shared by its tasks.

    An operator's cache goes when another operator asks for its own, so a worker that serves
    one stage after another holds one of them.
    """
    module = sys.modules.setdefault("_quarry_worker_cache", types.ModuleType("_quarry_worker_cache"))
    if name != _MODELS:
        for other in [k for k, v in module.__dict__.items() if isinstance(v, dict) and k not in (name, _MODELS) and not k.startswith("__")]:
            del module.__dict__[other]
    return module.__dict__.setdefault(name, {})


_MODELS = "models"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, name: str = "") -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows: texts are held as Python objects for one part at a time.

    name: the operator's; what other operators cached in this worker is dropped.
    """
    if name:
        worker_cache(name)
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    pa.default_memory_pool().release_unused()


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Send texts to Python workers in small Arrow batches, so that memory doesn't follow their length; a session's own settings stay."""
    for key, usual, value in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, value)


class Shipped:
    """An object broadcast to the workers with its class (pickled by value), unpacked once in each worker."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.key = uuid.uuid4().hex
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> object:
        held = worker_cache(_MODELS)
        if self.key not in held:
            if len(held) > 1:  # two at most, so that many broadcast objects in turn don't pile up
                held.clear()
            held[self.key] = pickle.loads(self.data.value)
        return held[self.key]


def fresh(name: str, columns: list[str]) -> str:
    """name, lengthened until it clashes with no column (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: What a null id counts as: the least integer; the empty text where ids are of another type.
NO_ID = -(1 << 63)


def id_kind(df: DataFrame, id_col: str) -> str:
    """Spark's name for the type that an operator takes ids as: integers as long, all others as their text."""
    return "long" if isinstance(df.schema[id_col].dataType, T.IntegralType) else "string"


def id_of(df: DataFrame, id_col: str) -> Column:
    """The id as a long or as text, never null."""
    kind = id_kind(df, id_col)
    return F.coalesce(F.col(id_col).cast(kind), F.lit(NO_ID if kind == "long" else ""))


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus; null ids count as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % modulus


def crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text."""
    step = "list_reduce([xor(c, b)] || CAST(range(8) AS BIGINT[]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    return f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda c, b: {step}), 4294967295)"
