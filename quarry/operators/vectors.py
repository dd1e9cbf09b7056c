"""Nearest neighbours by cosine: exact, and by an inverted file of coarse cells.

Vectors and queries are packed into blocks of a matrix each, and a join of blocks makes one
matrix product of each pair of blocks that meet: in the exact search every block of queries
meets every block of vectors, in the inverted file those of a cell that the queries probe.
Ties go to the smaller id. Vectors that are null or of length zero have no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.sampling import shuffle_key
from quarry.sources.readers import exists

#: Rows of a block of vectors and of queries, and the size in bytes up to which all blocks of queries are broadcast.
VECTOR_ROWS, QUERY_ROWS, BLOCK_BYTES = 4096, 1024, 64 << 20
#: The centroids are fitted on so many vectors for each cell at most, in so many rounds.
SAMPLE_PER_CELL, ROUNDS, MOST_CELLS = 64, 10, 4096
#: How many candidates a search needs is measured with so many vectors as queries, for this part of their exact neighbours.
MEASURED, REACHED, NEIGHBOURS = 200, 0.95, 10


#: Places of a matrix of vectors by cells that a task holds at once.
PLACES = 1 << 18


def _few(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many vectors that a matrix of them by cells is bounded."""
    rows = max(1, PLACES // max(1, cells))
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def packed(df: DataFrame, rows: int, id_col: str, vector_col: str, cell: str | None = None) -> DataFrame:
    """(cell, ids array, matrix binary) of float64 rows of length 1: up to `rows` rows of a partition, one cell's after another's."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []
        at, size = None, 0

        def block() -> pa.RecordBatch:
            ids = pa.concat_arrays([x for x, _ in held])
            data = np.concatenate([m for _, m in held]).tobytes()
            columns = [pa.array([at], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["cell", "ids", "matrix"])

        for b in batches:
            cells = np.asarray(b.column("cell"))
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), b.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                while start < end:
                    if size and (cells[start] != at or size == rows):
                        yield block()
                        held, size = [], 0
                    n = min(end - start, rows - size)
                    part = b.slice(start, n)
                    held.append((part.column("id"), unit(_matrix(part.column("v")))))
                    at, size, start = int(cells[start]), size + n, start + n
        if size:
            yield block()

    v = F.col(vector_col).cast("array<double>")
    real = df.select((F.col(cell) if cell else F.lit(0)).cast("int").alias("cell"), F.col(id_col).alias("id"), v.alias("v")).where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) > 0)
    return real.mapInArrow(run, f"cell int, ids array<{kind}>, matrix binary")


def _nearest(k: int, exclude_self: bool):
    """The k best vectors of each joined block for each query of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part = b.slice(i, 1)
                query, vector = part.column("query_ids").flatten(), part.column("ids").flatten()
                q = np.frombuffer(part.column("query_matrix")[0].as_buffer()).reshape(len(query), -1)
                v = np.frombuffer(part.column("matrix")[0].as_buffer()).reshape(len(vector), -1)
                s = np.round(q @ v.T, 6)
                keep = min(k + exclude_self, s.shape[1])
                least = -np.partition(-s, keep - 1, axis=1)[:, keep - 1 : keep]
                at, place = np.nonzero(s >= least)  # ties stay, the final order decides
                yield pa.RecordBatch.from_arrays([query.take(pa.array(at)), vector.take(pa.array(place)), pa.array(s[at, place])], ["query_id", "vec_id", "score"])

    return run


def _best(pairs: DataFrame, kind: str, k: int, exclude_self: bool) -> DataFrame:
    found = pairs.mapInArrow(_nearest(k, exclude_self), f"query_id {kind}, vec_id {kind}, score double")
    if exclude_self:
        found = found.where("query_id <> vec_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _query_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.select("cell", F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"))


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", exclude_self: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, vec_id, score, rank): exact cosine neighbours, in one plan.

    Query blocks are broadcast if they are of block_bytes at most by count; else each goes to the
    groups of vectors by key, so that no task holds all of them.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size(vector_col))).first()
    q = _query_blocks(packed(queries.coalesce(max(1, min(64, -(-n // QUERY_ROWS)))) if n <= 64 * QUERY_ROWS else queries, QUERY_ROWS, id_col, vector_col))
    v = packed(vectors, VECTOR_ROWS, id_col, vector_col)
    if n * (width or 0) * 8 <= block_bytes:
        return _best(v.join(F.broadcast(q), "cell"), kind, k, exclude_self)
    groups = -(-n * width * 8 // block_bytes) * 8
    q = q.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    v = v.withColumn("cell", F.pmod(F.xxhash64("matrix"), F.lit(groups)).cast("int"))
    return _best(v.join(q, "cell"), kind, k, exclude_self)


def centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means of unit rows, from evenly spread rows on; a cell that gets no row keeps its place."""
    c = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        at = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, sample)
        filled = np.linalg.norm(sums, axis=1) > 1e-12
        c = np.where(filled[:, None], unit(sums), c)
    return c


def ivf_index(vectors: DataFrame, path: str, cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42, recreate: bool = False) -> None:
    """An inverted file at path: lists (id, v, cell as folders), centroids (cell, v, size). Kept if it is there.

    cells: the square root of the number of vectors by default, at most MOST_CELLS. Centroids are fitted
    on SAMPLE_PER_CELL vectors a cell, taken by hash; all vectors are put into lists. Lists are dealt
    by range of (cell, id), so that a cell of any size is written by as many tasks as it needs. The number
    of candidates that a search needs is measured and kept (`tuned`): it follows the data, since vectors
    without clusters lie near the borders of many cells.
    """
    spark = vectors.sparkSession
    if not recreate and exists(spark, f"{path}/tuned/_SUCCESS"):
        return
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) > 0)
    n = rows.count()
    cells = max(1, min(cells or round(n**0.5), MOST_CELLS, n))
    got = rows.orderBy(shuffle_key("id", seed), "id").limit(cells * SAMPLE_PER_CELL).select("v").collect()  # bounded by MOST_CELLS
    c = centroids(unit(np.array([r[0] for r in got], dtype=np.float64)), cells) if got else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(c)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches, len(shared.value)):
            cell = np.argmax(unit(_matrix(b.column("v"))) @ shared.value.T, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["id", "v", "cell"])

    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.mapInArrow(assign, f"id {kind}, v array<float>, cell int")
    placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/lists")
    sizes = spark.read.schema(f"id {kind}, v array<float>, cell int").parquet(f"{path}/lists").groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    known = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cell int, v array<double>")
    known.join(sizes, "cell").write.mode("overwrite").parquet(f"{path}/centroids")
    _measure(spark, path, kind, seed)


def _cells(centres: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, centroids and sizes of the cells (MOST_CELLS rows)."""
    got = sorted((r["cell"], r["v"], r["size"]) for r in centres.collect())
    return np.array([x[0] for x in got], np.int32), np.array([x[1] for x in got] or [[0.0]]), np.array([x[2] for x in got], np.int64)


def _order(vectors: np.ndarray, centres: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the places of the cells from the nearest on, and how many vectors the nearer ones hold."""
    order = np.argsort(-(unit(vectors) @ centres.T), axis=1, kind="stable")
    return order, np.cumsum(sizes[order], axis=1) - sizes[order]


def _measure(spark: SparkSession, path: str, kind: str, seed: int) -> None:
    """Write how many candidates bring MEASURED vectors, as queries, REACHED of their exact neighbours."""
    lists = spark.read.schema(f"id {kind}, v array<float>, cell int").parquet(f"{path}/lists")
    asked = lists.orderBy(shuffle_key("id", seed + 1), "id").limit(MEASURED).select("id", "v")
    exact = knn(lists, asked, NEIGHBOURS, "id", "v")
    where = exact.join(lists.select(F.col("id").alias("vec_id"), "cell"), "vec_id").select("query_id", "cell").collect()  # MEASURED * NEIGHBOURS rows
    cells, centres, sizes = _cells(spark.read.parquet(f"{path}/centroids"))
    queries = {r["id"]: r["v"] for r in asked.collect()}
    place = {c: i for i, c in enumerate(cells.tolist())}
    names = {q: i for i, q in enumerate(queries)}
    needed = []
    if where:
        order, before = _order(np.array(list(queries.values()), dtype=np.float64), centres, sizes)
        rank = np.argsort(order, axis=1)
        needed = sorted(int(before[names[r["query_id"]], rank[names[r["query_id"]], place[r["cell"]]]]) + 1 for r in where)
    enough = needed[min(len(needed) - 1, int(REACHED * len(needed)))] if needed else 1
    spark.createDataFrame([(REACHED, NEIGHBOURS, enough)], "reached double, neighbours int, candidates long").write.mode("overwrite").parquet(f"{path}/tuned")


def probes(centres: DataFrame, queries: DataFrame, num_candidates: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, cell): each query with the cells nearest to it, until these hold num_candidates vectors."""
    kind = queries.schema[id_col].dataType.simpleString()
    shared = queries.sparkSession.sparkContext.broadcast(_cells(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, m, sizes = shared.value
        for b in _few(batches, len(cells)):
            if not len(cells):
                continue
            order, before = _order(_matrix(b.column("v")), m, sizes)
            at, place = np.nonzero(before < num_candidates)
            columns = [b.column("id").take(pa.array(at)), b.column("v").take(pa.array(at)), pa.array(cells[order[at, place]])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "v", "cell"])

    real = queries.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) > 0)
    return real.mapInArrow(run, f"id {kind}, v array<float>, cell int")


def ivf_search(spark: SparkSession, path: str, queries: DataFrame, k: int = NEIGHBOURS, num_candidates: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """(query_id, vec_id, score, rank) by the inverted file at path: only lists that a query probes are read.

    num_candidates: the nearest cells are probed until they hold so many vectors; by default what the index measured.
    """
    num_candidates = num_candidates or spark.read.parquet(f"{path}/tuned").first()["candidates"]
    kind = queries.schema[id_col].dataType.simpleString()
    asked = probes(spark.read.parquet(f"{path}/centroids"), queries, num_candidates, id_col, vector_col)
    wanted = [r[0] for r in asked.select("cell").distinct().collect()]  # MOST_CELLS at most
    lists = spark.read.schema(f"id {kind}, v array<float>, cell int").parquet(f"{path}/lists").where(F.col("cell").isin(wanted))
    # A cell that many queries probe is dealt by range like any other; its blocks meet each of its list's blocks
    q = _query_blocks(packed(asked.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), QUERY_ROWS, "id", "v", "cell"))
    return _best(packed(lists, VECTOR_ROWS, "id", "v", "cell").join(q, "cell"), kind, k, exclude_self)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, neighbours, and the part of the exact neighbours that was found."""
    hits = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
