"""Sinks: JSONL, JSON arrays of small results, index tables, idempotent upserts, results by parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.corpus import resume, upsert_latest
from quarry.operators.retrieve import TextIndex, counted_terms, of_tokens, placed_postings, tokenised
from quarry.sources.readers import exists
from quarry.sources.storage import scratch, scratch_path, shared_folder  # noqa: F401

#: Rows of one JSON document.
ROWS_ONE_FILE = 100_000


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, non-ASCII as it is; mode append adds durable progress."""
    df.write.mode(mode).json(path)


def json_document(df: DataFrame, path: str, order: list[str] | None = None, around: tuple[str, str] = ("", "")) -> None:
    """A JSON array, a line for each row, with the text `around` before and after it; in the order given.

    Up to ROWS_ONE_FILE rows are one document in one file. More are dealt by ranges of the order to as many files as
    they need, each a whole document of its own, so that no task writes all of them.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    head, tail = around

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = head + "["
        for b in batches:
            lines = []
            for row in b.column(0).to_pylist():
                lines.append(lead + row)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([("]" if lead == "," else lead + "]") + tail], pa.string())], ["value"])

    n = df.count()
    if not n:  # Spark makes no partition of no rows
        return df.sparkSession.createDataFrame([(f"{head}[]{tail}",)], "value string").coalesce(1).write.mode("overwrite").text(path)
    files = -(-n // ROWS_ONE_FILE)
    rows = df.select(F.to_json(F.struct("*")).alias("value"), *(order or []))
    if order and files > 1:
        rows = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    else:
        rows = rows.repartition(files)
        rows = rows.sortWithinPartitions(*order) if order else rows
    rows.select("value").mapInArrow(run, "value string").write.mode("overwrite").text(path)


def cache_key(df: DataFrame, **parameters: object) -> str:
    """A name for what df computes with these parameters: its plan, schema and parameters, not its rows."""
    from hashlib import md5

    told = [str(df.semanticHash()), df.schema.json(), *(f"{k}={parameters[k]!r}" for k in sorted(parameters))]
    return md5("|".join(told).encode()).hexdigest()


def cached(df: DataFrame, path: str, refresh: bool = False, **parameters: object) -> DataFrame:
    """The table that df gave before, kept in a folder of path for each plan and parameters; written first, if it isn't there.

    So contexts of a retrieval can be read by many evaluations, and another query, setting or model never gets them.
    Whoever changes the rows behind a plan passes a version among the parameters, or refresh.
    """
    spark = df.sparkSession
    path = f"{path.rstrip('/')}/{cache_key(df, **parameters)}"
    if refresh or not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_index(docs: DataFrame, **columns: str) -> TextIndex:
    """An index whose documents are tokenised once, for as many rankings as wanted."""
    return of_tokens(scratch(tokenised(docs, **columns), "tokens"))


#: Folders of a stored text index; a term's hash names its folder.
TERM_BUCKETS = 64


def text_index(docs: DataFrame, path: str, recreate: bool = False, buckets: int = TERM_BUCKETS, **columns: str) -> TextIndex:
    """An inverted index as Parquet tables in folders by the term's hash, sorted by term so that term filters skip row groups too; kept if it is there.

    Postings are dealt by range of (bucket, term, doc_id), so a term that most documents have is written by many tasks.
    """
    spark = docs.sparkSession
    if recreate or not exists(spark, f"{path}/stats/_SUCCESS"):
        held = scratch(counted_terms(tokenised(docs, **columns)), "counted")  # read for ranges, postings and lengths
        placed_postings(held, buckets).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        counted = spark.read.parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
        counted.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        held.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/stats")
    return open_text_index(spark, path)


def open_text_index(spark: SparkSession, path: str) -> TextIndex:
    postings, terms, stats = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "stats"))
    return TextIndex(postings, terms, stats.select("n_docs", "avgdl"), stats.first()["buckets"])


def vector_index(df: DataFrame, path: str, dims: int, vector_col: str = "embedding", recreate: bool = False) -> DataFrame:
    """A table of vectors; a vector of other dimensions fails the write."""
    spark = df.sparkSession
    if recreate or not exists(spark, path):
        right = F.size(vector_col) == dims
        df.withColumn(vector_col, F.when(right, F.col(vector_col)).otherwise(F.raise_error(F.lit(f"vectors must have {dims} dimensions")))).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str, text: str | None = None) -> DataFrame:
    """The table after an upsert by key: the last write wins; rows without a key (or, if its column is named, with a blank text) are skipped."""
    latest = upsert_latest(incoming, key, F.desc(order), text=text)
    return existing.join(latest.select(key), key, "left_anti").unionByName(latest.drop(order), allowMissingColumns=True)


def append_missing(todo: DataFrame, path: str, key: str, transform) -> DataFrame:
    """Append transform(rows of todo whose key isn't in the table at path); can be stopped and started again."""
    spark = todo.sparkSession
    rows = resume(todo, spark.read.parquet(path), key) if exists(spark, path) else todo
    transform(rows).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def files(df: DataFrame, folder: str, path_col: str = "path", content_col: str = "content") -> int:
    """One file for each row, under its path below the folder, with the bytes of its content; returns their number.

    Files are reached by pyarrow's file systems. A file gets its name when it is whole, so tasks may run again.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    from quarry.sources.arrays import opened

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        target, base = opened(folder)
        n, made = 0, set()
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                whole = f"{base.rstrip('/')}/{path}"
                parent, name = whole.rsplit("/", 1)
                if parent not in made:
                    target.create_dir(parent, recursive=True)
                    made.add(parent)
                own = f"{parent}/.{name}.{os.getpid()}"
                with target.open_output_stream(own) as out:
                    out.write(content or b"")
                target.move(own, whole)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = df.select(F.col(path_col).alias("path"), F.col(content_col).cast("binary").alias("content"))
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def by_parameters(df: DataFrame, path: str, **parameters: object) -> None:
    """Results with their parameters as columns that name the folders."""
    for k, v in parameters.items():
        df = df.withColumn(k, F.lit(v))
    df.write.mode("overwrite").partitionBy(*parameters).parquet(path)
