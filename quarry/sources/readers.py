"""Readers with declared schemas: Markdown trees, JSONL in three degrees of strictness, JSON arrays, CSV, templates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import parse as J
from quarry.functions import text as X
from quarry.operators.corpus import path_columns, require_columns
from quarry.sources import arrays


@F.pandas_udf(T.StringType())
def decode_ignore(content: pd.Series) -> pd.Series:
    """UTF-8 without the bytes that aren't (Spark's own decoder would put replacement characters)."""
    return content.map(lambda b: None if b is None else b.decode("utf-8", "ignore"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def nested_root(spark: SparkSession, root: str, nested: str) -> str:
    """root/nested if that is there, else root; an error if neither is."""
    for candidate in (f"{root.rstrip('/')}/{nested}", root):
        if exists(spark, candidate):
            return candidate
    raise FileNotFoundError(root)


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, title, law_group, doc_id, text, file_sha1) of all .md files below root, but those with a hidden part in their path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    base = "/" + root.split(":", 1)[-1].strip("/")
    rows = files.withColumn("path", F.regexp_replace("path", "^[a-z0-9]+:/+", "/")).where(~F.col("path").rlike(r"/\."))
    out = path_columns(rows, "path", base)
    return out.select("rel_path", "title", "law_group", "doc_id", decode_ignore("content").alias("text"), F.sha1("content").alias("file_sha1"))


def jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Strict: a line that isn't JSON fails the query; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_no_blanks(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Strictest: a blank line fails the query too."""
    line = F.col("value")
    checked = F.when(J.is_json_object(X.strip(line)), line).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.left(line, F.lit(80)))))
    return spark.read.text(path).select(F.from_json(checked, schema).alias("r")).select("r.*")


def of_category(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of one category; a filter that reaches the scan."""
    return df.where(F.col(column) == value)


def jsonl_lenient(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Lines that aren't one whole JSON object are left out, also those with text after the object."""
    lines = spark.read.text(path).where(J.is_json_object(X.strip(F.col("value"))))
    return lines.select(F.from_json(X.strip(F.col("value")), schema).alias("r")).select("r.*")


def jsonl_counted(spark: SparkSession, path: str | list[str], required: list[str]) -> DataFrame:
    """One row: lines, bad (blank or no object), missing (an object without a required key), good."""
    value = X.strip(F.col("value"))
    ok = J.is_json_object(value)
    has = F.lit(True)
    for k in required:
        has = has & F.array_contains(F.json_object_keys(value), k)
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"), F.count_if(~ok).alias("bad"), F.count_if(ok & ~F.coalesce(has, F.lit(False))).alias("missing"), F.count_if(ok & F.coalesce(has, F.lit(False))).alias("good"))


def jsonl_observed(spark: SparkSession, path: str | list[str], schema: T.StructType, required: list[str]) -> tuple[DataFrame, Observation]:
    """Good rows, and the counters of jsonl_counted as an observation that is there when an action has read all of them: one scan for both."""
    value = X.strip(F.col("value"))
    keys = F.when(J.is_json_object(value), F.json_object_keys(value))
    kind = F.when(keys.isNull(), 0).when(F.size(F.array_except(F.array(*map(F.lit, required)), keys)) > 0, 1).otherwise(2)
    seen = Observation()
    told = [F.count(F.lit(1)).alias("lines"), *[F.count_if(F.col("kind") == k).alias(n) for k, n in enumerate(("bad", "missing", "good"))]]
    rows = spark.read.text(path).select("value", F.explode(F.array(kind)).alias("kind")).observe(seen, *told)
    return rows.where("kind = 2").select(F.from_json(value, schema).alias("r")).select("r.*"), seen


def json_array(spark: SparkSession, path: str, schema: T.StructType, required: list[str] = (), range_bytes: int = arrays.RANGE_BYTES) -> DataFrame:
    """Rows of a file that holds one JSON array, or of all files of a folder; a file is read by a task for each range of bytes."""
    return require_columns(arrays.rows(spark, path, schema, range_bytes=range_bytes), *required)


def wrapped_array(spark: SparkSession, path: str, schema: T.StructType, range_bytes: int = arrays.RANGE_BYTES) -> DataFrame:
    """Rows of an array, or of an object's first list under data, items, samples or examples."""
    return arrays.rows(spark, path, schema, True, range_bytes)


def csv(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """Rows of CSV files with a header; quotes inside a field are doubled, fields may hold line feeds."""
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    require_columns(header, *required)
    names = [f for f in schema.fields if f.name in header.columns]
    return header.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in names])


def partitioned_jsonl(spark: SparkSession, folder: str, labels: dict[str, str], schema: T.StructType, label_col: str) -> DataFrame:
    """Files <prefix>_*.jsonl; rows whose label is that of their file, with file_name. The folder is listed as one path, not file by file."""
    out = None
    for prefix, label in labels.items():
        text = spark.read.option("pathGlobFilter", f"{prefix}_*.jsonl").text(folder).select(X.strip(F.col("value")).alias("v"), F.col("_metadata.file_name").alias("file_name"))
        rows = text.where(J.is_json_object(F.col("v"))).select(F.from_json("v", schema).alias("r"), "file_name").select("r.*", "file_name")
        rows = rows.where(F.col(label_col) == label)
        out = rows if out is None else out.unionByName(rows)
    return out


def template(spark: SparkSession, path: str | None, required: list[str], default: str | None = None) -> str:
    """A prompt template; its placeholders must be there. default stands in for a file that isn't."""
    if path is None or not exists(spark, path):
        if default is None:
            raise FileNotFoundError(path)
        found = default
    else:
        found = spark.read.text(path, wholetext=True).first()[0]
    missing = [p for p in required if p not in found]
    if missing:
        raise ValueError(f"template lacks {', '.join(missing)}")
    return found
