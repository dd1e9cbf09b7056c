"""Corpus building: cleaning, identity, first-wins deduplication and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X


def first_wins(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key by the given order, which must be unique within a key.

    row_number() = 1 lets Spark cut each map task's rows to one for each key before the shuffle
    (WindowGroupLimit), so a key that many rows share is no hot spot.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def clean(df: DataFrame, text_col: str = "text", least: int = 20) -> DataFrame:
    """text cleaned, text_len and text_hash added; too short texts are dropped before anything is shuffled.

    explode of one element is a fence: the optimizer would push the length filter below a plain
    projection and clean every text twice.
    """
    out = df.withColumn("_cleaned", F.explode(F.array(X.clean_markdown(F.col(text_col))))).withColumn(text_col, F.col("_cleaned")).drop("_cleaned")
    return out.where(F.length(text_col) >= least).withColumns({"text_len": F.length(text_col), "text_hash": X.short_sha1(F.col(text_col), 16)})


def build(df: DataFrame, order_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """Cleaned documents without copies; of equal texts the one that comes first in order stays."""
    return first_wins(clean(df, text_col, least), F.col("text_hash"), F.col(order_col))


def stats(df: DataFrame, text_col: str = "text", least: int = 20) -> DataFrame:
    """One row: input, output, too short, duplicate documents; least, most and mean length of the output.

    Counts and lengths come from one pass: texts are folded to (hash, length) before the shuffle.
    """
    cleaned = df.select(X.clean_markdown(F.col(text_col)).alias("t")).select(F.length("t").alias("n"), F.sha1(F.encode("t", "utf-8")).alias("h"))
    by_text = cleaned.groupBy(F.when(F.col("n") >= least, F.substring("h", 1, 16)).alias("k")).agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"))
    kept = F.col("k").isNotNull()
    return by_text.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("input_docs"),
        F.count_if(kept).alias("output_docs"),
        F.coalesce(F.sum(F.when(~kept, F.col("rows"))), F.lit(0)).alias("skipped_too_short"),
        F.coalesce(F.sum(F.when(kept, F.col("rows") - 1)), F.lit(0)).alias("deduped_by_text_hash"),
        F.coalesce(F.min(F.when(kept, F.col("n"))), F.lit(0)).alias("min_len"),
        F.coalesce(F.max(F.when(kept, F.col("n"))), F.lit(0)).alias("max_len"),
        F.coalesce(F.round(F.avg(F.when(kept, F.col("n"))), 2), F.lit(0.0)).alias("avg_len"),
    )


def path_columns(df: DataFrame, path_col: str, root: str) -> DataFrame:
    """rel_path, title, law_group and doc_id of a file's path."""
    rel = X.relative_path(F.col(path_col), root)
    out = df.withColumn("rel_path", rel)
    return out.withColumns({"title": X.title_of(F.element_at(F.split("rel_path", "/"), -1)), "law_group": X.path_group(F.col("rel_path")), "doc_id": X.short_sha1(F.col("rel_path"), 12)})


def _digest(value: str) -> Column:
    """Stands for a text of any length as a key; null is a value of its own."""
    return F.coalesce(F.sha2(F.encode(F.col(value).cast("string"), "utf-8"), 256), F.lit(""))


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """Each value once, with the position where it came first.

    Rows are compared by digests; a task keeps the first row of each before the shuffle, so a text that many
    rows share moves once a task.
    """
    rows = df.select(value, position, _digest(value).alias("_digest"))
    return first_wins(rows, F.col("_digest"), F.col(position)).select(value, position)


def distinct_until(df: DataFrame, value: str, position: str, n: int) -> DataFrame:
    """The first n different values by the position where each came first: digests find them, and only these n texts are looked up."""
    rows = df.select(value, position, _digest(value).alias("_digest"))
    firsts = rows.groupBy("_digest").agg(F.min(position).alias(position)).orderBy(position, "_digest").limit(n)
    found = rows.join(F.broadcast(firsts), ["_digest", position])
    return first_wins(found, F.col("_digest"), F.col(position)).select(value, position)


def head(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in an order (a limit for dry runs); a top-k plan, no global sort."""
    return df.orderBy(*order).limit(n)


def sorted_corpus(df: DataFrame, *more: str) -> DataFrame:
    """Rows by group and path, chunks also by piece and chunk number: strings in code-point order (range-partitioned)."""
    ordinals = [c for c in ("piece_idx", "chunk_idx") if c in df.columns]
    return df.orderBy("law_group", "rel_path", *ordinals, *more)


def filled(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null or blank."""
    for c in columns:
        df = df.where(X.blank_to_null(F.col(c).cast("string")).isNotNull())
    return df


def upsert_latest(df: DataFrame, key: str, *newest: Column, text: str | None = None) -> DataFrame:
    """The last row of each key: rows without a key, or with a blank text if its column is named, are skipped. newest: order of writing, unique within a key."""
    return first_wins(filled(df, key, *([text] if text else [])), F.col(key), *newest)


def upsert_counts(df: DataFrame, key: str, text: str | None = None, error: str | None = None) -> DataFrame:
    """One row about a bulk upsert: rows, indexed (written rows), failed (rows with an error), skipped (no key or blank text), documents (different keys)."""
    usable = F.lit(True)
    for c in (key, *([text] if text else [])):
        usable = usable & X.blank_to_null(F.col(c).cast("string")).isNotNull()
    failed = F.col(error).isNotNull() if error else F.lit(False)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(usable & ~failed).alias("indexed"), F.count_if(usable & failed).alias("failed"),
        F.count_if(~usable).alias("skipped"), F.count_distinct(F.when(usable & ~failed, F.col(key))).alias("documents"),
    )


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return todo.join(done.select(key), key, "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_count(df: DataFrame, expected: int) -> DataFrame:
    """df; fails when it runs if its number of rows isn't the expected one (checked beside the data, no collect)."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    checked = n.select(F.assert_true(F.col("_n") == expected, F.concat(F.lit(f"expected {expected} rows, found "), F.col("_n").cast("string"))).alias("_ok"))
    return df.join(F.broadcast(checked), F.col("_ok").isNull(), "left_semi")
