"""Segmentation of documents into articles and overlapping chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import ChunkConfig
from quarry.functions import text as X


def split_articles(c: Column) -> Column:
    """Pieces that begin at each article head (also where a text refers to one); the whole text if there is one piece at most."""
    pieces = F.filter(F.transform(F.split(c, f"(?={X.ARTICLE})"), X.strip), lambda p: p != "")
    return F.when(F.size(pieces) > 1, pieces).otherwise(F.filter(F.array(X.strip(c)), lambda p: p != ""))


def _bound(value: Column, f) -> Column:
    """f(value), the value evaluated once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _parts(piece: Column, separator: str) -> Column:
    """The piece cut before each separator; no part is empty."""
    if not separator:
        return F.split(piece, "")
    between = F.split(piece, re.escape(separator))
    return F.filter(F.transform(between, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(separator), x))), lambda x: x != "")


def _windows(parts: Column, cfg: ChunkConfig) -> Column:
    """(first, last, whole) of the chunks of consecutive parts.

    A fold over the parts with the window that is open: it closes before the part that would make it too
    long, and opens again with as many of its last parts as overlap and size allow. A part of
    cfg.size characters and more closes it and stands alone (whole).
    """
    window = lambda first, last, whole: F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), F.lit(whole).alias("whole"))
    state = lambda out, start, n, total: F.struct(out.alias("out"), start.cast("int").alias("start"), n.cast("int").alias("n"), total.cast("int").alias("total"))
    closed = lambda held: F.concat(held["out"], F.array(window(held["start"] + 1, held["n"], False)))
    closed_if_open = lambda held: F.when(held["start"] < held["n"], closed(held)).otherwise(held["out"])

    def step(held: Column, part: Column) -> Column:
        size, i = F.length(part), held["n"] + 1
        kept = lambda count, total, more: F.struct(count.cast("int").alias("count"), total.cast("int").alias("total"), more.alias("more"))
        room = F.least(F.lit(cfg.overlap), cfg.size - size)
        longer = lambda k, x: F.when(k["more"] & (k["total"] + F.length(x) <= room), kept(k["count"] + 1, k["total"] + F.length(x), F.lit(True))).otherwise(kept(k["count"], k["total"], F.lit(False)))
        behind = F.aggregate(F.reverse(F.slice(parts, held["start"] + 1, held["n"] - held["start"])), kept(F.lit(0), F.lit(0), F.lit(True)), longer)
        return (
            F.when(size >= cfg.size, state(F.concat(closed_if_open(held), F.array(window(i, i, True))), i, i, F.lit(0)))
            .when((held["total"] > 0) & (held["total"] + size > cfg.size), _bound(behind, lambda b: state(closed(held), held["n"] - b["count"], i, b["total"] + size)))
            .otherwise(state(held["out"], held["start"], i, held["total"] + size))
        )

    none = F.array().cast("array<struct<first:int,last:int,whole:boolean>>")
    return F.aggregate(parts, state(none, F.lit(0), F.lit(0), F.lit(0)), step, closed_if_open)


def _cut(piece: Column, cfg: ChunkConfig, separators: tuple[str, ...]) -> Column:
    """Chunks of a piece of cfg.size characters and more; parts that are too long still go on to the finer separators."""
    finer = separators[1:]

    def chunks(parts: Column, w: Column) -> Column:
        text = F.array_join(F.slice(parts, w["first"], w["last"] - w["first"] + 1), "")
        own = lambda t: F.filter(F.array(X.strip(t)), lambda x: x != "")
        return F.when(w["whole"], _bound(text, lambda t: _cut(t, cfg, finer)) if finer else F.array(text)).otherwise(own(text))

    return _bound(_parts(piece, separators[0]), lambda parts: F.flatten(F.transform(_windows(parts, cfg), lambda w: chunks(parts, w))))


def recursive_chunks(c: Column, cfg: ChunkConfig) -> Column:
    """Chunks of a piece, by expressions of the JVM alone; pieces below cfg.size characters are only stripped."""
    own = _bound(X.strip(c), lambda t: F.filter(F.array(t), lambda x: x != ""))
    return F.when(F.length(c) >= cfg.size, _cut(c, cfg, cfg.separators)).otherwise(own)


def chunk(docs: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks with ordinals over all raw chunks; those below cfg.least characters carry kept = false.

    docs: doc_id, title, law_group, rel_path, text; blank texts give nothing.
    """
    pieces = split_articles(F.col("text")) if cfg.by_article else F.array(F.col("text"))
    rows = docs.where(X.strip(F.col("text")) != "").select("doc_id", "title", "law_group", "rel_path", F.posexplode(pieces).alias("piece_idx", "piece"))
    rows = rows.withColumn("source", X.article_source(F.col("title"), F.col("piece")))
    rows = rows.select("*", F.posexplode(recursive_chunks(F.col("piece"), cfg)).alias("chunk_idx", "chunk")).withColumn("text", X.strip(F.col("chunk")))
    return rows.select(
        X.chunk_id(F.col("doc_id"), F.col("piece_idx"), F.col("chunk_idx"), F.col("text")).alias("chunk_id"),
        "doc_id", "title", "law_group", "rel_path", "source", "piece_idx", "chunk_idx", "text", F.length("text").alias("text_len"), (F.length("text") >= cfg.least).alias("kept"),
    )


def chunk_stats(docs: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """One row: documents, pieces, chunks kept and filtered, with the settings."""
    c = chunk(docs, cfg)
    n = docs.agg(F.count(F.lit(1)).alias("input_docs"))
    found = c.agg(F.count_if(F.col("chunk_idx") == 0).alias("article_pieces"), F.count_if("kept").alias("output_chunks"), F.count_if(~F.col("kept")).alias("filtered_too_short"))
    return n.join(F.broadcast(found)).select(F.lit(cfg.size).alias("chunk_size"), F.lit(cfg.overlap).alias("chunk_overlap"), F.lit(cfg.by_article).alias("split_by_article"), F.lit(cfg.least).alias("min_chunk_len"), "*")
