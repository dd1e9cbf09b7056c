"""Bounded, repeatable samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, by: str, most: int, key: list[str]) -> DataFrame:
    """About `most` rows for each value of `by` (all where there are fewer), chosen by a hash of key.

    The share taken of a value follows from its count, so no value is gathered in one task. The
    sizes keep to the bound up to chance (a few per cent); the counts are one row for each value.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect() if r[0] is not None}
    if not counts:
        return rows.limit(0)
    scale = 1 << 31
    shares: Column = F.create_map(*[x for v, n in sorted(counts.items()) for x in (F.lit(v), F.lit(min(scale, scale * most // n)))])
    return rows.where(F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(scale)) < shares[F.col(by)])


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of a bounded sample of labelled documents; a document labelled twice counts as its larger label.

    The sampled labels are at most about 2 * most rows, so they may be broadcast; documents aren't shuffled.
    """
    one = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    taken = bounded_sample(one, "label", most, ["doc_id"])
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")
