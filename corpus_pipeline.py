"""From raw documents to packed training sequences: five operators of quarry.llm in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. A stage's result is written
as Parquet and read again as the next one's docs, so a lost executor costs one stage's tasks
at most. All stages but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, langid, lines, packing, similar
from quarry.llm.common import bounded_batches, discard, stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _length(docs: DataFrame) -> str | None:
    return "n_chars" if "n_chars" in docs.columns else None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that most of them fits, go."""
    bounded_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat earlier ones are deleted; documents of which nothing is left go."""
    bounded_batches(spark)
    return lines.remove(docs, length_col=_length(docs))


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash fingerprints or banded minima lead to, and that share 0.8 and more of their five-word shingles, step by step, that with the smallest id stays."""
    bounded_batches(spark)
    return similar.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that occur in the benchmark are cut out; documents that consist of little else go."""
    bounded_batches(spark)
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), length_col=_length(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 2048."""
    bounded_batches(spark)
    return packing.pack(docs, TOKENIZER, ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("near_dedup", deduplicate_documents),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # tokenizer, language model and similarities are beyond SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            made = stored(made, name)
            if k:
                discard(docs)  # nothing reads the stage before any more
        docs = made
    return docs
