"""The registered opN_<name> queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import conversations, decontaminate, fingerprint, html, langid, lines, merkle, ngrams, packing, quality, simhash, toxicity, warc
from quarry.llm.common import bounded_batches, crc_bucket, shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = crc_bucket(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs, labels.where(~held_out), "toxic")
    return toxicity.predict(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.remove(docs, keep_empty=True, counts=("n_lines", "n_removed"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = shared_path(spark, "warc")
    pages = _table(spark, sf_dir, "pages")
    warc.write(pages, archives)
    kind = pages.schema["page_id"].dataType.simpleString()
    found = warc.read(spark, archives, payload=False)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    real = lambda c: F.when(F.col(c) != simhash.NO_ID, F.col(c))
    return found.select(real("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), real("component_id").alias("component_id"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, labels.where(~held_out), "quality")
    return quality.predict(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = merkle.verify(merkle.manifest(merkle.document_rows(docs, merkle.tampered(docs))), "claimed")
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 5) == 1
    model = ngrams.train(docs.where(~held_out))
    found = ngrams.score(docs, model).withColumn("held_out", held_out)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damaged(_table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_decontaminate, op3_lines, op4_html, op5_packing, op6_warc, op7_fingerprint, op8_simhash, op9_quality, op10_langid, op11_merkle, op12_ngram_lm, op13_conversations)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.ORACLE_SQL, "op6_warc": warc.ORACLE_SQL, "op11_merkle": merkle.ORACLE_SQL, "op13_conversations": conversations.ORACLE_SQL}
