"""Queries of single functions over whole tables, of readers and sinks as round trips, and of providers with plain stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import ChunkConfig
from quarry.functions import parse as J
from quarry.functions import providers as M
from quarry.functions import text as X
from quarry.operators import chunk as C
from quarry.operators import corpus as K
from quarry.operators import generate as G
from quarry.operators import metrics as E
from quarry.operators import posttrain as P
from quarry.operators import retrieve as R
from quarry.operators import sampling as N
from quarry.plans.base import WS, query, strip_sql, table
from quarry.plans.retrieval import tokens_sql
from quarry.sources import keyed, readers, sinks
from quarry.streaming import state

_PAIRS = "(SELECT u.conv_id, u.turn, u.text AS query, a.text AS answer FROM conversations AS u JOIN conversations AS a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.qa_pairs(table(spark, sf_dir, "conversations"))


def _visible(x: str) -> str:
    return strip_sql(f"regexp_replace(coalesce({x}, ''), '[​﻿]', '', 'g')")


# Functions


@query("SELECT event_id, coalesce(json_extract_string(props, '$.page'), '') AS page, coalesce(json_extract_string(props, '$.absent'), '') AS absent FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", J.json_field(F.col("props"), "page").alias("page"), J.json_field(F.col("props"), "absent").alias("absent"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def json_lenient_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in a code fence, with typographic quotes and text after the end."""
    dirty = F.concat(F.lit("```json\n"), F.regexp_replace("props", '"', "”"), F.lit("\n```"))
    e = table(spark, sf_dir, "events").withColumn("raw", F.when(F.col("event_id") % 2 == 0, dirty).otherwise(F.concat(F.col("props"), F.lit(" and so on }"))))
    return e.select("event_id", F.get_json_object(J.lenient_object(F.col("raw")), "$.page").alias("page"))


@query("SELECT event_id, props AS found FROM events")
def json_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("so } it is: "), F.col("props"), F.lit(' {"a": 1} {'))
    return table(spark, sf_dir, "events").select("event_id", J.balanced(raw).alias("found"))


@query(f"SELECT conv_id, turn, q AS query, a AS answer FROM (SELECT conv_id, turn, regexp_replace({strip_sql('query')}, '{WS}+', ' ', 'g') AS q, regexp_replace({strip_sql('answer')}, '{WS}+', ' ', 'g') AS a FROM {_PAIRS}) WHERE q <> '' AND a <> ''")
def qa_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("x", J.normalise_qa(F.col("query"), F.col("answer"))).where("x IS NOT NULL").select("conv_id", "turn", "x.*")


_PLAIN = " AND ".join(f"NOT starts_with({c}, '{p}')" for c in ("i", "o") for p in J.BOILERPLATE)


@query(f"SELECT conv_id, turn, i AS instruction, '' AS input, o AS output FROM (SELECT conv_id, turn, {_visible('query')} AS i, {_visible('answer')} AS o FROM {_PAIRS}) WHERE i <> '' AND length(o) >= 20 AND {_PLAIN}")
def sft_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("x", J.valid_sft(F.col("query"), F.col("answer"))).where("x IS NOT NULL").select("conv_id", "turn", "x.*")


@query("SELECT doc_id, coalesce(string_split(text, ' ')[1], '') AS first, '' AS none FROM documents")
def first_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.first_or_empty(F.split("text", " ")).alias("first"), X.first_or_empty(F.array().cast("array<string>")).alias("none"))


@query("SELECT conv_id, turn, CAST(2 AS INTEGER) AS messages, 'system' AS role, 'Be brief.' AS system, text AS content, text AS alone FROM conversations WHERE role = 'user'")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'").withColumns({"m": X.chat(F.col("text"), "Be brief."), "n": X.chat(F.col("text"))})
    return c.select("conv_id", "turn", F.size("m").alias("messages"), F.col("m")[0]["role"].alias("role"), F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("content"), F.col("n")[0]["content"].alias("alone"))


@query("SELECT page_id, coalesce(nullif(list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1), ''), 'base') || '__dpo_lora_d' || page_id AS plain, 'qwen2.5_7b__sft_lora_s__dpo_lora_d' || page_id AS both FROM pages")
def model_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    dpo = F.concat(F.lit("out/d"), F.col("page_id").cast("string"), F.lit("//"))
    return table(spark, sf_dir, "pages").select("page_id", X.model_tag(F.col("url"), dpo).alias("plain"), X.model_tag(F.lit("x/Qwen2.5-7B-Instruct"), dpo, F.lit("s/")).alias("both"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS preview FROM documents")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text"), 80).alias("preview"))


@query("SELECT item_id, printf('q_%06d', row_number() OVER (ORDER BY item_id)) AS id FROM benchmark")
def numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.numbered_ids(table(spark, sf_dir, "benchmark").select("item_id"), ["item_id"])


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS position FROM documents")
def shuffle_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.positions(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


# Corpus, chunks, limits


_WHOLE = ChunkConfig(size=1_000_000_000, least=30, by_article=False)


@query(f"SELECT doc_id, CAST(length(p) AS BIGINT) AS text_len, length(p) >= 30 AS kept FROM (SELECT doc_id, {strip_sql('text')} AS p FROM documents) WHERE p <> ''")
def chunk_whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("t").alias("title"), F.col("source").alias("law_group"), F.lit("p").alias("rel_path"), "text")
    return C.chunk(docs, _WHOLE).select("doc_id", F.col("text_len").cast("long").alias("text_len"), "kept")


@query(f"SELECT count(*) AS input_docs, count_if(p <> '') AS article_pieces, count_if(length(p) >= 30) AS output_chunks, count_if(p <> '' AND length(p) < 30) AS filtered_too_short FROM (SELECT {strip_sql('text')} AS p FROM documents)")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("t").alias("title"), F.col("source").alias("law_group"), F.lit("p").alias("rel_path"), "text")
    return C.chunk_stats(docs, _WHOLE).select("input_docs", "article_pieces", "output_chunks", "filtered_too_short")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text ORDER BY doc_id, text LIMIT 50")
def distinct_first_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.distinct_until(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id", 50)


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def head_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.head(table(spark, sf_dir, "documents").select("doc_id", "lang"), 25, "doc_id")


@query("SELECT source AS law_group, lang AS rel_path, doc_id FROM documents")
def corpus_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sorted_corpus(table(spark, sf_dir, "documents").select(F.col("source").alias("law_group"), F.col("lang").alias("rel_path"), "doc_id"), "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'fr'")
def one_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.of_category(table(spark, sf_dir, "documents"), "lang", "fr").select("doc_id", "n_chars")


@query(f"SELECT count(*) AS rows, count_if({strip_sql('text')} <> '' AND turn % 5 <> 0) AS indexed, count_if({strip_sql('text')} <> '' AND turn % 5 = 0) AS failed, count_if({strip_sql('text')} = '') AS skipped, count(DISTINCT CASE WHEN {strip_sql('text')} <> '' AND turn % 5 <> 0 THEN conv_id END) AS documents FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)")
def upsert_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("error", F.when(F.col("turn") % 5 == 0, F.lit("refused")))
    return K.upsert_counts(c, "conv_id", "text", "error")


@query(f"SELECT conv_id, turn, text FROM conversations WHERE {strip_sql('text')} <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def upsert_skips_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.upsert_latest(table(spark, sf_dir, "conversations"), "conv_id", F.desc("turn"), text="text").select("conv_id", "turn", "text")


# Post-training and metrics


@query(f"SELECT {_visible('query')} AS query, {_visible('answer')} AS answer FROM {_PAIRS} WHERE turn % 2 = 1 AND {_visible('query')} <> '' AND {_visible('answer')} <> ''")
def forum_best_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.when(F.col("turn") % 2 == 1, F.element_at(F.array(F.lit("1"), F.lit(" True"), F.lit("1.0")), (F.col("conv_id") % 3 + 1).cast("int"))).otherwise(F.lit("0"))
    return P.forum_answers(_pairs(spark, sf_dir).select(F.col("query").alias("title"), F.lit("").alias("question"), F.col("answer").alias("reply"), best.alias("is_best")))


@query(f"SELECT * FROM (SELECT {strip_sql('q')} AS law_title, CASE WHEN starts_with({strip_sql('a')}, {strip_sql('q')}) THEN {strip_sql(f'substr({strip_sql(chr(97))}, length({strip_sql(chr(113))}) + 1)')} ELSE {strip_sql('a')} END AS content FROM (SELECT query AS q, CASE WHEN turn % 2 = 1 THEN query || ' ' || answer ELSE answer END AS a FROM {_PAIRS} UNION ALL SELECT text, text FROM benchmark)) WHERE law_title <> '' AND content <> ''")
def article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).select(F.col("query").alias("input"), F.when(F.col("turn") % 2 == 1, F.concat("query", F.lit(" "), "answer")).otherwise(F.col("answer")).alias("answer"))
    return P.articles(rows.unionAll(table(spark, sf_dir, "benchmark").select("text", "text")))


@query("SELECT round(count_if(quality = toxic) / count(*), 9)::DOUBLE AS accuracy FROM labels WHERE quality IN (1)")
def accuracy_in_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    per_class = E.prf_matrix(labels, "quality", "toxic", [1])
    return E.summary(per_class, labels, "quality", "toxic", [1]).select(F.round("accuracy", 9).alias("accuracy"))


@query("SELECT upto, CAST(seen AS BIGINT) AS seen, round(k / seen, 9)::DOUBLE AS rate, k / seen > 0.3 AS warned FROM (SELECT max(position) AS upto, sum(count(*)) OVER w AS seen, sum(count_if(event_type = 'click')) OVER w AS k FROM (SELECT event_type, row_number() OVER (ORDER BY event_id) AS position FROM events) GROUP BY (position - 1) // 200 WINDOW w AS (ORDER BY (position - 1) // 200))")
def running_every_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_id")).first()[0]
    placed = e.withColumn("position", F.col("event_id") - F.lit(first) + 1)  # ids are gapless
    return E.running_every(placed, F.col("event_type") == "click", "position", 200).withColumn("rate", F.round("rate", 9))


@query("SELECT lang, sum(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS recall FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def recall_of_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL").withColumn("query_id", F.col("lang"))
    verdicts = docs.select("query_id", F.lit(1).alias("rank"), F.lit(1).alias("v")).distinct()
    claims = docs.select("query_id", (F.col("doc_id") % 3 == 0).cast("int").alias("attributed"))
    return R.context_metrics(verdicts, claims).select(F.col("query_id").alias("lang"), F.col("context_recall").alias("recall"))


# Readers and sinks, as round trips


def _folder(spark: SparkSession, name: str) -> str:
    return sinks.scratch_path(spark, name)


_ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


@query("SELECT item_id, text, 3 AS readers FROM benchmark")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written as JSONL and read strictly, leniently and most strictly: each reader finds the same rows."""
    path = _folder(spark, "jsonl")
    sinks.jsonl(table(spark, sf_dir, "benchmark").select("item_id", "text"), path)
    found = [f(spark, path, _ITEM) for f in (readers.jsonl, readers.jsonl_lenient, readers.jsonl_no_blanks)]
    return K.union_all(*found).groupBy("item_id", "text").agg(F.count(F.lit(1)).cast("int").alias("readers"))


@query("SELECT count(*) * 3 AS lines, count(*) AS bad, count(*) AS missing, count(*) AS good FROM benchmark")
def jsonl_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "lines")
    good = F.to_json(F.struct("item_id", "text"))
    table(spark, sf_dir, "benchmark").select(F.explode(F.array(good, F.to_json(F.struct("item_id")), F.concat(good, good))).alias("value")).write.text(path)
    return readers.jsonl_counted(spark, path, ["item_id", "text"])


@query("SELECT item_id, text, (SELECT count(*) FROM benchmark) * 3 AS lines, (SELECT count(*) FROM benchmark) AS bad, (SELECT count(*) FROM benchmark) AS missing FROM benchmark")
def jsonl_rows_and_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good rows and the counts of the others from one scan."""
    path, kept = _folder(spark, "lines"), _folder(spark, "good")
    good = F.to_json(F.struct("item_id", "text"))
    table(spark, sf_dir, "benchmark").select(F.explode(F.array(good, F.to_json(F.struct("item_id")), F.concat(good, good))).alias("value")).write.text(path)
    rows, seen = readers.jsonl_observed(spark, path, _ITEM, ["item_id", "text"])
    rows.write.parquet(kept)
    return spark.read.parquet(kept).select("item_id", "text", *[F.lit(seen.get[c]).cast("long").alias(c) for c in ("lines", "bad", "missing")])


@query("SELECT item_id, text FROM benchmark UNION ALL SELECT item_id, text FROM benchmark")
def json_array_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file, read in ranges of 4 kB, as an array and as one that may be wrapped."""
    path = _folder(spark, "array")
    sinks.json_document(table(spark, sf_dir, "benchmark").select("item_id", "text"), path, ["item_id"])
    return readers.json_array(spark, path, _ITEM, ["item_id"], 4096).select("item_id", "text").unionAll(readers.wrapped_array(spark, path, _ITEM, 4096))


@query("SELECT page_id, url, html FROM pages")
def wrapped_array_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object with other lists around the pages' array, whose texts are full of brackets, quotes and backslashes."""
    path = _folder(spark, "wrapped")
    page = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    around = ('{"examples": [1, "]"], "note": {"items": [{"no": "\\\\"}]}, "items":\n', "\n}")
    sinks.json_document(pages, path, ["page_id"], around)
    return readers.wrapped_array(spark, path, page, 1 << 16)


@query("SELECT page_id AS item_id, CASE WHEN page_id % 2 = 0 THEN 'say \"hi\", \"\"you\"' || chr(10) || html ELSE html END AS text FROM pages")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, which hold quotes, commas and line feeds."""
    path = _folder(spark, "csv")
    quoted = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('say "hi", ""you"\n'), "html")).otherwise(F.col("html"))
    table(spark, sf_dir, "pages").select(F.col("page_id").alias("item_id"), quoted.alias("text")).write.option("header", True).option("escape", '"').csv(path)
    return readers.csv(spark, path, _ITEM, ["item_id", "text"])


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT item_id, unnest({tokens_sql('text')}) AS term FROM benchmark) GROUP BY term")
def text_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "index")
    sinks.text_index(table(spark, sf_dir, "benchmark"), path, id_col="item_id")
    return sinks.open_text_index(spark, path).terms.select("term", "df")


@query("SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last, len(embedding)::INTEGER AS dims FROM embeddings")
def vector_index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.vector_index(table(spark, sf_dir, "embeddings"), _folder(spark, "vectors"), 64).select("vec_id", "label", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[63].cast("double").alias("last"), F.size("embedding").alias("dims"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS lang FROM documents")
def upsert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select("doc_id", "lang")
    changed = old.where("doc_id % 3 = 0").select("doc_id", F.explode(F.array(F.lit("old"), F.lit("new"))).alias("lang")).withColumn("seq", F.when(F.col("lang") == "new", 2).otherwise(1))
    return sinks.upsert(old, changed, "doc_id", "seq")


@query("SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'new' ELSE lang END AS lang FROM documents UNION ALL SELECT doc_id + 1000000, 'put in' FROM documents WHERE doc_id % 50 = 0")
def upsert_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in folders by key: changed and new rows replace their folders only."""
    path, docs = _folder(spark, "keyed"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    keyed.create(docs, path, "doc_id", 16)
    some = docs.where("doc_id % 50 = 0")
    changed = some.select("doc_id", F.explode(F.array(F.lit("old"), F.lit("new"))).alias("lang")).withColumn("seq", F.when(F.col("lang") == "new", 2).otherwise(1))
    added = some.select(F.col("doc_id") + 1_000_000, F.lit("put in").alias("lang"), F.lit(1).alias("seq"))
    keyed.upsert(changed.unionAll(added), path, "doc_id", "seq", buckets=16)
    return keyed.read(spark, path)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS run FROM documents")
def append_and_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id"), _folder(spark, "append")
    sinks.append_missing(docs.where("doc_id % 2 = 0"), path, "doc_id", lambda d: d.withColumn("run", F.lit("first")))
    return sinks.append_missing(docs, path, "doc_id", lambda d: d.withColumn("run", F.lit("second")))


@query("SELECT item_id, 10 AS topk, 'bm25' AS retriever FROM benchmark")
def results_by_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "parameters")
    sinks.by_parameters(table(spark, sf_dir, "benchmark").select("item_id"), path, topk=10, retriever="bm25")
    return sinks.cached(spark.read.parquet(path), _folder(spark, "cached"), topk=10)


# Streams


def _streamed(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """What a stateful query makes of the events, fed in three parts, each a batch of its own; the query is started anew for each."""
    source, out, progress = (_folder(spark, x) for x in ("stream-in", "stream-out", "stream-checkpoint"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    third = F.floor((F.col("event_id") - low) * 3 / (high - low + 1))
    for k in range(3):
        events.where(third == k).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        run = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(out)


@query("SELECT user_id, event_id, event_type FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def streamed_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user, from a stream with the users seen as its state."""
    return _streamed(spark, sf_dir, lambda s: state.first_of_keys(s, "user_id", "event_id")).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, count(*) OVER w AS seen, round(avg(CAST(event_type = 'click' AS DOUBLE)) OVER w, 9) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def streamed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running rate of clicks of each user, from a stream with the sums as its state."""
    found = _streamed(spark, sf_dir, lambda s: state.running_rates(s, F.col("event_type") == "click", "event_id", "user_id"))
    return found.select("user_id", "event_id", "seen", F.round("rate", 9).alias("rate"))


# Providers with plain stand-ins


class _Echo:
    def __init__(self, mark: str) -> None:
        self.mark = mark

    def __call__(self, prompts: list[str]) -> list[str]:
        return [f"{self.mark}|{p}" for p in prompts]


def _even(prompts: list[str]) -> list[str]:
    return ['{"better": "%s"}' % ("A" if len(p) % 2 == 0 else "b") for p in prompts]


def _by_length(pairs: list[tuple[str, str]]) -> list[float]:
    return [len(q) - len(t) for q, t in pairs]


@query(f"SELECT conv_id, turn, '0.2|' || query AS cand_a, '0.9|' || query AS cand_b, CASE WHEN (3 * length(query) + 10) % 2 = 0 THEN 'A' ELSE 'B' END AS verdict FROM {_PAIRS}")
def candidates_and_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).select("conv_id", "turn", F.col("query").alias("instruction"), F.lit("").alias("input"))
    two = M.candidates(rows, "instruction", lambda t: lambda: _Echo(str(t)))
    judged = M.pairwise_judge(two, "{instruction}{input}\n{cand_a}\n{cand_b}", lambda: _even)
    return judged.select("conv_id", "turn", "cand_a", "cand_b", "verdict")


class _Nth:
    """Answers with the word of the prompt at a place, as a model's JSON with text around it."""

    def __init__(self, place: int) -> None:
        self.place = place

    def __call__(self, prompts: list[str]) -> list[str]:
        words = [p.split(" ") for p in prompts]
        return ['Sure: {"instruction": "%s"}' % w[self.place] if len(w) > self.place and w[self.place].isalnum() else "no" for w in words]


_N_WORDS = 60


@query(
    f"""WITH w AS (SELECT item_id, string_split(text, ' ') AS l FROM benchmark),
r AS (SELECT item_id, k AS round, l[k + 1] AS word FROM (SELECT item_id, l, unnest(range(0, 100)) AS k FROM w) WHERE regexp_full_match(l[k + 1], '[\\p{{L}}\\p{{N}}]{{4,}}')),
f AS (SELECT word, min(round * 1000000000 + item_id) AS first FROM r GROUP BY word ORDER BY first LIMIT {_N_WORDS})
SELECT CAST(first // 1000000000 AS INTEGER) AS round, CAST(first % 1000000000 AS BIGINT) AS item_id, word AS instruction FROM f"""
)
def generated_until_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of generation over all items until there are 60 different valid results."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")

    def propose(k: int) -> DataFrame:
        raw = M.generate(items, "text", lambda: _Nth(k))
        return raw.select("item_id", J.json_field(J.json_object(F.col("output"), False), "instruction").alias("instruction")).where(F.length("instruction") >= 4)

    found = G.generate_until(spark, _folder(spark, "rounds"), _N_WORDS, propose, F.col("instruction"), "item_id")
    return found.select("round", "item_id", "instruction")


@query(f"SELECT conv_id, turn, CAST(length(query) - length(answer) AS DOUBLE) AS score FROM {_PAIRS}")
def cross_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.score_pairs(_pairs(spark, sf_dir), "query", "answer", lambda: _by_length).select("conv_id", "turn", "score")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS tokens FROM documents")
def counted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = M.token_counter(lambda: lambda texts: [len(t) for t in texts])
    return table(spark, sf_dir, "documents").select("doc_id", count(F.col("text")).alias("tokens"))


@query("SELECT item_id, 'x|' || text AS output FROM benchmark")
def generated_until_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.generate_valid(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text", lambda: _Echo("x"), lambda t: t.startswith("x|")).select("item_id", "output")


def _two_numbers(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@query("SELECT item_id, CAST(length(text) AS DOUBLE) AS length, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS es FROM benchmark")
def embedded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedding provider called in batches, each text with its own vector."""
    v = M.embed(lambda: _two_numbers, 7)(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", v.alias("v")).select("item_id", F.col("v")[0].cast("double").alias("length"), F.col("v")[1].cast("double").alias("es"))


_POOLED = "list_transform(range(1, 9), lambda j: (e[j] + e[16 + j] + e[48 + j]) / 3)"


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform(p, lambda x: x * x))), 6) AS norm, round(p[1] / sqrt(list_sum(list_transform(p, lambda x: x * x))), 6) AS first FROM (SELECT vec_id, {_POOLED} AS p FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))")
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector as eight token vectors of eight numbers, of which a mask keeps three: their mean, and its length and direction."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    pooled = table(spark, sf_dir, "embeddings").select("vec_id", M.mean_pool(tokens, F.array(*map(F.lit, (1, 0, 1, 0, 0, 0, 1, 0)))).alias("p"))
    norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, x: s + x * x))
    return pooled.select("vec_id", F.round(norm, 6).alias("norm"), F.round(M.l2_normalise(F.col("p"))[0], 6).alias("first"))


def _by_digits(prompts: list[str]) -> list[str]:
    return ["label: %d" % (len(p) % 2) if len(p) % 3 else "none" for p in prompts]


_JUDGED_LENGTH = "(length(query) + length(answer) + 9)"


@query(f"SELECT conv_id, turn, CASE WHEN {_JUDGED_LENGTH} % 3 > 0 THEN 'label: ' || ({_JUDGED_LENGTH} % 2) ELSE 'none' END AS judge_raw, CASE WHEN {_JUDGED_LENGTH} % 3 > 0 THEN CAST({_JUDGED_LENGTH} % 2 AS INTEGER) END AS judge_label FROM {_PAIRS}")
def judged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers judged 1, 0 or not at all, by a provider asked with a rendered template."""
    rows = _pairs(spark, sf_dir).withColumn("LLM_answer", F.lit("same"))
    return M.judge(rows, "{query}\n{answer}\n= {LLM_answer}?", lambda: _by_digits).select("conv_id", "turn", "judge_raw", "judge_label")


@query(
    f"SELECT 'law/g' || page_id % 7 || '/' || title || '（2020-01-02）.md' AS rel_path, title, 'g' || page_id % 7 AS law_group, left(sha1('law/g' || page_id % 7 || '/' || title || '（2020-01-02）.md'), 12) AS doc_id, md5('第一条 ' || coalesce(html, '')) AS text_md5,"
    " sha1(encode('第一条 ' || coalesce(html, '')) || '\\xFF'::BLOB) AS file_sha1 FROM (SELECT *, '法' || page_id AS title FROM pages)"
)
def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of Markdown files, one for each page, with a byte that is no UTF-8, beside hidden and other files."""
    root = _folder(spark, "tree")
    group, title = F.concat(F.lit("g"), (F.col("page_id") % 7).cast("string")), F.concat(F.lit("法"), F.col("page_id").cast("string"))
    content = F.concat(F.encode(F.concat(F.lit("第一条 "), F.coalesce("html", F.lit(""))), "utf-8"), F.unhex(F.lit("FF")))
    pages = table(spark, sf_dir, "pages").select(group.alias("g"), title.alias("t"), content.alias("content"))
    sinks.files(pages.select(F.concat(F.lit("nested/law/"), "g", F.lit("/"), "t", F.lit("（2020-01-02）.md")).alias("path"), "content"), root)
    sinks.files(pages.limit(3).select(F.concat(F.lit("nested/law/.git/"), "t", F.lit(".md")).alias("path"), "content"), root)
    sinks.files(pages.limit(3).select(F.concat(F.lit("nested/law/"), "t", F.lit(".txt")).alias("path"), "content"), root)
    found = readers.markdown_tree(spark, readers.nested_root(spark, root, "nested"))
    return found.select("rel_path", "title", "law_group", "doc_id", F.md5("text").alias("text_md5"), "file_sha1")


@query("SELECT event_type, event_id, event_type || '_' || (event_id // 100) || '.jsonl' AS file_name FROM events WHERE event_type IN ('click', 'view') AND event_id % 10 <> 0")
def labelled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named by label, of which rows with another label, broken lines and files of other labels are left out."""
    folder = _folder(spark, "labelled")
    label = F.when(F.col("event_id") % 10 == 0, F.lit("other")).otherwise(F.col("event_type"))
    line = F.to_json(F.struct(label.alias("event_type"), "event_id"))
    lines = table(spark, sf_dir, "events").select("event_type", F.floor(F.col("event_id") / 100).alias("part"), "event_id", F.when(F.col("event_id") % 20 == 0, F.concat(line, line)).otherwise(line).alias("line"))
    whole = lines.groupBy("event_type", "part").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("content"))  # a hundred lines at most
    sinks.files(whole.select(F.concat("event_type", F.lit("_"), F.col("part").cast("string"), F.lit(".jsonl")).alias("path"), "content"), folder)
    schema = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("event_id", T.LongType())])
    return readers.partitioned_jsonl(spark, folder, {"click": "click", "view": "view"}, schema, "event_type")


@query("SELECT count(*) AS rows FROM benchmark")
def checked_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose columns and number of rows are checked where it is used."""
    items = K.require_columns(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return K.require_count(items, items.count()).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT item_id, 'Ask: ' || text || chr(10) || '{{kept}} and {other}' AS prompt FROM benchmark")
def prompts_of_a_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template read from a file, its place checked and filled."""
    folder = _folder(spark, "template")
    sinks.files(spark.createDataFrame([("ask.txt", "Ask: {text}\n{{{{kept}}}} and {other}")], "path string, content string").select("path", F.encode("content", "utf-8").alias("content")), folder)
    template = readers.template(spark, f"{folder}/ask.txt", ["{text}"])
    return table(spark, sf_dir, "benchmark").select("item_id", X.render(template, {"text": F.col("text")}).alias("prompt"))


class _Failing:
    """Fails for every prompt once, and for some always."""

    def __init__(self) -> None:
        self.asked: set[str] = set()

    def __call__(self, prompts: list[str]) -> list[str]:
        return [x for x in self.each(prompts) if isinstance(x, str)]

    def each(self, prompts: list[str]) -> list[str | Exception]:
        first = [p for p in prompts if p not in self.asked]
        self.asked.update(first)
        return [ValueError(f"{len(p)} characters") if p in first or len(p) % 5 == 0 else f"<{p}>" for p in prompts]


@query("SELECT item_id, CASE WHEN length(text) % 5 = 0 THEN '' ELSE '<' || text || '>' END AS output, CASE WHEN length(text) % 5 = 0 THEN 'ValueError: ' || length(text) || ' characters' END AS error FROM benchmark")
def retried_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts asked in batches of three at a rate for the whole job, each again until it is answered or given up."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return M.generate(items, "text", _Failing, batch=3, retry=M.Retry(3, 0.0), pace=M.Pace(1000, 4)).select("item_id", "output", "error")


@query("SELECT count(*) AS rows, count_if(length(text) % 5 = 0)::BIGINT AS errors, count(*) AS timed FROM benchmark")
def progress_of_a_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and errors as an observation saw them while the rows were written, and as the timed run counted them."""
    path = _folder(spark, "progress")
    seen, told = M.progress(retried_prompts(spark, sf_dir), "error", f"progress-{path[-8:]}")

    def run() -> int:
        seen.write.parquet(path)
        return spark.read.parquet(path).count()

    timed = M.throughput(run)
    return spark.createDataFrame([(told.get["rows"], told.get["errors"], timed["rows"])], "rows long, errors long, timed long")


def _tokenizer() -> str | None:
    """A public tokenizer's file, where the machine has one."""
    try:
        import public_tokenizers
    except ImportError:
        return None
    return public_tokenizers.path("byte_bpe_50k.json")


if _tokenizer():

    @query()
    def tokenizer_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Token counts of prompts and answers by a tokenizer, and their summary for each field."""
        count = M.tokenizer_counts(_tokenizer())
        rows = _pairs(spark, sf_dir).select("conv_id", "turn", F.col("query").alias("instruction"), F.lit("Be brief.").alias("input"), F.col("answer").alias("chosen"), F.col("query").alias("rejected"))
        counted = P.token_counts(rows, count)
        fields = ("prompt_tokens", "chosen_tokens", "rejected_tokens", "prompt_chosen_tokens", "prompt_rejected_tokens")
        long = counted.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])).alias("x")).select("x.*")
        return E.length_summary(long, "n", "field")
