"""Queries of corpus building, segmentation and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import ChunkConfig
from quarry.functions import text as X
from quarry.operators import chunk as C
from quarry.operators import corpus as K
from quarry.plans.base import WS, query, strip_sql, table, values_sql

# Noise that the documents lack, put in front of each of them.
NOISE = "# Head\r\n  Back to top \r\nRaw\n```py\nx = 1\n```\nsee [the page](http://example.org/a)\t  now\n\n\n\nbody: "
_NOISE_SQL = "'# Head' || chr(13) || chr(10) || '  Back to top ' || chr(13) || chr(10) || 'Raw' || chr(10) || '```py' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || 'see [the page](http://example.org/a)' || chr(9) || '  now' || chr(10) || chr(10) || chr(10) || chr(10) || 'body: '"


def clean_sql(t: str) -> str:
    t = f"regexp_replace({t}, '\\r\\n?', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?s)```.*?```', '', 'g')"
    t = f"regexp_replace({t}, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')"
    t = strip_sql(f"array_to_string(list_filter(string_split({t}, chr(10)), lambda x: NOT regexp_full_match(x, '[\\s\\x0b]*(?:Back to top|Raw)[\\s\\x0b]*')), chr(10))")
    return strip_sql(f"regexp_replace(regexp_replace({t}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


_CLEANED = f"(SELECT doc_id, {clean_sql('text')} AS t FROM documents)"


@query(f"SELECT doc_id, {clean_sql('(' + _NOISE_SQL + ' || text)')} AS text FROM documents")
def corpus_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_markdown(F.concat(F.lit(NOISE), F.col("text"))).alias("text"))


@query(f"SELECT doc_id, CAST(length(t) AS BIGINT) AS text_len, h AS text_hash FROM (SELECT doc_id, t, h, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS rn FROM (SELECT doc_id, t, left(sha1(t), 16) AS h FROM {_CLEANED} WHERE length(t) >= 20)) WHERE rn = 1")
def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.build(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("text_len").cast("long").alias("text_len"), "text_hash")


@query(
    f"SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS input_docs, CAST(count(*) AS BIGINT) AS output_docs, CAST((SELECT count(*) FROM {_CLEANED} WHERE length(t) < 20) AS BIGINT) AS skipped_too_short,"
    f" CAST((SELECT count(*) FROM {_CLEANED} WHERE length(t) >= 20) - count(*) AS BIGINT) AS deduped_by_text_hash, CAST(coalesce(min(n), 0) AS BIGINT) AS min_len, CAST(coalesce(max(n), 0) AS BIGINT) AS max_len, CAST(coalesce(round(avg(n), 2), 0) AS DOUBLE) AS avg_len"
    f" FROM (SELECT left(sha1(t), 16) AS h, max(length(t)) AS n FROM {_CLEANED} WHERE length(t) >= 20 GROUP BY 1)"
)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = K.stats(table(spark, sf_dir, "documents"))
    return s.select(*[F.col(c).cast("double" if c == "avg_len" else "long").alias(c) for c in s.columns])


_PATHS = [("/data/law/民法/某法（2009-08-27）.md",), ("/data/law/刑法/某法(2009-08-27).MD",), ("/data/law/单独.md",), ("C:\\x\\y.md",)]


@query(
    f"""SELECT rel_path, {strip_sql(r"regexp_replace(regexp_replace(list_extract(string_split(rel_path, '/'), -1), '(?i)\.md$', ''), '[(（]\d{4}-\d{2}-\d{2}[)）]', '', 'g')")} AS title,
    coalesce(list_extract(string_split(rel_path, '/'), 2), 'unknown') AS law_group, left(sha1(rel_path), 12) AS doc_id
    FROM (SELECT CASE WHEN starts_with(p, '/data/') THEN substr(p, 7) ELSE p END AS rel_path FROM (SELECT replace(path, '\\', '/') AS p FROM {values_sql(["path"], _PATHS)} UNION ALL SELECT url FROM pages))"""
)
def path_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = spark.createDataFrame(_PATHS, "path string").unionAll(table(spark, sf_dir, "pages").select("url"))
    return K.path_columns(paths, "path", "/data").select("rel_path", "title", "law_group", "doc_id")


_ARTICLES = [(1, "某法", "前言第一条 甲。第二条 乙依照第一条处理"), (2, "", "第三十二条　丙"), (3, None, "没有条文"), (4, "他法", "第〇条"), (5, "他法", " 　\n")]
_SPLIT_SQL = f"list_filter(list_transform(string_split(regexp_replace(t, '({X.ARTICLE})', chr(1) || '\\1', 'g'), chr(1)), lambda x: {strip_sql('x')}), lambda x: x <> '')"


@query(
    f"SELECT id, CAST(i - 1 AS INTEGER) AS piece_idx, p[i] AS piece, coalesce(nullif(concat_ws(' ', nullif(coalesce(title, ''), ''), nullif(regexp_extract(p[i], '^({X.ARTICLE})', 1), '')), ''), 'unknown') AS source"
    f" FROM (SELECT id, title, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT id, title, {_SPLIT_SQL} AS p FROM (SELECT * FROM {values_sql(['id', 'title', 't'], _ARTICLES)} UNION ALL SELECT 1000 + doc_id, source, replace(text, ' d', ' 第二十条 d') FROM documents)))"
)
def article_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed cases, and all documents with article heads put in."""
    docs = table(spark, sf_dir, "documents").select(1000 + F.col("doc_id"), "source", F.replace("text", F.lit(" d"), F.lit(" 第二十条 d")))
    rows = spark.createDataFrame(_ARTICLES, "id long, title string, t string").unionAll(docs)
    return rows.select("id", "title", F.posexplode(C.split_articles(F.col("t"))).alias("piece_idx", "piece")).select("id", "piece_idx", "piece", X.article_source(F.col("title"), F.col("piece")).alias("source"))


@query(
    f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS piece_idx, printf('%d_p%04d_c%03d_%s', doc_id, i - 1, 0, left(sha1(p), 10)) AS chunk_id, CAST(length(p) AS BIGINT) AS text_len FROM"
    f" (SELECT doc_id, i, {strip_sql('l[i]')} AS p FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) WHERE length(p) >= 10"
)
def newline_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("piece_idx", "p")).withColumn("p", X.strip(F.col("p"))).where(F.length("p") >= 10)
    return rows.select("doc_id", "piece_idx", X.chunk_id(F.col("doc_id").cast("string"), F.col("piece_idx"), F.lit(0), F.col("p")).alias("chunk_id"), F.length("p").cast("long").alias("text_len"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("某法").alias("title"), F.col("source").alias("law_group"), F.concat(F.lit("law/"), "source").alias("rel_path"), F.concat(F.lit("第一条 "), "text", F.lit(" 第二条 末")).alias("text"))


def _cut_sql(cfg: ChunkConfig) -> str:
    """CTEs done0, done1, ... (doc_id, piece_idx, path, t): the chunks that each separator leaves, and the long parts for the next one.

    Parts between long ones make a run with the places where they end; a window goes from place s to the last place e
    that is near enough, and the next one begins as far back as the overlap and its first new part allow.
    """
    out, source = [], f"SELECT doc_id, piece_idx, CAST([] AS BIGINT[]) AS path, piece AS t FROM pieces WHERE length(piece) >= {cfg.size}"
    for k, sep in enumerate(cfg.separators):
        lit = " || ".join(["chr(10)"] * len(sep)) if sep.strip("\n") == "" and sep else f"'{sep}'"
        parts = f"list_filter(list_transform(string_split(t, {lit}), lambda x, i: CASE WHEN i = 1 THEN x ELSE {lit} || x END), lambda x: x <> '')"
        out += [
            f"in{k} AS MATERIALIZED ({source})",
            f"p{k} AS MATERIALIZED (SELECT doc_id, piece_idx, path, i, x, length(x) AS n, length(x) >= {cfg.size} AS long FROM (SELECT doc_id, piece_idx, path, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT *, {parts} AS l FROM in{k})))",
            f"q{k} AS (SELECT *, sum(CAST(long AS INTEGER)) OVER (PARTITION BY doc_id, piece_idx, path ORDER BY i) AS run, sum(n) OVER (PARTITION BY doc_id, piece_idx, path ORDER BY i) AS upto FROM p{k})",
            f"r{k} AS MATERIALIZED (SELECT doc_id, piece_idx, path, CAST(run AS BIGINT) AS run, list(x ORDER BY i) AS parts, list_prepend(min(upto - n), list(upto ORDER BY i)) AS ends FROM q{k} WHERE NOT long GROUP BY ALL)",
            f"w{k} AS (SELECT doc_id, piece_idx, path, run, parts, ends, 0 AS place, 0 AS s, CAST(len(list_filter(ends, lambda x: x <= ends[1] + {cfg.size})) - 1 AS INTEGER) AS e FROM r{k}"
            f" UNION ALL SELECT doc_id, piece_idx, path, run, parts, ends, place + 1, s, CAST(len(list_filter(ends, lambda x: x <= ends[s + 1] + {cfg.size})) - 1 AS INTEGER) FROM"
            f" (SELECT doc_id, piece_idx, path, run, parts, ends, place, e, CAST(greatest(s, least(e, len(list_filter(ends, lambda x: x < greatest(ends[e + 1] - {cfg.overlap}, ends[e + 2] - {cfg.size}))))) AS INTEGER) AS s FROM w{k} WHERE e < len(parts)))",
            f"done{k} AS (SELECT doc_id, piece_idx, path || [2 * run, place] AS path, array_to_string(parts[s + 1 : e], '') AS t FROM w{k})",
        ]
        source = f"SELECT doc_id, piece_idx, path || [CAST(2 * run - 1 AS BIGINT)] AS path, x AS t FROM q{k} WHERE long"
    return ", ".join(out)


_CFG = ChunkConfig()
_CHUNKS_SQL = f"""WITH RECURSIVE pieces AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS law_group, CAST(i - 1 AS INTEGER) AS piece_idx, p[i] AS piece FROM
 (SELECT doc_id, source, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT doc_id, source, {_SPLIT_SQL} AS p FROM (SELECT doc_id, source, '第一条 ' || text || ' 第二条 末' AS t FROM documents)))),
{_cut_sql(_CFG)},
every AS (SELECT doc_id, piece_idx, CAST([] AS BIGINT[]) AS path, piece AS t FROM pieces WHERE length(piece) < {_CFG.size} {' '.join(f'UNION ALL SELECT * FROM done{k}' for k in range(len(_CFG.separators)))}),
numbered AS (SELECT doc_id, piece_idx, t, CAST(row_number() OVER (PARTITION BY doc_id, piece_idx ORDER BY path) - 1 AS INTEGER) AS chunk_idx FROM (SELECT doc_id, piece_idx, path, {strip_sql('t')} AS t FROM every) WHERE t <> '')
SELECT printf('%s_p%04d_c%03d_%s', doc_id, piece_idx, chunk_idx, left(sha1(t), 10)) AS chunk_id, doc_id, '某法' AS title, law_group, 'law/' || law_group AS rel_path,
 concat_ws(' ', '某法', nullif(regexp_extract(piece, '^({X.ARTICLE})', 1), '')) AS source, piece_idx, chunk_idx, t AS text, CAST(length(t) AS INTEGER) AS text_len, length(t) >= {_CFG.least} AS kept
FROM numbered JOIN pieces USING (doc_id, piece_idx)"""


@query(_CHUNKS_SQL)
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk(_corpus(spark, sf_dir))


@query(
    f"SELECT {_CFG.size} AS chunk_size, {_CFG.overlap} AS chunk_overlap, true AS split_by_article, {_CFG.least} AS min_chunk_len, (SELECT count(*) FROM documents) AS input_docs, count_if(chunk_idx = 0)::BIGINT AS article_pieces,"
    f" count_if(kept)::BIGINT AS output_chunks, count_if(NOT kept)::BIGINT AS filtered_too_short FROM ({_CHUNKS_SQL})"
)
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_stats(_corpus(spark, sf_dir))


_WHOLE = ChunkConfig(size=1_000_000_000, least=10)


@query(
    f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS piece_idx, CAST(length(p[i]) AS BIGINT) AS text_len, left(sha1(p[i]), 10) AS h FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT doc_id, {_SPLIT_SQL} AS p FROM (SELECT doc_id, '第一条 ' || text || ' 第二条 末' AS t FROM documents)))"
)
def chunk_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.chunk(_corpus(spark, sf_dir), _WHOLE)
    return c.select(F.col("doc_id").cast("long").alias("doc_id"), "piece_idx", F.col("text_len").cast("long").alias("text_len"), F.right("chunk_id", F.lit(10)).alias("h"))


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.ordered_distinct(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE user_id IS NOT NULL) WHERE rn = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return K.upsert_latest(e, "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.resume(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT md5('42|' || k) AS h, k, text FROM (SELECT 'd' || doc_id AS k, text FROM documents UNION ALL SELECT 'b' || item_id, text FROM benchmark)")
def merge_union_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.operators.sampling import shuffle_key, shuffled

    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("k"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("k"), "text")
    return shuffled(K.union_all(d, b), "k").select(shuffle_key("k").alias("h"), "k", "text")


_TAGS = [("BAAI/bge-reranker-large", "/out/answer_qwen2.5_7b.json"), ("a b/c d!e", "x.json"), ("m/", "answer_.json"), ("_x_", "answer_a.b.json")]


@query(
    f"""SELECT model, coalesce(nullif(regexp_replace({strip_sql("list_extract(string_split(model, '/'), -1)")}, '[^a-zA-Z0-9._-]+', '_', 'g'), ''), 'reranker') AS tag,
    coalesce(nullif(regexp_replace(regexp_replace(model, '[^a-zA-Z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'tag') AS whole_tag,
    regexp_replace(regexp_replace(list_extract(string_split(file, '/'), -1), '(.)\\.[^.]+$', '\\1'), '^answer_(.)', '\\1') AS pred_tag FROM (SELECT * FROM {values_sql(["model", "file"], _TAGS)} UNION ALL SELECT url, 'out/answer_' || url || '.json' FROM pages UNION ALL SELECT left(text, 40), 'answer_' || doc_id FROM documents WHERE text IS NOT NULL)"""
)
def safe_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed cases, and tags of all pages' addresses and documents' beginnings."""
    pages = table(spark, sf_dir, "pages").select("url", F.concat(F.lit("out/answer_"), "url", F.lit(".json")))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.left("text", F.lit(40)), F.concat(F.lit("answer_"), F.col("doc_id").cast("string")))
    rows = spark.createDataFrame(_TAGS, "model string, file string").unionAll(pages).unionAll(docs)
    m = F.col("model")
    return rows.select("model", X.safe_tag(m, "reranker").alias("tag"), X.safe_tag(m, "tag", False, True).alias("whole_tag"), X.prediction_tag(F.col("file")).alias("pred_tag"))


_PREFIXES = [("某法第一条", "某法第一条 内容 "), ("某法", "其他内容"), ("", "x"), ("甲", "甲")]


@query(f"SELECT title, CASE WHEN starts_with(answer, title) THEN {strip_sql('substr(answer, length(title) + 1)')} ELSE answer END AS content FROM (SELECT * FROM {values_sql(['title', 'answer'], _PREFIXES)} UNION ALL SELECT CASE WHEN doc_id % 2 = 0 THEN left(text, 12) ELSE lang END, text FROM documents)")
def prefix_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.left("text", F.lit(12))).otherwise(F.col("lang")), "text")
    return spark.createDataFrame(_PREFIXES, "title string, answer string").unionAll(docs).select("title", X.without_prefix(F.col("answer"), F.col("title")).alias("content"))


_SPACES = [(1, "　 x \n"), (2, "​a﻿ "), (3, None), (4, " \t"), (5, " 中  文 ")]


_VISIBLE = strip_sql("regexp_replace(coalesce(t, ''), '[​﻿]', '', 'g')")


@query(f"SELECT id, {strip_sql('t')} AS stripped, {_VISIBLE} AS visible, regexp_replace(t, '{WS}+', ' ', 'g') AS squeezed FROM (SELECT * FROM {values_sql(['id', 't'], _SPACES)} UNION ALL SELECT 1000 + doc_id, '　 ' || replace(text, '. ', '.　​ ') || chr(10) FROM documents)")
def whitespace_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed cases, and all documents with wide and invisible spaces put in."""
    t = F.col("t")
    docs = table(spark, sf_dir, "documents").select(1000 + F.col("doc_id"), F.concat(F.lit("　 "), F.replace("text", F.lit(". "), F.lit(".　​ ")), F.lit("\n")))
    return spark.createDataFrame(_SPACES, "id long, t string").unionAll(docs).select("id", X.strip(t).alias("stripped"), X.remove_invisible(t).alias("visible"), X.squeeze(t).alias("squeezed"))
