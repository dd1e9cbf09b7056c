"""Queries of retrieval, fusion, reranking and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import RetrievalConfig
from quarry.functions import providers as M
from quarry.functions import text as X
from quarry.operators import retrieve as R
from quarry.plans.base import query, strip_sql, table, values_sql
from quarry.operators import vectors as V
from quarry.sources import sinks


def tokens_sql(t: str) -> str:
    return f"list_filter(string_split(regexp_replace(regexp_replace(lower({t}), '(\\p{{Han}})', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"


def bm25_sql(k1: float, b: float, k: int) -> str:
    return f"""(
WITH tk AS (SELECT doc_id, toks, len(toks) AS dl FROM (SELECT doc_id, {tokens_sql('text')} AS toks FROM documents) WHERE len(toks) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM tk),
po AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(toks) AS term FROM tk) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(qtf * ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf / (tf + {k1}::DOUBLE * (1.0::DOUBLE - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl)))), 6) AS score
  FROM qt JOIN po USING (term) JOIN df USING (term), st GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= {k})"""


_BM25 = bm25_sql(1.2, 0.75, 10)
# Vectors stand for the documents and items of equal id.
_DENSE = """(SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
 (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings AS q JOIN benchmark ON item_id = q.vec_id JOIN embeddings AS v ON q.vec_id <> v.vec_id) QUALIFY rank <= 10)"""
_LISTS = f"""(SELECT query_id, 'bm25' AS src, 0 AS src_order, rank, text FROM {_BM25} JOIN documents USING (doc_id)
UNION ALL SELECT query_id, 'dense', 1, rank, text FROM {_DENSE} JOIN documents USING (doc_id))"""


def _bm25(spark: SparkSession, sf_dir: str, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    return R.bm25(R.Corpus(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), cfg, "item_id")


def _dense(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): neighbours of the items' vectors; a vector stands for the document or item of its id."""
    vectors, items = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    return R.knn(vectors, vectors.join(F.broadcast(items) if R.small(items) else items, "vec_id", "left_semi"), k).withColumnRenamed("vec_id", "doc_id")


def _with_text(ranked: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """ranked (twenty rows a query at most) with the documents' texts; few of them go to the documents, whose texts aren't shuffled then."""
    few = R.small(table(spark, sf_dir, "benchmark"), R.SMALL // 20)
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(ranked) if few else ranked, "doc_id")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The BM25 and the dense ranking of each query; texts are looked up last, once for both."""
    both = [_bm25(spark, sf_dir), _dense(spark, sf_dir)]
    rows = [x.select("query_id", "doc_id", "rank", F.lit(name).alias("src"), F.lit(i).alias("src_order")) for i, (name, x) in enumerate(zip(("bm25", "dense"), both, strict=True))]
    return _with_text(rows[0].unionAll(rows[1]), spark, sf_dir).select("query_id", "src", "src_order", "rank", "text")


@query(f"SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM {_BM25}")
def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir)


@query(f"SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM {_BM25}")
def bm25_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written once, opened again and searched: only the folders of the items' terms are read."""
    path = sinks.scratch_path(spark, "text-index")
    sinks.text_index(table(spark, sf_dir, "documents"), path)
    return R.bm25(sinks.open_text_index(spark, path), table(spark, sf_dir, "benchmark"), id_col="item_id")


@query(f"SELECT 'bge_large' AS retriever, query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM {_DENSE} UNION ALL SELECT 'bm25', query_id, doc_id, score, CAST(rank AS INTEGER) FROM {_BM25}")
def retriever_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    backends = {"bm25": lambda q, k: R.bm25(R.Corpus(table(spark, sf_dir, "documents")), q, id_col="item_id", k=k), "dense": lambda q, k: _dense(spark, sf_dir, k)}
    return R.retrieve("bge_large", items, backends).unionAll(R.retrieve("bm25", items, backends))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 25 = 0)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"""
)
def knn_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return R.knn(v, v.where("vec_id % 25 = 0"))  # the query set, against all vectors


def _ivf(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Neighbours by the inverted file, and exact ones, of every vector whose id is divisible by 100."""
    v, path = table(spark, sf_dir, "embeddings"), sinks.scratch_path(spark, "vector-index")
    queries = v.where("vec_id % 100 = 0")
    V.ivf_index(v, path)
    return V.ivf_search(spark, path, queries), V.knn(v, queries)


@query()
def ivf_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ivf(spark, sf_dir)[0]


@query("SELECT count(*) AS queries, sum(least(10, n - 1))::BIGINT AS neighbours, true AS enough FROM (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0), (SELECT count(*) AS n FROM embeddings)")
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the inverted file finds at least nine tenths of the exact ten neighbours."""
    return V.recall(*_ivf(spark, sf_dir)).select("queries", "neighbours", (F.col("recall") >= 0.9).alias("enough"))


_KEYED = f"(SELECT *, {strip_sql('text')} AS key FROM {_LISTS})"
_MERGED = f"(SELECT query_id, src_order, rank, text FROM {_KEYED} WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY src_order, rank) = 1)"


@query(f"SELECT query_id, md5(text) AS h, CAST(row_number() OVER (PARTITION BY query_id ORDER BY src_order, rank) AS INTEGER) AS position FROM {_MERGED}")
def hybrid_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_concat(_lists(spark, sf_dir)).select("query_id", F.md5("text").alias("h"), "position")


@query(
    f"SELECT query_id, count_if(src_order = 0)::BIGINT AS first_count, count_if(src_order = 1)::BIGINT AS second_count, count(*) AS merged_raw_count, count(DISTINCT nullif(key, '')) AS merged_final_count,"
    f" count(nullif(key, '')) - count(DISTINCT nullif(key, '')) AS dedup_removed, true AS dedup_enabled FROM {_KEYED} GROUP BY query_id"
)
def hybrid_merge_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_info(_lists(spark, sf_dir))


_RRF = f"""(SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(src_order * 1000 + rank) AS first,
  max(rank) FILTER (src = 'bm25') AS r1, max(rank) FILTER (src = 'dense') AS r2 FROM {_KEYED} WHERE key <> '' GROUP BY query_id, key)"""


@query(f"SELECT query_id, md5(key) AS h, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INTEGER) AS rank FROM {_RRF} QUALIFY rank <= 20")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rrf(_lists(spark, sf_dir)).select("query_id", F.md5(X.strip(F.col("text"))).alias("h"), "score", "rank")


@query(f"SELECT query_id, score, CAST(r1 AS INTEGER) AS bm25_rank, CAST(r2 AS INTEGER) AS dense_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INTEGER) AS rank FROM {_RRF} QUALIFY rank <= 5")
def rrf_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.rrf(_lists(spark, sf_dir), k=5)
    return top.select("query_id", "score", F.col("ranks")["bm25"].alias("bm25_rank"), F.col("ranks")["dense"].alias("dense_rank"), "rank")


# Two rankings of each item's first words, with a blank, a repeat and spaces around: (source, order, rank, word, before, after)
_FUSION = [("bm25", 0, 1, 1, "", ""), ("bm25", 0, 2, 2, "", ""), ("bm25", 0, 3, 0, " ", ""), ("bm25", 0, 4, 3, " ", "　"), ("dense", 1, 1, 3, "", ""), ("dense", 1, 2, 1, "", ""), ("dense", 1, 3, 2, "", "\n"), ("dense", 1, 4, 2, "", "")]
_FUSED_ROWS = f"(SELECT item_id AS query_id, src, src_order, rank, before || CASE WHEN word = 0 THEN '' ELSE string_split(text, ' ')[word] END || after AS text FROM benchmark, {values_sql(['src', 'src_order', 'rank', 'word', 'before', 'after'], _FUSION)})"


@query(
    f"SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 9) DESC, min(src_order * 1000 + rank)) AS INTEGER) AS rank"
    f" FROM (SELECT *, {strip_sql('text')} AS key FROM {_FUSED_ROWS}) WHERE key <> '' GROUP BY query_id, key"
)
def rrf_blanks_and_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("src", "src_order", "rank", "word", "before", "after"), r, strict=True)]) for r in _FUSION])
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.split("text", " ").alias("l"), F.explode(places).alias("p")).select("query_id", "l", "p.*")
    word = F.when(F.col("word") == 0, F.lit("")).otherwise(F.get("l", F.col("word") - 1))
    return R.rrf(rows.withColumn("text", F.concat("before", word, "after"))).select("query_id", X.strip(F.col("text")).alias("key"), "score", "rank")


_COVER = f"round(CAST(len(list_intersect(list_distinct({tokens_sql('q')}), {tokens_sql('d')})) AS DOUBLE) / len(list_distinct({tokens_sql('q')})), 6)"


@query(
    f"SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS INTEGER) AS rank FROM (SELECT query_id, doc_id, old, {_COVER} AS score FROM"
    f" (SELECT query_id, r.doc_id, r.rank AS old, b.text AS q, d.text AS d FROM {_BM25} AS r JOIN documents AS d USING (doc_id) JOIN benchmark AS b ON b.item_id = r.query_id)) QUALIFY rank <= 5"
)
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    rows = _with_text(_bm25(spark, sf_dir), spark, sf_dir).drop("score").join(items, "query_id")
    return R.rerank(rows, M.coverage(F.col("q"), F.col("text")), 5).select("query_id", "doc_id", "score", "rank")


@query(
    f"SELECT query_id, md5(array_to_string(l, chr(10))) AS h, CAST(len(l) AS INTEGER) AS n FROM (SELECT query_id, list(CAST(rank AS VARCHAR) || '. ' || {strip_sql('text')} ORDER BY rank) AS l FROM {_BM25} JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id)"
)
def contexts_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.contexts(_with_text(_bm25(spark, sf_dir), spark, sf_dir), 5)
    return c.select("query_id", F.md5(X.number_contexts(F.col("contexts"))).alias("h"), F.size("contexts").alias("n"))


@query(
    f"""WITH r AS (SELECT query_id, rank, CAST(contains(d.text, b.text) AS INTEGER) AS v FROM {_BM25} JOIN documents AS d USING (doc_id) JOIN benchmark AS b ON b.item_id = query_id),
p AS (SELECT query_id, v, sum(v) OVER (PARTITION BY query_id ORDER BY rank) / CAST(rank AS DOUBLE) AS prec FROM r)
SELECT query_id, round(coalesce(sum(prec * v) / nullif(sum(v), 0), 0), 6) AS context_precision, CAST(max(v) AS DOUBLE) AS context_recall FROM p GROUP BY query_id"""
)
def ir_recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("gold"))
    rows = _with_text(_bm25(spark, sf_dir), spark, sf_dir).join(items, "query_id")
    verdicts = rows.select("query_id", "rank", F.contains("text", "gold").cast("int").alias("v"))
    m = R.context_metrics(verdicts)
    return m.select("query_id", F.round("context_precision", 6).alias("context_precision"), "context_recall")


_WORDS = f"(SELECT query_id, rank, {tokens_sql('d.text')} AS toks FROM {_BM25} JOIN documents AS d USING (doc_id))"
_CLAIMS = f"""(SELECT query_id, claim, toks, len(toks) AS n, least(len(toks), 3) AS m FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS claim, toks FROM
 (SELECT query_id, i, {tokens_sql('s')} AS toks FROM (SELECT item_id AS query_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT item_id, string_split_regex(regexp_replace(text, '([.!?。！？])', '\\1' || chr(10), 'g'), '[\\r\\n]+') AS l FROM benchmark))) WHERE len(toks) > 0))"""
_ATTRIBUTED = f"""WITH c AS MATERIALIZED (SELECT * FROM {_CLAIMS}),
w AS MATERIALIZED (SELECT * FROM {_WORDS}),
g AS (SELECT query_id, claim, n, m, i, list_aggregate(toks[i : i + m - 1], 'string_agg', ' ') AS gram FROM (SELECT *, unnest(range(1, CAST(n - m + 2 AS BIGINT))) AS i FROM c)),
h AS (SELECT query_id, rank, m, i, list_aggregate(toks[i : i + m - 1], 'string_agg', ' ') AS gram FROM (SELECT *, unnest(range(1, CAST(len(toks) - m + 2 AS BIGINT))) AS i FROM w, (VALUES (1), (2), (3)) AS s(m) WHERE len(toks) >= m)),
d AS (SELECT g.query_id, claim, rank, h.i - g.i AS diagonal, g.i, g.m, g.i - row_number() OVER (PARTITION BY g.query_id, claim, rank, h.i - g.i ORDER BY g.i) AS island FROM g JOIN h ON h.query_id = g.query_id AND h.m = g.m AND h.gram = g.gram),
r AS (SELECT query_id, claim, max(words) AS longest FROM (SELECT query_id, claim, count(*) + any_value(m) - 1 AS words FROM d GROUP BY query_id, claim, rank, diagonal, island) GROUP BY ALL),
a AS (SELECT query_id, claim, n, coalesce(longest, 0) AS longest FROM c LEFT JOIN r USING (query_id, claim))
SELECT query_id, CAST(claim AS INTEGER) AS claim, CAST(n AS INTEGER) AS n_words, CAST(longest AS BIGINT) AS longest, CAST(longest >= ceil(n * 0.6::DOUBLE) AS INTEGER) AS attributed FROM a"""


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of each item, sought in the ten documents that BM25 finds for it."""
    claims = R.claims_of(table(spark, sf_dir, "benchmark"), "item_id")
    return R.attributed_claims(claims, _with_text(_bm25(spark, sf_dir), spark, sf_dir))


@query(_ATTRIBUTED)
def claims_attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir)


@query(f"SELECT query_id, count(*) AS claims, sum(attributed)::BIGINT AS attributed, round(avg(attributed), 9) AS context_recall FROM ({_ATTRIBUTED}) GROUP BY query_id")
def claims_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context recall of each item: the part of its claims that its contexts bear out."""
    return _attributed(spark, sf_dir).groupBy("query_id").agg(F.count(F.lit(1)).alias("claims"), F.sum("attributed").alias("attributed"), F.round(F.avg("attributed"), 9).alias("context_recall"))


@query()
def rewrite_rag_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow with offline stand-ins: rewrite, two rankings, fusion, rerank, prompt, answer, judgement."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("q"), F.col("text").alias("reference"))
    fused = R.rrf(_lists(spark, sf_dir)).join(items, "query_id")
    best = R.contexts(R.rerank(fused, M.coverage(F.col("q"), F.col("text")), 10), RetrievalConfig().context_top).join(items, "query_id")
    prompts = best.select("query_id", "reference", X.render("{contexts}\n\n{query}", {"contexts": X.number_contexts(F.col("contexts")), "query": F.col("q")}).alias("prompt"))
    answers = M.generate(prompts, "prompt", M.TemplateProvider, "LLM_answer", "error")
    return answers.select("query_id", F.length("prompt").alias("prompt_len"), "LLM_answer", M.overlap_judge(F.col("reference"), F.col("LLM_answer")).alias("judge_raw"), "error")
