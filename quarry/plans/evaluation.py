"""Queries of parsing, metrics, sampling and post-training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import parse as J
from quarry.functions import providers as M
from quarry.functions import text as X
from quarry.operators import metrics as E
from quarry.operators import posttrain as P
from quarry.operators import sampling as N
from quarry.plans.base import query, strip_sql, table, values_sql

_OUTPUTS = [(1, "法律类"), (2, "这个敏感"), (3, "天气"), (4, "?"), (5, "违规类和法律类"), (6, None), (7, "答案是法律"), (8, "聊天")]
_HAS = lambda words: " OR ".join(f"contains(t, '{w}')" for w in words)
_INTENT = "CASE " + " ".join(f"WHEN {_HAS(w)} THEN '{c}'" for c, w in [(x, [x]) for x in J.CLASSES] + J.CASCADE) + " ELSE 'UNKNOWN' END"


@query(f"SELECT id, {_INTENT} AS intent FROM (SELECT id, coalesce(t, '') AS t FROM {values_sql(['id', 't'], _OUTPUTS)} UNION ALL SELECT 1000 + conv_id * 1000 + turn, text FROM conversations)")
def intent_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_OUTPUTS, "id long, t string").unionAll(table(spark, sf_dir, "conversations").select(1000 + F.col("conv_id") * 1000 + F.col("turn"), "text"))
    return rows.select("id", J.intent(F.col("t")).alias("intent"))


_LABELS = [(1, " 法律 "), (2, "法务类"), (3, "违 规"), (4, ""), (5, None), (6, "非法类"), (7, "闲聊"), (8, "别的")]
_S = "replace(" + strip_sql("coalesce(t, '')") + ", ' ', '')"
_ALIAS = "CASE s " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in J.ALIASES.items()) + " ELSE s END"


@query(f"SELECT id, coalesce(nullif(a, ''), '闲聊类') AS label, a AS plain FROM (SELECT id, {_ALIAS} AS a FROM (SELECT id, {_S} AS s FROM (SELECT * FROM {values_sql(['id', 't'], _LABELS)} UNION ALL SELECT 1000 + conv_id * 1000 + turn, CASE role WHEN 'user' THEN ' 闲 聊 ' WHEN 'assistant' THEN text ELSE '法律' END FROM conversations)))")
def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed cases, and labels and texts of all conversations."""
    t = F.col("t")
    told = F.when(F.col("role") == "user", F.lit(" 闲 聊 ")).when(F.col("role") == "assistant", F.col("text")).otherwise(F.lit("法律"))
    rows = table(spark, sf_dir, "conversations").select(1000 + F.col("conv_id") * 1000 + F.col("turn"), told)
    return spark.createDataFrame(_LABELS, "id long, t string").unionAll(rows).select("id", J.normalise_label(t).alias("label"), J.normalise_label(t, False).alias("plain"))


_JUDGED = [(1, "1"), (2, " 0\n"), (3, "答案：1"), (4, "10"), (5, "0.9"), (6, "none"), (7, ""), (8, None)]


@query(f"SELECT id, TRY_CAST(nullif(regexp_extract(t, '[01]'), '') AS INTEGER) AS label FROM (SELECT * FROM {values_sql(['id', 't'], _JUDGED)} UNION ALL SELECT 1000 + conv_id * 1000 + turn, text FROM conversations)")
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_JUDGED, "id long, t string").unionAll(table(spark, sf_dir, "conversations").select(1000 + F.col("conv_id") * 1000 + F.col("turn"), "text"))
    return rows.select("id", J.judge_label(F.col("t")).alias("label"))


@query(
    """SELECT count(*) AS num_samples, count(quality) AS num_valid_labels, count_if(quality = 1)::BIGINT AS num_label_1, count(*) - count(quality) AS num_parse_fail, count_if(quality IS NULL)::BIGINT AS num_api_fail,
    count_if(quality = 1) / CAST(count(quality) AS DOUBLE) AS accuracy_consistency FROM documents LEFT JOIN labels USING (doc_id)"""
)
def judge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return E.judge_metrics(rows, F.col("quality"), F.when(F.col("quality").isNull(), F.lit("no answer")))


# A rule that stands for a model: quality by length, with an answer outside the classes for very short texts.
_RULE_SQL = "(SELECT doc_id, quality AS gt, CASE WHEN n_chars < 200 THEN 9 WHEN n_chars < 1500 THEN 0 ELSE 1 END AS pred FROM documents JOIN labels USING (doc_id))"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", F.col("quality").alias("gt"), F.when(n < 200, 9).when(n < 1500, 0).otherwise(1).alias("pred"))


_GRID = "(SELECT * FROM (VALUES (0), (1)) AS a(gt), (VALUES (0), (1)) AS b(pred))"


@query(f"SELECT CAST(g.gt AS INTEGER) AS gt, CAST(g.pred AS INTEGER) AS pred, count(r.doc_id) AS n FROM {_GRID} AS g LEFT JOIN {_RULE_SQL} AS r ON r.gt = g.gt AND r.pred = g.pred GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(_predicted(spark, sf_dir), "gt", "pred", [0, 1])


def _prf_sql(fn: str) -> str:
    return f"""WITH r AS (SELECT * FROM {_RULE_SQL}), c AS (SELECT * FROM (VALUES (0), (1)) AS t(label)),
n AS (SELECT CAST(label AS INTEGER) AS label, count_if(gt = label AND pred = label)::BIGINT AS tp, count_if(gt IN (0, 1) AND gt <> label AND pred = label)::BIGINT AS fp, count_if({fn})::BIGINT AS fn FROM c, r GROUP BY label),
p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall FROM n)
SELECT label, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM p"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c in columns else c for c in df.columns])


@query(_prf_sql("gt = label AND pred <> label"))
def prf_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.prf_all_predictions(_predicted(spark, sf_dir), "gt", "pred", [0, 1]), "precision", "recall", "f1")


@query(_prf_sql("gt = label AND pred <> label AND pred IN (0, 1)"))
def prf_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(E.prf_matrix(_predicted(spark, sf_dir), "gt", "pred", [0, 1]), "precision", "recall", "f1")


@query(f"SELECT round((SELECT count_if(gt = pred) / count(*) FROM {_RULE_SQL}), 9)::DOUBLE AS accuracy, round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1 FROM ({_prf_sql('gt = label AND pred <> label')})")
def macro_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predicted(spark, sf_dir)
    return _rounded(E.summary(prf_v1(spark, sf_dir), rows, "gt", "pred"), "accuracy", "macro_precision", "macro_recall", "macro_f1")


@query(f"SELECT gt AS label, count(*) AS n FROM {_RULE_SQL} GROUP BY gt")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.label_counts(_predicted(spark, sf_dir).select(F.col("gt").alias("label")), "label")


@query("SELECT conv_id, turn, count(*) OVER w AS seen, round(avg(CAST(role = 'user' AS INTEGER)) OVER w, 9) AS rate FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.running_rate(table(spark, sf_dir, "conversations"), F.col("role") == "user", "turn", "conv_id")
    return r.select("conv_id", "turn", "seen", F.round("rate", 9).alias("rate"))


@query("SELECT role, round(avg(CAST(contains(text, '?') OR length(text) > 100 AS INTEGER)), 9) AS ok_rate FROM conversations GROUP BY role")
def parse_ok_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.contains("text", F.lit("?")) | (F.length("text") > 100)
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.round(F.avg(ok.cast("double")), 9).alias("ok_rate"))


_MD5 = "md5('42|' || {0})"


@query(f"SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_MD5.format('event_id')}, event_id) <= 50")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.stratified(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", 50)


@query(f"SELECT doc_id, lang FROM documents ORDER BY {_MD5.format('doc_id')}, doc_id LIMIT 200")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 200)


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_MD5.format('doc_id')}, doc_id) <= floor((SELECT count(*) FROM documents) * 0.1) THEN 'val' ELSE 'train' END AS split FROM documents")
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.split_train_val(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


_PICK = "(('0x' || left(md5('42|' || conv_id || '|' || (n - {0})), 14))::BIGINT % (n - {0} + 1))"
# One of four places after the other: a hashed one, or the last allowed if that is taken
_TAKE = "SELECT *, CASE WHEN list_contains(p, {0}) THEN n - {1} ELSE {0} END AS x{1} FROM"


def _four_places() -> str:
    sql = "SELECT DISTINCT conv_id, n, CAST([] AS BIGINT[]) AS p FROM conversations, (SELECT count(*) AS n FROM benchmark)"
    for j in (4, 3, 2, 1):
        sql = f"SELECT conv_id, n, list_append(p, x{j}) AS p FROM ({_TAKE.format(_PICK.format(j), j)} ({sql}))"
    return sql


@query(f"SELECT conv_id, item_id, CAST(shot AS INTEGER) AS shot FROM (SELECT conv_id, unnest(p) AS place, generate_subscripts(p, 1) AS shot FROM ({_four_places()})) JOIN (SELECT item_id, row_number() OVER (ORDER BY md5('42|' || item_id), item_id) - 1 AS place FROM benchmark) USING (place)")
def fewshot_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return N.few_shot(draws, table(spark, sf_dir, "benchmark").select("item_id"), "conv_id", "item_id").select("conv_id", "item_id", "shot")


@query(f"SELECT conv_id, arg_max(s, turn) AS query FROM (SELECT conv_id, turn, {strip_sql('text')} AS s FROM conversations WHERE role = 'user') WHERE s <> '' GROUP BY conv_id")
def last_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.last_user_turns(table(spark, sf_dir, "conversations"))


_PAIRS = "(SELECT u.conv_id, u.turn, u.text AS query, a.text AS answer FROM conversations AS u JOIN conversations AS a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"


@query(f"SELECT * FROM {_PAIRS}")
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.qa_pairs(table(spark, sf_dir, "conversations"))


@query(f"SELECT query AS instruction, '' AS input, answer AS output FROM {_PAIRS} WHERE {strip_sql('query')} <> '' AND length({strip_sql('answer')}) >= 15")
def sft_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sft_filter(P.as_sft(qa_pairs(spark, sf_dir)))


_VERDICT = "CASE WHEN length(answer) % 3 = 0 THEN '{\"better\": \"a\"}' WHEN length(answer) % 3 = 1 THEN 'so {\"better\":\"B\"}.' ELSE '{\"better\":\"C\"}' END"


@query(
    f"""SELECT instruction, '' AS input, CASE WHEN k = 0 THEN a ELSE b END AS chosen, CASE WHEN k = 0 THEN b ELSE a END AS rejected FROM
    (SELECT {strip_sql('query')} AS instruction, {strip_sql('answer')} AS a, {strip_sql('query')} AS b, length(answer) % 3 AS k FROM {_PAIRS}) WHERE k < 2 AND instruction <> '' AND a <> '' AND a <> b"""
)
def dpo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.length("answer") % 3
    raw = F.when(k == 0, F.lit('{"better": "a"}')).when(k == 1, F.lit('so {"better":"B"}.')).otherwise(F.lit('{"better":"C"}'))
    rows = qa_pairs(spark, sf_dir).select(F.col("query").alias("instruction"), F.lit("").alias("input"), F.col("answer").alias("cand_a"), F.col("query").alias("cand_b"), raw.alias("raw"))
    return P.preference_pairs(rows, J.better_of_two(F.col("raw")))


_N = "(SELECT lang, CAST(length(text) AS BIGINT) AS n FROM documents)"


@query(f"SELECT lang, count(*) AS count, min(n) AS min, {', '.join(f'quantile_disc(n, {p}) AS p{int(p * 100)}' for p in E.PERCENTILES)}, max(n) AS max, round(sum(n) / CAST(count(*) AS DOUBLE), 2) AS mean FROM {_N} GROUP BY lang")
def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.length_summary(table(spark, sf_dir, "documents").select("lang", F.length("text").cast("long").alias("n")), "n", "lang")


_BIN = "CASE " + " ".join(f"WHEN n <= {b} THEN '<= {b}'" for b in E.BINS) + f" ELSE '> {E.BINS[-1]}' END"


@query(f"SELECT bin, count(n) AS n FROM (VALUES {', '.join(f'({chr(39)}<= {b}{chr(39)})' for b in E.BINS)}, ('> {E.BINS[-1]}')) AS t(bin) LEFT JOIN (SELECT {_BIN} AS bin, n FROM {_N}) USING (bin) GROUP BY bin")
def length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.histogram(table(spark, sf_dir, "documents").select(F.length("text").alias("n")), "n")


_TOK = "len(list_filter(regexp_split_to_array({0}, '[\\s\\x0b]+'), lambda x: x <> ''))"


_BRIEF = "(CASE WHEN turn % 4 = 1 THEN 2 ELSE 0 END)"  # some prompts have an input, `Be brief.`


@query(f"SELECT conv_id, turn, {_TOK.format('query')} + {_BRIEF} AS prompt_tokens, {_TOK.format('answer')} AS chosen_tokens, {_TOK.format('query')} + {_BRIEF} + {_TOK.format('answer')} AS prompt_chosen_tokens FROM {_PAIRS}")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qa_pairs(spark, sf_dir).select("conv_id", "turn", F.col("query").alias("instruction"), F.when(F.col("turn") % 4 == 1, "Be brief.").otherwise("").alias("input"), F.col("answer").alias("chosen"), F.col("query").alias("rejected"))
    t = P.token_counts(rows, M.whitespace_tokens)
    return t.select("conv_id", "turn", *[F.col(c).cast("long").alias(c) for c in ("prompt_tokens", "chosen_tokens", "prompt_chosen_tokens")])


TEMPLATE = 'Q: {query}\nA: {answer}\nSay {{"better": 0}} {other}.'


@query(f"SELECT conv_id, turn, 'Q: ' || query || chr(10) || 'A: ' || answer || chr(10) || 'Say {{\"better\": 0}} {{other}}.' AS prompt, replace('<<S>> end', '<<S>>', query) AS replaced, 'no place' || chr(10) || chr(10) || query AS appended FROM {_PAIRS}".replace("{{", "{").replace("}}", "}"))
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qa_pairs(spark, sf_dir)
    q = F.col("query")
    return rows.select("conv_id", "turn", X.render(TEMPLATE, {"query": q, "answer": F.col("answer")}).alias("prompt"), X.render_or_append("<<S>> end", "<<S>>", q).alias("replaced"), X.render_or_append("no place", "<<S>>", q).alias("appended"))


@query("SELECT event_id, event_type, json_extract_string(props, '$.page') AS page, json_valid(props) AND json_type(props) = 'OBJECT' AS strict FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "event_type", F.get_json_object("props", "$.page").alias("page"), J.is_json_object(F.col("props")).alias("strict"))


_JSON = [(1, '{"a": 1}'), (2, 'x {"a": "b"} y'), (3, '{"a":1}{"a":2}'), (4, "{'a':1}"), (5, "[1]"), (6, ""), (7, '  {"a": null} '), (8, None), (9, '{"a":1} x'), (10, "plain")]
_SPAN = "nullif(regexp_extract(t, '(?s)\\{.*\\}'), '')"


# Props as they are, with text around them, twice, cut, and with blanks
_DIRTY_SQL = "SELECT 1000 + event_id AS id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN 'see ' || props || ' there' WHEN 2 THEN props || props WHEN 3 THEN left(props, length(props) - 1) ELSE chr(10) || ' ' || props || ' ' END AS t FROM events"


def _dirty_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed cases, and the JSON of all events in five states."""
    p, k = F.col("props"), F.col("event_id") % 5
    dirty = F.when(k == 0, p).when(k == 1, F.concat(F.lit("see "), p, F.lit(" there"))).when(k == 2, F.concat(p, p)).when(k == 3, F.expr("left(props, length(props) - 1)")).otherwise(F.concat(F.lit("\n "), p, F.lit(" ")))
    return spark.createDataFrame(_JSON, "id long, t string").unionAll(table(spark, sf_dir, "events").select(1000 + F.col("event_id"), dirty))


@query(
    f"SELECT id, CASE WHEN json_valid(t) AND starts_with({strip_sql('t')}, '{{') THEN {strip_sql('t')} WHEN json_valid({_SPAN}) AND starts_with({_SPAN}, '{{') THEN {_SPAN} END AS obj FROM (SELECT * FROM {values_sql(['id', 't'], _JSON)} UNION ALL {_DIRTY_SQL})"
)
def json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty_json(spark, sf_dir).select("id", J.json_object(F.col("t")).alias("obj"))


# Of the fixed cases two objects in a row give the first, single quotes and text behind the end are seen through.
_FOUND = "CASE id WHEN 1 THEN '1' WHEN 2 THEN 'b' WHEN 3 THEN '1' WHEN 4 THEN '1' WHEN 9 THEN '1' END"


@query(f"SELECT id, {_FOUND} AS a, CASE WHEN id > 1000 AND id % 5 <> 3 THEN json_extract_string(props, '$.page') END AS page FROM (SELECT id, NULL AS props FROM {values_sql(['id', 't'], _JSON)} UNION ALL SELECT 1000 + event_id, props FROM events)")
def json_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _dirty_json(spark, sf_dir).select("id", J.lenient_object(F.col("t")).alias("obj"))
    return found.select("id", F.get_json_object("obj", "$.a").alias("a"), F.get_json_object("obj", "$.page").alias("page"))


@query("SELECT event_type, count(*) AS lines, count_if(NOT list_contains(json_keys(props), 'page'))::BIGINT AS missing FROM events GROUP BY event_type")
def required_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = F.array_contains(F.json_object_keys("props"), "page")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("lines"), F.count_if(~has).alias("missing"))


_REWRITES = [(1, "q1", None), (2, "q2", "  "), (3, "q3", "```text\n“改写”\n```"), (4, "q4", '"a"\nsecond'), (5, "q5", "\n\n x \n y")]
# Answers with a code fence, in quotes of both kinds, after blank lines, and blank ones
_ANSWERED_SQL = "SELECT 1000 + conv_id * 1000 + turn AS id, role AS query, CASE turn % 5 WHEN 0 THEN '```text' || chr(10) || '“' || text || '”' || chr(10) || '```' WHEN 1 THEN '\"' || text || '\"' WHEN 2 THEN chr(10) || ' ' || chr(10) || text WHEN 3 THEN '  ' ELSE text END AS rewrite FROM conversations"
_UNFENCED = f"regexp_replace(regexp_replace({strip_sql(chr(114))}, '(?s)^```.*?\n', ''), '\n```$', '')"
_UNQUOTED = strip_sql(f"""regexp_replace(regexp_replace({strip_sql(_UNFENCED)}, '^"+|"+$', '', 'g'), '^[“”]+|[“”]+$', '', 'g')""")
_LINES = rf"list_filter(list_transform(string_split_regex({_UNQUOTED}, '\r\n|[\n\r\x{{2028}}\x{{2029}}\x{{85}}\x0b\x0c\x1c-\x1e]'), lambda x: {strip_sql('x')}), lambda x: x <> '')"


@query(f"SELECT id, coalesce({_LINES}[1], '') AS cleaned, coalesce(nullif({strip_sql('rewrite')}, ''), query) AS used FROM (SELECT *, coalesce(rewrite, '') AS r FROM (SELECT * FROM {values_sql(['id', 'query', 'rewrite'], _REWRITES)} UNION ALL {_ANSWERED_SQL}))")
def rewrite_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed cases, and the texts of all conversations as a model may wrap them."""
    t, k = F.col("text"), F.col("turn") % 5
    wrapped = F.when(k == 0, F.concat(F.lit("```text\n“"), t, F.lit("”\n```"))).when(k == 1, F.concat(F.lit('"'), t, F.lit('"'))).when(k == 2, F.concat(F.lit("\n \n"), t)).when(k == 3, F.lit("  ")).otherwise(t)
    rows = spark.createDataFrame(_REWRITES, "id long, query string, rewrite string").unionAll(table(spark, sf_dir, "conversations").select(1000 + F.col("conv_id") * 1000 + F.col("turn"), "role", wrapped))
    return rows.select("id", J.clean_rewrite(F.col("rewrite")).alias("cleaned"), J.rewrite_or_query(F.col("rewrite"), F.col("query")).alias("used"))


_RAW = [(1, "{'context_recall': 0.4204, 'context_precision': 0.4181}"), (2, "nothing"), (3, None)]


@query(f"SELECT id, TRY_CAST(nullif(regexp_extract(raw, '''context_recall'': ([0-9.]+)', 1), '') AS DOUBLE) AS recall FROM (SELECT * FROM {values_sql(['id', 'raw'], _RAW)} UNION ALL SELECT 1000 + event_id, '{{''context_precision'': 0.5, ''context_recall'': ' || (event_id % 1000) || '.' || (event_id % 7) || '}}' FROM events)".replace("{{", "{").replace("}}", "}"))
def raw_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed cases, and a metrics text for each event."""
    number = F.concat((F.col("event_id") % 1000).cast("string"), F.lit("."), (F.col("event_id") % 7).cast("string"))
    told = F.concat(F.lit("{'context_precision': 0.5, 'context_recall': "), number, F.lit("}"))
    rows = spark.createDataFrame(_RAW, "id long, raw string").unionAll(table(spark, sf_dir, "events").select(1000 + F.col("event_id"), told))
    return rows.select("id", J.raw_metric(F.col("raw"), "context_recall").alias("recall"))


_FIELDS = [(1, None, "甲", None), (2, " ", "", "x"), (3, "q", "y", "z"), (4, None, None, None)]


@query(f"SELECT id, coalesce({', '.join(f'nullif({strip_sql(c)}, {chr(39) * 2})' for c in ('a', 'b', 'c'))}, '') AS query FROM (SELECT * FROM {values_sql(['id', 'a', 'b', 'c'], _FIELDS)} UNION ALL SELECT 1000 + conv_id * 1000 + turn, CASE WHEN turn % 3 = 0 THEN text END, CASE WHEN turn % 3 = 1 THEN ' ' || text ELSE ' ' END, role FROM conversations)")
def field_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed cases, and texts of all conversations in one of three fields."""
    k = F.col("turn") % 3
    rows = table(spark, sf_dir, "conversations").select(1000 + F.col("conv_id") * 1000 + F.col("turn"), F.when(k == 0, F.col("text")), F.when(k == 1, F.concat(F.lit(" "), "text")).otherwise(F.lit(" ")), "role")
    return spark.createDataFrame(_FIELDS, "id long, a string, b string, c string").unionAll(rows).select("id", X.first_filled(F.col("a"), F.col("b"), F.col("c")).alias("query"))
