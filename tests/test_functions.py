"""Semantics that the driver's tables can't show: CJK texts, dirty rows, golden confusion counts, splitter, sources, providers."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import ChunkConfig
from quarry.functions import parse as J
from quarry.functions import providers as M
from quarry.functions import text as X
from quarry.operators import chunk as C
from quarry.operators import corpus as K
from quarry.operators import metrics as E
from quarry.operators import retrieve as R
from quarry.operators import sampling as N
from quarry.schemas import QA
from quarry.sources import readers, sinks
from tests.splitter import split_recursive


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("1", 1), (" 0\n", 0), ("答案：1", 1), ("10", 1), ("0.9", 0), ("none", None), (None, None)])
def test_judge_label(spark, text, want):
    assert one(spark, text, J.judge_label) == want


def test_articles(spark):
    assert one(spark, "前言第一条 甲。第二条 乙依照第一条处理", C.split_articles) == ["前言", "第一条 甲。", "第二条 乙依照", "第一条处理"]
    assert one(spark, "没有", C.split_articles) == ["没有"]
    assert one(spark, " 　", C.split_articles) == []


def test_strip_and_title(spark):
    assert one(spark, "　 x \n", X.strip) == "x"
    assert one(spark, "某法（2009-08-27）.md", X.title_of) == one(spark, "某法(2009-08-27).MD", X.title_of) == "某法"


def test_json(spark):
    assert one(spark, '{"better":"a"}', J.better_of_two) == "A"
    assert one(spark, 'x {"better":"B"} y', J.better_of_two) == "B"
    assert one(spark, '{"a":1}{"a":2}', J.json_object) is None
    for text, want in (('a {"x": {"y": 1}} {', '{"x": {"y": 1}}'), ("} {a{b}c}{", "{a{b}c}"), ("{ {", None), ("", None), (None, None), ("no", None), ("}{}{}", "{}")):
        assert one(spark, text, J.balanced) == want
    lenient = lambda t: (lambda x: None if x is None else json.loads(x))(one(spark, t, J.lenient_object))
    assert lenient("```json\n{“a”: 1} trailing\n```") == {"a": 1}
    assert lenient("```JSON {'a': {'b': '}'}}``` ") == {"a": {"b": "}"}}  # the balanced part is none, the whole text is
    assert lenient("{'a': 1}") == lenient('so {"a": 1} and {"b": 2}') == {"a": 1}
    assert lenient("nothing") is lenient("[1]") is lenient(None) is None


def test_splitter():
    cfg = ChunkConfig(size=10, overlap=3)
    text = "一二三四。五六七八九。十一二三四五六七八九十。"
    parts = split_recursive(text, cfg)
    assert all(len(p) <= 10 for p in parts)
    assert "".join(parts).count("五") >= 2
    assert split_recursive("a" * 25, ChunkConfig(size=10, overlap=2)) == ["a" * 10, "a" * 10, "a" * 9]
    assert split_recursive("ab\n\ncd", ChunkConfig(size=4, overlap=0)) == ["ab", "cd"]


def test_rank_fusion(spark):
    rows = [(1, "bm25", 0, 1, "a"), (1, "bm25", 0, 2, "b"), (1, "bm25", 0, 3, ""), (1, "bm25", 0, 4, "c"), (1, "dense", 1, 1, "c"), (1, "dense", 1, 2, "a")]
    got = R.rrf(spark.createDataFrame(rows, "query_id int, src string, src_order int, rank int, text string")).orderBy("rank").collect()
    assert [r.text for r in got] == ["a", "c", "b"]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)
    assert got[1].ranks == {"bm25": 4, "dense": 1}


@pytest.mark.parametrize(
    ("cells", "want"),
    [
        ({"法律类": (649, 326, 551), "违规类": (170, 489, 230), "闲聊类": (192, 3, 208)}, (0.5055, 0.6361, 0.4819, 0.5211)),
        ({"法律类": (1189, 45, 11), "违规类": (351, 11, 49), "闲聊类": (400, 4, 0)}, (0.97, 0.9744, 0.9561, 0.9644)),
    ],
)
def test_published_macro_figures(spark, cells, want):
    """The published counts of hits, false alarms and misses give the published figures."""
    counts = spark.createDataFrame([(c, *v) for c, v in cells.items()], "label string, tp int, fp int, fn int")
    s = E.ratios(counts).selectExpr("sum(tp) / sum(tp + fn)", "avg(precision)", "avg(recall)", "avg(f1)").first()
    assert tuple(s) == pytest.approx(want, abs=6e-5)


def test_sampling(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") % 10 == 0, "b").otherwise("a"))
    got = N.stratified(df, "s", "id", {"a": 30, "b": 20}, strict=True)
    assert dict(got.groupBy("s").count().collect()) == {"a": 30, "b": 20}
    with pytest.raises(Exception, match="fewer than"):
        N.stratified(df, "s", "id", {"a": 30, "b": 200}, strict=True).count()
    split = N.split_train_val(df, "id")
    assert dict(split.groupBy("split").count().collect()) == {"train": 900, "val": 100}
    assert N.split_train_val(df, "id").where("split = 'val'").join(split.where("split = 'train'"), "id").count() == 0


def test_corpus_is_idempotent(spark):
    rows = [(1, "a" * 30), (2, "a" * 30 + "\r\n"), (3, "short"), (4, "b" * 25)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    once = K.build(df)
    assert sorted(r.doc_id for r in once.collect()) == [1, 4]
    assert K.build(once.select("doc_id", "text")).count() == 2
    s = K.stats(df).first()
    assert (s.input_docs, s.output_docs, s.skipped_too_short, s.deduped_by_text_hash) == (4, 2, 1, 1)
    assert K.stats(df.limit(0)).first().avg_len == 0.0


def test_required_count(spark):
    assert K.require_count(spark.range(5), 5).count() == 5
    with pytest.raises(Exception, match="expected 6 rows, found 5"):
        K.require_count(spark.range(5), 6).count()


def test_sources(spark, tmp_path):
    (tmp_path / "law" / "民法").mkdir(parents=True)
    (tmp_path / "law" / ".git").mkdir()
    (tmp_path / "law" / "民法" / "某法（2009-08-27）.md").write_bytes("第一条 ".encode() + b"\xff" + "甲".encode())
    (tmp_path / "law" / ".git" / "x.md").write_text("hidden")
    got = readers.markdown_tree(spark, str(tmp_path)).collect()
    assert [(r.title, r.law_group) for r in got] == [("某法", "民法")]
    assert got[0].text.endswith("甲")
    p = tmp_path / "a.jsonl"
    p.write_text('{"query":"q","answer":"a"}\n\nnot json\n{"query":"1","answer":"2"}{"query":"3"}\n{"answer":"b"}')
    assert readers.jsonl_lenient(spark, str(p), QA).count() == 2
    c = readers.jsonl_counted(spark, str(p), ["query"]).first()
    assert (c.lines, c.bad, c.missing, c.good) == (5, 3, 1, 1)
    with pytest.raises(Exception, match="."):
        readers.jsonl(spark, str(p), QA).collect()
    w = tmp_path / "w.json"
    w.write_text(json.dumps({"items": [{"query": "q", "answer": "a"}]}))
    assert readers.wrapped_array(spark, str(w), QA).first().query == "q"
    t = tmp_path / "t.csv"
    t.write_text("query,answer\n\"a\nb\",c\n")
    assert readers.csv(spark, str(t), QA, ["query"]).first().query == "a\nb"
    with pytest.raises(ValueError, match="missing columns"):
        readers.csv(spark, str(t), QA, ["other"])
    assert readers.template(spark, None, ["{q}"], "ask {q}") == "ask {q}"
    with pytest.raises(ValueError, match="lacks"):
        readers.template(spark, None, ["{z}"], "ask {q}")


def test_labelled_files(spark, tmp_path):
    """Rows whose label isn't their file's, wrong keys and lines of two objects are left out; repeated questions stay."""
    from quarry.schemas import INTENT

    row = lambda q, key, label: json.dumps({"问题": q, key: label}, ensure_ascii=False)
    (tmp_path / "law_01.jsonl").write_text("\n".join([row("a", "类型", "法律类"), row("a", "类型", "法律类"), row("b", "法律类", "法律类"), row("c", "类型", "闲聊类")]))
    (tmp_path / "chat_01.jsonl").write_text(row("d", "类型", "闲聊类") + row("e", "类型", "闲聊类") + "\n" + row("f", "类型", "闲聊类"))
    rows = readers.partitioned_jsonl(spark, str(tmp_path), {"law": "法律类", "chat": "闲聊类"}, INTENT, "类型")
    assert sorted((r["类型"], r["问题"]) for r in rows.collect()) == [("法律类", "a"), ("法律类", "a"), ("闲聊类", "f")]
    (tmp_path / "qa.json").write_text(json.dumps([{"query": "q", "answer": "a"}] * 3))
    assert readers.json_array(spark, str(tmp_path / "qa.json"), QA, ["query", "answer"]).count() == 3


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "chunk_id string, text string")
    b = spark.createDataFrame([("2", "z", 1), ("2", "w", 2), (None, "n", 3)], "chunk_id string, text string, seq int")
    assert dict(sinks.upsert(a, b, "chunk_id", "seq").collect()) == {"1": "x", "2": "w"}
    out = str(tmp_path / "done")
    for _ in range(2):
        sinks.append_missing(a, out, "chunk_id", lambda d: d)
    assert spark.read.parquet(out).count() == 2
    index = sinks.text_index(spark.createDataFrame([(1, "甲乙 foo"), (2, "foo bar")], "doc_id long, text string"), str(tmp_path / "index"))
    hits = R.bm25(index, spark.createDataFrame([(1, "乙")], "query_id int, text string")).collect()
    assert [(r.doc_id, r.rank) for r in hits] == [(1, 1)]
    with pytest.raises(Exception, match="3 dimensions"):
        sinks.vector_index(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id int, embedding array<float>"), str(tmp_path / "v"), 3)
    sinks.json_document(a, str(tmp_path / "doc"))
    assert len(json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "doc"), wholetext=True).collect()))) == 2


def test_providers(spark):
    calls = []

    def failing(batch):
        calls.append(len(batch))
        raise RuntimeError("down")

    waits = []
    texts, errors = M.call_with_retry(failing, ["a", "b"], M.Retry(3, 2.0), waits.append)
    assert texts == ["", ""]
    assert all("down" in e for e in errors)
    assert waits == [2.0, 4.0]
    df = spark.createDataFrame([(1, "line one\nline two"), (2, None)], "id int, prompt string")
    assert [r.output for r in M.generate(df, "prompt", M.TemplateProvider).orderBy("id").collect()] == ["line one", ""]
    v = df.select(M.hash_embedding(F.col("prompt"), 8).alias("v")).first().v
    assert sum(x * x for x in v) == pytest.approx(1.0)
    assert spark.range(1).select(R.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c")).first().c == pytest.approx(0.5**0.5)


def test_streaming(spark, tmp_path, small):
    from quarry.streaming.ingest import stream_corpus, windowed_counts

    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream_corpus(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "table"), str(tmp_path / "ck")).awaitTermination()
    table = spark.read.parquet(str(tmp_path / "table"))
    assert table.count() == table.select("doc_id").distinct().count() > 100
    events = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert windowed_counts(events).first().n == 2


def test_sorted_corpus(spark, small):
    from quarry.plans import more

    got = [tuple(r) for r in more.corpus_sorted(spark, small).collect()]
    assert got == sorted(got, key=lambda r: (r[0].encode(), (r[1] or "").encode(), r[2]))


def test_chat_interface_and_settings():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            told = f"{asked['model']} {asked['temperature']} {asked['max_tokens']} {len(asked['messages'])} {asked['messages'][-1]['content']} {self.headers['Authorization']}"
            body = json.dumps({"choices": [{"message": {"content": told}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        settings = M.Generation("m", system="s", **M.JUDGE)
        api = M.ChatApi({"here": f"http://127.0.0.1:{server.server_port}/v1"}, "here", "k", settings)
        assert api(["a", "b"]) == ["m 0.0 8 2 a Bearer k", "m 0.0 8 2 b Bearer k"]
    finally:
        server.shutdown()
    with pytest.raises(ValueError):
        M.ChatApi({}, "here", "k", settings)
    assert M.Generation("m", "sft+dpo", "s", "d").adapters() == ["s", "d"] and M.Generation("m").adapters() == []
    for bad in (M.Generation("m", "other"), M.Generation("m", "dpo")):
        with pytest.raises(ValueError):
            bad.adapters()


def test_progress_and_dispatch(spark):
    df = spark.createDataFrame([(1, ""), (2, "x"), (3, None)], "id int, error string")
    seen, watch = M.progress(df, "error")
    assert seen.count() == 3 and watch.get == {"rows": 3, "errors": 1}
    assert M.throughput(lambda: 4)["rows"] == 4
    with pytest.raises(ValueError):
        R.retrieve("bm26", df, {})
    with pytest.raises(ValueError):
        R.retrieve("qwen3", df, {"bm25": None})


def test_strictest_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert readers.jsonl(spark, str(tmp_path), schema).count() >= 2
    with pytest.raises(Exception, match="not a JSON object"):
        readers.jsonl_no_blanks(spark, str(tmp_path), schema).collect()


def test_knn_blocks_agree(spark, small):
    from quarry.operators import retrieve

    v = spark.read.parquet(f"{small}/embeddings.parquet")
    q = v.where("vec_id % 5 = 0")
    one, many = (sorted(map(tuple, retrieve.knn(v, q, block_bytes=n).collect())) for n in (1 << 26, 20_000))
    assert one == many


def test_stream_takes_changed_texts(spark, tmp_path):
    from quarry.streaming.ingest import current, stream_corpus

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    for text in ("a text of more than twenty characters", "another text of more than twenty characters"):
        spark.createDataFrame([(1, text), (2, "one that stays as it is for good")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream_corpus(spark, str(tmp_path / "in"), schema, str(tmp_path / "table"), str(tmp_path / "ck")).awaitTermination()
    assert {r.doc_id: r.text[:7] for r in current(spark, str(tmp_path / "table")).collect()} == {1: "another", 2: "one tha"}
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3


def test_documents_beyond_one_file(spark, tmp_path, monkeypatch):
    """more rows than one file takes are several documents, each whole, with every row once and in order."""
    monkeypatch.setattr(sinks, "ROWS_ONE_FILE", 100)
    rows = spark.range(950).select("id", F.concat(F.lit("[\"\\"), F.col("id").cast("string")).alias("t"))
    out = str(tmp_path / "parts")
    sinks.json_document(rows, out, ["id"], ('{"note": ["]"], "items":\n', "\n}"))
    texts = [r.value for r in spark.read.text(out, wholetext=True).collect()]
    assert len(texts) == 10 and all(json.loads(t)["note"] == ["]"] for t in texts)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])
    got = readers.wrapped_array(spark, f"file://{out}", schema, 512)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    sinks.json_document(rows.limit(0), out, ["id"])
    assert [json.loads(r.value) for r in spark.read.text(out, wholetext=True).collect()] == [[]]
