"""Neighbours by cells, stored indexes, arrays by ranges, keyed tables, rounds, draws, positions, pacing, splitter, streams."""

import json
import math
import random
import re
import time
from collections import Counter
from itertools import combinations
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import ChunkConfig, RetrievalConfig
from quarry.functions import providers as M
from quarry.operators import chunk as C
from quarry.operators import generate as G
from quarry.operators import metrics as E
from quarry.operators import order as O
from quarry.operators import retrieve as R
from quarry.operators import sampling as N
from quarry.operators import vectors as V
from quarry.sources import arrays, keyed, sinks
from tests.splitter import split_recursive


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above(text, leaf):
    """Operators from the leaf that matches up to the root."""
    lines = text.split("\n")
    depth = lambda x: len(re.match(r"[ :+\-|]*", x)[0])
    k = next(i for i, x in enumerate(lines) if re.search(leaf, x))
    out, now = [], depth(lines[k])
    for x in reversed(lines[:k]):
        if x.strip() and depth(x) < now:
            now = depth(x)
            out.append(x.strip(" :+-"))
    return out


# Neighbours


def test_cells_reach_recall_and_skip_folders(spark, small, tmp_path):
    v = spark.read.parquet(f"{small}/embeddings.parquet")
    path = f"file://{tmp_path}/ivf"
    V.ivf_index(v, path, cells=20)
    q = v.where("vec_id % 10 = 0")
    exact = V.knn(v, q)
    assert V.recall(V.ivf_search(spark, path, q, num_candidates=400), exact).first()["recall"] >= 0.9
    everything = V.ivf_search(spark, path, q, num_candidates=10**6)
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, exact.collect()))
    one = V.ivf_search(spark, path, v.where("vec_id = 7"), num_candidates=1)
    cells = spark.read.parquet(f"{path}/centroids").count()
    read = re.search(r"PartitionFilters: \[(.*?)\]", plan(one))[1]
    assert "cell" in read and read.count(",") < cells / 2
    assert spark.read.parquet(f"{path}/lists").count() == v.count()


def test_neighbours_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0]), (6, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in V.knn(v, v.where("vec_id in (1, 3, 4)"), k=2).orderBy("rank").collect()]
    assert got == [(1, 2, 1.0, 1), (1, 6, 1.0, 2)]
    assert V.knn(v, v.limit(0)).count() == 0
    blocks = [sorted(map(tuple, V.knn(v, v, block_bytes=b).collect())) for b in (1 << 20, 16)]
    assert blocks[0] == blocks[1]


def test_candidates_follow_the_data(spark, tmp_path):
    """Vectors in clusters need a small part of all candidates for the same recall; the index measures it."""
    rng = random.Random(1)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in middles[i % 20]]) for i in range(2000)]
    v, path = spark.createDataFrame(rows, "vec_id long, embedding array<float>"), f"file://{tmp_path}/clusters"
    V.ivf_index(v, path, cells=40)
    assert spark.read.parquet(f"{path}/tuned").first()["candidates"] < 500
    q = v.where("vec_id % 7 = 3")
    assert V.recall(V.ivf_search(spark, path, q), V.knn(v, q)).first()["recall"] >= 0.9


def test_empty_cells(spark, tmp_path):
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    V.ivf_index(v, f"file://{tmp_path}/none")
    assert V.ivf_search(spark, f"file://{tmp_path}/none", v).count() == 0


# Text index


def test_stored_index_moves_no_postings(spark, small, tmp_path):
    path = f"file://{tmp_path}/text"
    sinks.text_index(spark.read.parquet(f"{small}/documents.parquet"), path, buckets=16)
    items = spark.read.parquet(f"{small}/benchmark.parquet").limit(1)
    found = R.bm25(sinks.open_text_index(spark, path), items, id_col="item_id")
    text = plan(found)
    over = above(text, r"FileScan parquet \[doc_id#\d+L?,dl#")
    until = next(i for i, x in enumerate(over) if x.startswith("HashAggregate(keys=[query_id"))
    assert any(x.startswith("BroadcastHashJoin") for x in over[:until])
    assert not any("Exchange" in x for x in over[:until])
    assert re.search(r"PartitionFilters: \[.*bucket", text)
    assert found.count() == 10


def test_corpus_and_indexes_rank_alike(spark, small, tmp_path):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    stored = sinks.text_index(docs, f"file://{tmp_path}/text2", buckets=4)
    ranked = [sorted(map(tuple, R.bm25(x, items, id_col="item_id").collect())) for x in (R.Corpus(docs), R.index_text(docs), stored)]
    assert ranked[0] == ranked[1] == ranked[2]


def test_claims(spark):
    references = spark.createDataFrame([(1, "The cat sat on the mat. Dogs bark! Yes"), (2, ""), (3, None), (4, "one two three four five six")], "query_id long, text string")
    contexts = spark.createDataFrame([(1, 1, "I saw that the cat sat on a mat"), (1, 2, "yes we know dogs that bark"), (4, 1, "one two three and four five six")], "query_id long, rank int, text string")
    got = sorted(tuple(r) for r in R.attributed_claims(R.claims_of(references), contexts).collect())
    assert got == [(1, 0, 6, 4, 1), (1, 1, 2, 0, 0), (1, 2, 1, 1, 1), (4, 0, 6, 3, 0)]


# Arrays in one file


VALUES = [{"a": 'quote " and \\ back\\\\', "b": [1, {"c": "]}[{"}]}, {}, {"a": "\\"}, {"a": "é日本", "b": None}, {"data": [{"x": 1}, {"x": 2}]}, {"a": ",,,[", "b": [[], [[]]]}]


@pytest.mark.parametrize("size", [2, 7, 50, 1000])
def test_any_cut_gives_each_element_once(spark, tmp_path, size):
    for k, text in enumerate((json.dumps(VALUES), json.dumps(VALUES, indent=2, ensure_ascii=False), " [ ] ", "[{}]")):
        (tmp_path / f"f{k}.json").write_text(text, encoding="utf-8")
        got = [json.loads(r["text"]) for r in arrays.elements(spark, f"file://{tmp_path}/f{k}.json", range_bytes=size).orderBy("at").collect()]
        assert got == json.loads(text), (k, size)


@pytest.mark.parametrize("size", [5, 64])
def test_wrapped_lists(spark, tmp_path, size):
    whole = {"note": {"data": [0]}, "samples": ["]", 1], "items": VALUES, "after": [[[]], "x"], "examples": []}
    (tmp_path / "w.json").write_text(json.dumps(whole))
    got = [json.loads(r["text"]) for r in arrays.elements(spark, str(tmp_path / "w.json"), True, size).orderBy("at").collect()]
    assert got == VALUES


def test_arrays_that_are_none(spark, tmp_path):
    for text in ('{"a": [1]}', '[{"a": 1}', '{"data": 1}', '["a]'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(Exception, match="list|close"):
            arrays.elements(spark, str(tmp_path / "bad.json"), True, 4).collect()
    (tmp_path / "bad.json").write_text("[1, 2]")
    with pytest.raises(Exception, match="not a JSON object"):
        arrays.rows(spark, str(tmp_path / "bad.json"), T.StructType([T.StructField("a", T.LongType())])).collect()


def test_one_file_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.json").write_text(json.dumps([{"k": i, "t": "[" * (i % 50)} for i in range(3000)]))
    df = arrays.rows(spark, str(tmp_path / "big.json"), T.StructType([T.StructField("k", T.LongType())]), range_bytes=8192)
    assert sorted(r[0] for r in df.collect()) == list(range(3000))
    assert df.rdd.getNumPartitions() > 8


# Tables upserted in place


def files(path):
    return {p.name: p.stat().st_mtime_ns for p in Path(path).glob("bucket=*/*.parquet")}


def test_other_buckets_keep_their_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    keyed.create(spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v")), path, "k", 16)
    before = files(tmp_path / "t")
    new = spark.createDataFrame([(7, "x", 1), (7, "new", 2), (500, "put in", 1), (None, "no key", 1)], "k long, v string, seq int")
    changed = keyed.upsert(new, path, "k", "seq", buckets=16)
    after = files(tmp_path / "t")
    assert 1 <= len(changed) <= 2
    kept = {f for f in before if f in after and before[f] == after[f]}
    assert len(kept) >= len(before) - len(changed)
    got = {r["k"]: r["v"] for r in keyed.read(spark, path).collect()}
    assert got == {k: "new" if k == 7 else "old" for k in range(200)} | {500: "put in"}


def test_stopped_upsert_is_finished(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    keyed.create(spark.range(50).select(F.col("id").alias("k"), F.lit("old").alias("v")), path, "k", 8)
    new = spark.createDataFrame([(3, "new", 1)], "k long, v string, seq int")
    with monkeypatch.context() as m:
        m.setattr(keyed, "_apply", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            keyed.upsert(new, path, "k", "seq", buckets=8)
    assert keyed.read(spark, path).where("v = 'new'").count() == 0
    keyed.recover(spark, path)
    assert [tuple(r) for r in keyed.read(spark, path).where("v = 'new'").collect()] == [(3, "new")]
    assert keyed.read(spark, path).count() == 50


# Rounds of generation


def rounds(spark, calls):
    def propose(k):
        calls.append(k)
        return spark.range(20).select(F.col("id").alias("place"), (F.col("id") % (5 * (k + 1))).cast("string").alias("word"))

    return propose


def test_exactly_n_and_the_same_after_a_restart(spark, tmp_path):
    calls = []
    whole = G.generate_until(spark, f"file://{tmp_path}/a", 13, rounds(spark, calls), F.col("word"), "place").collect()
    assert calls == [0, 1, 2] and len({r["word"] for r in whole}) == 13 == len(whole)

    def stopping(k):
        if k == 2:
            raise KeyboardInterrupt
        return rounds(spark, [])(k)

    with pytest.raises(KeyboardInterrupt):
        G.generate_until(spark, f"file://{tmp_path}/b", 13, stopping, F.col("word"), "place")
    part = tmp_path / "b" / "round=2"  # what a killed write leaves
    part.mkdir()
    (part / "part-0.parquet").write_bytes(b"broken")
    calls = []
    again = G.generate_until(spark, f"file://{tmp_path}/b", 13, rounds(spark, calls), F.col("word"), "place").collect()
    assert calls == [2] and sorted(map(tuple, again)) == sorted(map(tuple, whole))


def test_too_few(spark, tmp_path):
    with pytest.raises(G.TooFew):
        G.generate_until(spark, f"file://{tmp_path}/c", 13, lambda k: spark.range(4).select(F.col("id").alias("place"), F.lit("w").alias("word")), F.col("word"), "place", patience=2)


# Draws and positions


def test_draws_are_independent(spark):
    draws, seeds = spark.range(4000).withColumnRenamed("id", "d"), spark.range(10).withColumnRenamed("id", "s")
    got = {}
    for r in N.few_shot(draws, seeds, "d", "s", 3).collect():
        got.setdefault(r["d"], []).append(r["s"])
    assert len(got) == 4000 and all(len(set(x)) == 3 for x in got.values())
    pairs = Counter(p for x in got.values() for p in combinations(sorted(x), 2))
    expected = 4000 * 3 / 45  # each pair of ten seeds alike often
    assert len(pairs) == 45
    assert sum((n - expected) ** 2 / expected for n in pairs.values()) < 90  # chi-square, 44 degrees: 78.7 at 0.1 %
    few = N.few_shot(draws.limit(3), seeds.limit(2), "d", "s", 4)
    assert few.count() == 6 and few.groupBy("d").agg(F.count_distinct("s").alias("n")).where("n <> 2").count() == 0


def test_positions_without_one_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("g"))
    got = O.numbered(df, ["v"])
    assert "SinglePartition" not in plan(got) and "Window" not in plan(got)
    assert sorted((r["v"], r["position"]) for r in got.collect()) == [(i, i) for i in range(1000)]
    by = {}
    for r in O.numbered(df, ["v"], ["g"], total="n").collect():
        by.setdefault(r["g"], []).append((r["v"], r["position"], r["n"]))
    assert set(by) == {None, 0, 1}
    for x in by.values():
        x.sort()
        assert [p for _, p, _ in x] == list(range(len(x))) and {n for *_, n in x} == {len(x)}
    assert O.numbered(df.limit(0), ["v"]).count() == 0


# Providers


@pytest.mark.parametrize("tasks", [1, 4])
def test_rate_of_the_whole_job(spark, tasks):
    df = spark.range(40).select(F.col("id").cast("string").alias("p")).repartition(8)

    def timed(prompts):
        return [repr(time.time())] * len(prompts)

    rows = M.generate(df, "p", lambda: timed, batch=2, pace=M.Pace(20, tasks))
    times = sorted({float(r["output"]) for r in rows.collect()})
    assert 20 <= len(times) <= 24 and times[-1] - times[0] >= (len(times) - 2 * tasks) / 20 * 0.9
    assert max(sum(t <= x < t + 1 for x in times) for t in times) <= 20 + tasks


def test_only_failed_prompts_are_asked_again():
    asked = []

    class Some:
        def __call__(self, prompts):
            raise AssertionError

        def each(self, prompts):
            asked.append(list(prompts))
            return [ValueError("no") if p == "bad" and len(asked) < 3 else p.upper() for p in prompts]

    texts, errors = M.call_with_retry(Some(), ["a", "bad", "c"], M.Retry(3, 1.0), lambda s: None)
    assert texts == ["A", "BAD", "C"] and errors == [None] * 3 and asked == [["a", "bad", "c"], ["bad"], ["bad"]]
    texts, errors = M.call_with_retry(Some(), ["bad"], M.Retry(1, 1.0), lambda s: None)
    assert texts == ["BAD"] and errors == [None]


def test_counts_of_a_tokenizer(spark, small):
    tokenizers, files = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = files.path("byte_bpe_50k.json")
    tokenizer = tokenizers.Tokenizer.from_file(path)
    rows = spark.read.parquet(f"{small}/benchmark.parquet").unionAll(spark.createDataFrame([(-1, ""), (-2, None), (-3, "日本 \n x")], "item_id long, text string"))
    for r in rows.select("text", M.tokenizer_counts(path, 7)(F.col("text")).alias("n")).collect():
        assert r["n"] == len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)


def test_cached_by_plan_and_parameters(spark, tmp_path):
    df, other = spark.range(5).where("id < 3"), spark.range(5).where("id < 4")
    path = str(tmp_path / "cache")
    assert sinks.cached(df, path, k=1).count() == 3
    assert sinks.cached(other, path, k=1).count() == 4
    assert sinks.cached(spark.range(5).where("id < 3"), path, k=2).count() == 3
    assert len(list((tmp_path / "cache").iterdir())) == 3
    sinks.cached(spark.range(5).where("id < 3"), path, k=1)
    assert len(list((tmp_path / "cache").iterdir())) == 3


def test_running_sums(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("p"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("v"))
    rows = sorted((r["p"], r["v"] or 0, r["s"]) for r in O.running_sums(df, ["p"], {"s": "v"}).collect())
    total = 0
    for _, v, s in rows:
        total += v
        assert s == total


# Splitter


def test_fold_equals_plain_splitter(spark):
    rng = random.Random(5)
    signs = ["\n\n", "\n", "。", "！", "？", "；", "，", " ", "a", "bcd", "é日", "\t", "𝄞"]
    texts = ["".join(rng.choices(signs, [1, 2, 2, 1, 1, 1, 2, 6, 8, 8, 4, 1, 1], k=rng.randint(0, 200))) for _ in range(60)] + ["", "x" * 95, "\n\n\n" * 20, " " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(4)
    for cfg in (ChunkConfig(size=30, overlap=8), ChunkConfig(size=10, overlap=0), ChunkConfig(size=25, overlap=20, separators=("\n", " ", ""))):
        got = {r["id"]: r["c"] for r in df.select("id", C.recursive_chunks(F.col("t"), cfg).alias("c")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == (split_recursive(t, cfg) if len(t) >= cfg.size else [t.strip()] if t.strip() else []), (cfg, t)
    assert "Python" not in plan(df.select(C.recursive_chunks(F.col("t"), ChunkConfig())))


# Streams


def test_streams_equal_tables(spark, small, tmp_path):
    from quarry.operators.corpus import first_wins
    from quarry.streaming.state import first_of_keys, running_rates

    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", "user_id", "event_type").where("event_id < 300")
    schema = events.schema

    def run(make, name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        make(stream).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    make = {"first": lambda s: first_of_keys(s, "user_id", "event_id"), "rate": lambda s: running_rates(s, F.col("event_type") == "click", "event_id", "user_id")}
    for k in range(3):  # three batches; each run begins anew from its checkpoint
        events.where((F.col("event_id") >= 100 * k) & (F.col("event_id") < 100 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for name, f in make.items():
            run(f, name)
    got = {name: sorted(map(str, spark.read.parquet(str(tmp_path / name)).select(*cols).collect())) for name, cols in (("first", ["user_id", "event_id"]), ("rate", ["user_id", "event_id", "seen", "rate"]))}
    first = first_wins(events.where("user_id is not null"), F.col("user_id"), F.col("event_id")).select("user_id", "event_id")
    rate = E.running_rate(events, F.col("event_type") == "click", "event_id", "user_id").select("user_id", "event_id", "seen", "rate")
    assert got["first"] == sorted(map(str, first.collect()))
    assert got["rate"] == sorted(map(str, rate.collect()))


def test_streams_take_groups_of_keys(spark, tmp_path, monkeypatch):
    """Python is called for groups of keys, however many keys a batch has; rows without a key are ordered like those of any other."""
    from quarry.operators.corpus import first_wins
    from quarry.streaming import state

    for c in (state._First, state._Rate):

        def counted(self, key, rows, timers, plain=c.handleInputRows, calls=str(tmp_path / c.__name__)):
            with open(calls, "a") as f:
                f.write("x\n")
            return plain(self, key, rows, timers)

        monkeypatch.setattr(c, "handleInputRows", counted)
    rng = random.Random(8)
    rows = [(i, rng.choice([None, *range(1500)]) if i % 9 else None, rng.choice(["click", "view"])) for i in range(8000)]
    schema = "event_id long, user_id long, event_type string"
    make = {"_First": lambda s: state.first_of_keys(s, "user_id", "event_id"), "_Rate": lambda s: state.running_rates(s, F.col("event_type") == "click", "event_id", "user_id")}
    for part in (rows[:4000], rows[4000:]):
        spark.createDataFrame(rng.sample(part, len(part)), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for name, f in make.items():
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            f(stream).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    events = spark.createDataFrame(rows, schema)
    want = {"_First": first_wins(events.where("user_id is not null"), F.col("user_id"), F.col("event_id")), "_Rate": E.running_rate(events, F.col("event_type") == "click", "event_id", "user_id")}
    for name, df in want.items():
        got = spark.read.parquet(str(tmp_path / f"{name}-out"))
        assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, df.select(sorted(got.columns)).collect()))
        assert len((tmp_path / name).read_text().split()) <= 2 * 256  # a batch has about 1,400 keys


def test_streamed_parts_are_written_by_many_tasks(spark, tmp_path, monkeypatch, small):
    """each part of the events is written by the tasks that read it, and is one batch all the same."""
    from quarry.plans import more

    monkeypatch.setattr(more, "_folder", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(more, "table", lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(4))
    got = more.streamed_rates(spark, small)
    assert len(list((tmp_path / "stream-in").glob("*.parquet"))) == 12
    events = spark.read.parquet(f"{small}/events.parquet")
    want = E.running_rate(events, F.col("event_type") == "click", "event_id", "user_id").select("user_id", "event_id", "seen", F.round("rate", 9).alias("rate"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def _plain_bm25(docs, queries, k, k1=1.2, b=0.75):
    """Rows of one id and length are one document, as in the SQL of bm25_top10."""
    toks = [(i, t.lower().split()) for i, t in docs if t and t.split()]
    n, avg = len(toks), sum(len(t) for _, t in toks) / len(toks)
    tf = Counter((i, len(t), w) for i, t in toks for w in t)
    df = Counter(w for _, _, w in tf)
    out = []
    for q, text in queries:
        score, asked = {}, Counter(text.lower().split())
        for (i, dl, w), f in tf.items():
            if w in asked:
                score[i] = score.get(i, 0) + asked[w] * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f / (f + k1 * (1 - b + b * dl / avg))
        ranked = sorted((-round(s, 6), i) for i, s in score.items())[:k]
        out += [(q, i, -s, r) for r, (s, i) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("repeated", [False, True])
def test_ranking_document_by_document(spark, tmp_path, monkeypatch, repeated):
    """F4 to F16: blocks of documents and of queries, ties between copies, text ids, blank texts and repeated ids; each source sends k rows a query and task."""
    monkeypatch.setattr(R, "SCORE_BYTES", 2048)
    monkeypatch.setattr(R, "SHARED", 0)
    monkeypatch.setattr(R, "TASK_POSTINGS", 500)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(f"d{i % 90 if repeated else i:04d}", " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(300)]
    docs += [("e1", None), ("e2", ""), *((f"c{i:03d}", "w1 w2 w3 w3") for i in range(50))]
    queries = [(i, " ".join(rng.choices([*words, "absent"], k=6))) for i in range(25)]
    d, q = spark.createDataFrame(docs, "doc_id string, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")
    want = _plain_bm25(docs, queries, 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        for source in (R.Corpus(d), R.index_text(d), sinks.text_index(d, f"file://{tmp_path}/i", buckets=4)):
            got = sorted(map(tuple, R.bm25(source, q, k=7).collect()))
            assert [(a, b, r) for a, b, _, r in got] == [(a, b, r) for a, b, _, r in want]
            assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(got, want, strict=True))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = R._by_document(R.Corpus(d), q.select("query_id", F.explode(F.split("text", " ")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")), q.select("query_id", F.explode(F.split("text", " ")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")).toArrow(), RetrievalConfig(), 7)
    assert best.groupBy(F.spark_partition_id(), "query_id").count().where("count > 7").isEmpty()


def test_cells_in_bounded_parts(monkeypatch):
    """a batch of vectors is taken in parts, so that neither the matrix of vectors by cells nor the copies for each probed cell follow the batch."""
    b = pa.RecordBatch.from_arrays([pa.array(range(1000))], ["id"])
    parts = list(V._few(iter([b]), 4096))
    assert sum(p.num_rows for p in parts) == 1000 and max(p.num_rows for p in parts) * 4096 <= V.PLACES
    assert [v for p in parts for v in p.column("id").to_pylist()] == list(range(1000))


def test_index_is_made_by_one_shuffle_of_postings(spark):
    """terms are counted inside a document; repeated ids of one length still make one posting."""
    docs = spark.createDataFrame([(1, "b a b c a b"), (1, "a a a x y z"), (2, "a"), (3, "")], "doc_id long, text string")
    got = R.placed_postings(R.counted_terms(R.tokenised(docs)), 4)
    assert sorted(tuple(r) for r in got.select("doc_id", "dl", "term", "tf").collect()) == [(1, 6, "a", 5), (1, 6, "b", 3), (1, 6, "c", 1), (1, 6, "x", 1), (1, 6, "y", 1), (1, 6, "z", 1), (2, 1, "a", 1)]
    assert len(re.findall(r"\bExchange ", plan(got).split("Initial Plan")[-1])) == 1
