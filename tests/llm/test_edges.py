"""Null, empty, long, tied and repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontaminate, fingerprint, html, langid, lines, packing, quality, similar, simhash, toxicity, warc

PARA = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
EDGES = [
    (1, "The cat sat on the mat. It was a good day for all of them."),
    (1, "The cat sat on the mat. It was a good day for all of them."),  # repeated row
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (None, "no id here, but a text"),
    (5, "!!! ... 123"),
    (6, " ".join(f"w{i % 977}" for i in range(60_000))),  # long
    (7, f"{PARA}\n{PARA}\n{PARA}"),
    (8, f"start of another\n{PARA}\n{PARA}\n{PARA}\nend"),
    (9, "the\r\ncat"),
    (10, "日本語のテキスト と русский текст"),
]
EXTRA = ["id", "fp", "_id", "text_hash", "_text_hash", "_text", "label", "n", "mark", "rest", "runs", "_runs", "score", "key", "_at", "row_id", "spans"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "src0", len(t) if t else 0) for i, t in EDGES], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(k) for k, c in enumerate(EXTRA)}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 1, 0), (8, 0, 1), (8, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PARA), (2, "The cat sat"), (3, None), (4, ""), (None, "good day"), (1, PARA)], "item_id long, text string")


N = len(EDGES)


def operators(spark, docs, labels, items):
    model = langid.fit(docs)
    return {
        "toxicity": toxicity.predict(docs, toxicity.fit(docs, labels)),
        "decontaminate": decontaminate.find(docs, items),
        "fingerprint": fingerprint.fingerprint_documents(docs),
        "simhash": simhash.near_duplicates(docs),
        "quality": quality.predict(docs, quality.fit(docs, labels)),
        "langid": langid.predict(docs, model, spans=True),
        "lines": lines.remove(docs, keep_empty=True),
        "html": html.extract(docs, "doc_id", "text"),
    }


def test_a_row_for_each_row(spark, docs, labels, items):
    for name, df in operators(spark, docs, labels, items).items():
        assert df.count() == N, name


def test_empty_tables(spark, docs, labels, items):
    none = docs.limit(0)
    for name, df in operators(spark, none, labels.limit(0), items.limit(0)).items():
        assert df.count() == 0, name
    assert decontaminate.find(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert packing.pack(none, corpus_pipeline.TOKENIZER).count() == 0


def test_no_labels(spark, docs, labels):
    got = toxicity.predict(docs, toxicity.fit(docs, labels.limit(0)))
    assert got.where("score >= 0.7").count() == 0
    assert quality.predict(docs, quality.fit(docs, labels.limit(0))).where("score is null").count() == 0
    assert langid.predict(docs, langid.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_undetermined(spark, docs):
    got = {r.doc_id: r for r in langid.predict(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), langid.fit(docs)).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {2, 3, 4, 5}
    assert all(0 <= r.score <= 1 for r in got.values())


def test_fingerprints(spark, docs):
    rows = fingerprint.fingerprint_documents(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == by[3].fingerprint
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert by[2].near_next == 1.0  # both empty


def test_packing(spark, docs):
    rows = packing.pack(docs, corpus_pipeline.TOKENIZER).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    empty = [r for r in rows if r.doc_id == 2]
    assert [(r.length, r.ids) for r in empty] == [(1, [1])]


def test_warc(spark, docs, tmp_path):
    assert warc.write(docs, f"file://{tmp_path}/a", "doc_id", None, "text") == N
    got = warc.read(spark, f"file://{tmp_path}/a", range_bytes=777).collect()
    assert len(got) == N
    assert sum(r.payload_bytes for r in got) == sum(len((t or "").encode()) for _, t in EDGES)
    assert warc.write(docs.limit(0), f"file://{tmp_path}/b", "doc_id", None, "text") == 0
    assert warc.read(spark, f"file://{tmp_path}/b").count() == 0


def test_stages(spark, docs, items, tmp_path):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        for df in (now, now.limit(0)):
            out = stage(spark, df, str(tmp_path))
            if name != "packing":
                assert out.columns == df.columns, name
            n = out.count()
            assert n <= df.count() or name == "packing", name
        now = stage(spark, now, str(tmp_path)).cache()
        if name != "packing":
            assert now.where("text is not null and n_chars <> length(text) and length(text) < 1000").count() == 0, name
    assert now.where("doc_id is null").count() >= 1  # a row without id is kept like any other


def test_simhash_links_fingerprints_not_ids(spark):
    a, b, c = "one two three four five six seven", "alpha beta gamma delta epsilon zeta eta", "red green blue white black brown grey"
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (None, c), (None, b), (7, c)], "doc_id long, text string")
    got = sorted((r.id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(simhash.NO_ID, 1), (simhash.NO_ID, 7), (1, 1), (1, 1), (2, 1), (3, 1), (7, 7)]
    groups = {frozenset(r.ids) for r in simhash.near_duplicates(docs).groupBy("component").agg(F.collect_list("id").alias("ids")).collect()}
    assert len(groups) == 3
    assert simhash.keep_one(docs).count() == 3


def test_quality_takes_integer_and_text_ids(spark):
    for kind in ("int", "string"):
        rows = spark.createDataFrame([(k, "a fine text with many words here " * 9 if k % 2 else "x x x x") for k in range(40)], "doc_id int, text string")
        docs = rows.withColumn("doc_id", F.col("doc_id").cast(kind))
        labels = docs.select("doc_id", (F.length("text") > 20).cast("int").alias("quality"))
        got = {r.doc_id: r.score for r in quality.predict(docs, quality.fit(docs, labels)).collect()}
        assert len(got) == 40 and got[type(next(iter(got)))(1)] > got[type(next(iter(got)))(2)]
        assert got[type(next(iter(got)))(2)] == got[type(next(iter(got)))(4)]  # ties


def test_number_signs_are_no_letters(spark):
    assert langid.words_of("² ½ ① Ⅷ 12 _ x²y") == ["x", "y"]
    model = langid.fit(spark.createDataFrame([(1, "the house", "en")], "doc_id long, text string, lang string"))
    assert langid.label(model, "² ½ ①")[0] == "und"


def test_ids_of_other_types(spark, docs):
    """Text ids give what the integers of the same order give; the count columns must not clash."""
    some = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text")
    named = some.withColumn("doc_id", F.format_string("d%03d", "doc_id"))
    number = lambda c: F.substring(c, 2, 9).cast("long")
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(lines.remove(some, keep_empty=True)) == plain(lines.remove(named, keep_empty=True).withColumn("doc_id", number("doc_id")))
    assert plain(simhash.keep_one(some)) == plain(simhash.keep_one(named).withColumn("doc_id", number("doc_id")))
    assert plain(similar.keep_one(some)) == plain(similar.keep_one(named).withColumn("doc_id", number("doc_id")))
    assert plain(fingerprint.fingerprint_documents(some)) == plain(fingerprint.fingerprint_documents(named).withColumn("doc_id", number("doc_id")))
    found = simhash.near_duplicates(named).select(number("id").alias("id"), number("component_id").alias("component_id"))
    assert plain(simhash.near_duplicates(some).select("id", "component_id")) == plain(found)
    with pytest.raises(ValueError, match="n_lines"):
        lines.remove(some.withColumn("N_Lines", F.lit(1)), counts=("n_lines", "n_removed"))
