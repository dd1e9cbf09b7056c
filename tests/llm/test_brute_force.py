"""Operators against plain versions on small inputs."""

import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import decontaminate, fingerprint, graph, html, langid, lines, packing, quality, queries, simhash, toxicity, warc


def table(spark, small, name):
    return spark.read.parquet(f"{small}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, small, name):
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, small)
    got = sorted(map(str, (tuple(r) for r in df.collect())))
    result = con.execute(queries.oracle_sql()[name])
    at = [[c[0] for c in result.description].index(c) for c in df.columns]
    assert got == sorted(str(tuple(r[i] for i in at)) for r in result.fetchall())


def plain_hits(words, items, window):
    hit, found = [False] * len(words), set()
    for item, seq in items:
        n = min(window, len(seq))
        grams = {tuple(seq[i : i + n]) for i in range(len(seq) - n + 1)} if seq else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in grams:
                found.add(item)
                hit[i : i + n] = [True] * n
    return hit, found


def test_automaton():
    rng = random.Random(3)
    for _ in range(300):
        word = lambda: rng.choice([b"a", b"b", b"c"])  # noqa: E731, B023
        items = [(k, [word() for _ in range(rng.randint(0, 9))]) for k in range(4)]
        words = [rng.choice([b"a", b"b", b"c", b"z"]) for _ in range(rng.randint(0, 60))]
        spans, found = decontaminate.ItemAutomaton(items, 4).hits(words)
        hit, want = plain_hits(words, items, 4)
        got = [False] * len(words)
        for s, e in spans:
            got[s:e] = [True] * (e - s)
        assert (got, found) == (hit, want)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_decontamination_cuts(spark, small):
    bench = table(spark, small, "benchmark")
    item = bench.first().text
    own = " ".join(f"own{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"kept before. {item} {own} kept after."), (2, item), (3, "clean text here")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.remove(docs, bench).collect()}
    assert set(got) == {1, 3}
    assert got[1].startswith("kept before.")
    assert got[1].rstrip(".").endswith("kept after")
    assert decontaminate.find(spark.createDataFrame(list(got.items()), "doc_id long, text string"), bench).where("n_hit > 0").count() == 0


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    parent = {i: i for i, _ in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(fps):
        for j, b in fps[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in fps}


def test_simhash(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text").toPandas()
    want = {i: plain_simhash(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    got = queries.op8_simhash(spark, small).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == want
    assert {r.doc_id: r.component_id for r in got} == plain_components(sorted(want.items()))


def test_crowded_buckets(spark, monkeypatch):
    """Buckets above the direct limit go to the second level and lose no link."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(60)})
    rows = [(i, fp) for i, fp in enumerate(fps)]
    monkeypatch.setattr(simhash, "SPLIT", 8)
    df = spark.createDataFrame([(i, simhash._signed(f)) for i, f in rows], "id long, fp long")
    found = {r.node: r.component for r in graph.components(simhash.links(df)).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == plain_components(rows)


def test_dense_groups():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    same = lambda groups: sorted(sorted(g.tolist()) for g in groups)
    assert same(simhash.close_groups(fps)) == same(simhash.close_groups_dense(fps, list(range(12))))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {x: root(x) for e in edges for x in e if e[0] != e[1]}
    assert {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_fingerprint_algebra(spark):
    texts = [("ab", "x y z. q\nsecond paragraph here"), ("ba", "second paragraph here\nx y z. q"), ("a", "x y z. q"), ("b", "second paragraph here"), ("c", "x y z q\nsecond paragraph here")]
    fps = {r.k: r.fp for r in fingerprint.fingerprints(spark.createDataFrame(texts, "k string, t string"), ["k"], "t").collect()}
    assert fps["ab"] == fps["ba"] != fps["c"]
    df = spark.createDataFrame([(fps["a"], fps["b"], fps["ab"])], "a array<int>, b array<int>, ab array<int>")
    r = df.select(fingerprint.combine(F.col("a"), F.col("b")).alias("sum"), fingerprint.combine(F.col("ab"), F.col("b"), -1).alias("rest"), fingerprint.likeness(F.col("a"), F.col("a")).alias("one"), fingerprint.likeness(F.col("ab"), F.col("a")).alias("part")).first()
    assert (r["sum"], r["rest"], r["one"]) == (fps["ab"], fps["a"], 1.0)
    assert 0.1 < r["part"] < 0.9


def test_edited_texts(spark, small):
    docs = table(spark, small, "documents").toPandas().sort_values("doc_id")
    got = {r.doc_id: r for r in queries.op7_fingerprint(spark, small).collect()}
    texts, ids = docs.text.tolist(), docs.doc_id.tolist()
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        half, after = len(t) // 2, texts[(k + 1) % len(texts)]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert (got[i].near_next == 1.0) == (t == after)
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * len(got)


def test_passages_are_found_once(spark):
    rng = random.Random(9)
    line = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    passage = [line(20), line(25), line(15)]
    rows = [(i, "\n".join([line(9), line(30), *(passage if i % 3 == 0 else []), line(40)])) for i in range(30)]
    rows.append((100, "\n".join([line(60)] + rows[1][1].split("\n")[:1])))
    rows.append((101, rows[2][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lines.remove(docs, keep_empty=True, counts=("n_lines", "n_removed")).collect()}
    for i, t in rows:
        want = t if i in (0, 100) or i < 30 and i % 3 else "\n".join(x for x in t.split("\n") if x not in passage) if i < 30 else ""
        assert got[i].text == want, i
    assert 101 not in {r.doc_id for r in lines.remove(docs).collect()}


def test_selection_is_guaranteed():
    """Any run of WINDOW words that two documents share has a selected gram in both."""
    rng = random.Random(4)
    for _ in range(100):
        line = lambda: " ".join(str(rng.randrange(10**9)) for _ in range(rng.randint(1, 30)))  # noqa: E731, B023
        shared = [line() for _ in range(12)]
        total, run = 0, []
        for x in shared:
            run.append(x)
            total += len(x.split())
            if total >= lines.WINDOW:
                break
        a, b = ([*(line() for _ in range(rng.randint(0, 4))), *run, *(line() for _ in range(rng.randint(0, 4)))] for _ in range(2))
        assert {g[0] for g in lines.selected(a)[1]} & {g[0] for g in lines.selected(b)[1]}


def test_packing(spark, small):
    tok = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    docs = table(spark, small, "documents").toPandas()
    ids = {i: tok.encode(t, add_special_tokens=False).ids + [1] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    rows = queries.op5_packing(spark, small).collect()
    pieces, sequences = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(np.array(part, "<u4").tobytes()))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, whole in [(p, len(ids[i])) for i, p in pieces.items()] + [(p, None) for p in sequences.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        if whole is None:
            assert at == 2048 or at & (at - 1) == 0  # no padding at all
        else:
            assert at == whole
    assert set(pieces) == set(ids)


def test_encoder_is_exact():
    made = packing.Encoder(corpus_pipeline.TOKENIZER)
    rng = random.Random(5)
    letters = ["a", "B", " ", "  ", "\n", ".", "'", "s", "1", "é", "\t", " ", "!", "中", "'s", "²", "-", "\x1c", "|", "x.\ny", " z"]
    texts = ["", None, " ", "<|endoftext|> hi", "it's don't", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(3000))]
    for text, data in zip(texts, made.encode(texts), strict=True):
        assert np.frombuffer(data, made.kind).tolist() == made.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_plan_gives_each_rank_one_place():
    rng = random.Random(8)
    counts = {rng.randrange(64): rng.randrange(1, 30) for _ in range(40)}
    plan = packing.Plan(counts, 64)
    seen = {}
    for n, k in counts.items():
        for rank in range(k if n else 0):
            assert sum(m for _, m, _, _ in plan.pieces(n, rank)) == n
            for _, m, seq, off in plan.pieces(n, rank):
                seen.setdefault(seq, []).append((off, m))
    for parts in seen.values():
        at = 0
        for off, m in sorted(parts):
            assert off == at
            at += m
        assert at == 64 or at & (at - 1) == 0


def test_ranges_own_records(tmp_path):
    rng = random.Random(6)
    inner = warc.member(warc.record(99, None, "0" * 64, 3, b"abc"))
    bodies = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 900))) + (inner if k % 5 == 0 else b"") + warc.MAGIC * (k % 3) for k in range(40)]
    data = b"".join(warc.member(warc.record(k, "http://x/", hashlib.sha256(b).hexdigest(), len(b), b)) for k, b in enumerate(bodies))
    f = tmp_path / "a.gz"
    f.write_bytes(data)
    fs, path = warc.open_fs(str(f))
    for step in (100, 1009, len(data)):
        got = []
        with fs.open_input_file(path) as source:
            for start in range(0, len(data), step):
                got += [warc._row(r) for m in warc.records_in(source, start, min(start + step, len(data)), len(data)) for r in warc.parse(m)]
        assert [r[3] for r in got] == [str(k) for k in range(40)]
        assert [r[-1] for r in got] == bodies


def test_shared_payloads(spark, tmp_path):
    rows = [(i, "u", "same " * 40 if i % 2 else f"own {i} " * 20) for i in range(20)] + [(50 + i, "u", "tiny") for i in range(3)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {int(r.page_id): (r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert all(got[i] == (("revisit", "1") if i % 2 and i > 1 else ("response", None)) for i, _, _ in rows if i < 50)
    assert all(got[50 + i] == ("response", None) for i in range(3))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>one<p>two <b>bold</b><br>next", "one\n\ntwo bold\nnext"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n    - c"),
        ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
        ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>", "Name       N\nlong name  1"),
        ("<div hidden>x</div><p style='display: none'>y</p><script>'</p>'</script>z", "z"),
        ("<title>t</title><pre> a\n  b</pre>", " a\n  b"),
        ("a<!-- no -- > --><i>b</i>&amp;&lt;c", "ab&<c"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("", ""), ("<", "<"), ("<p", ""), ("a < b", "a < b"), ("<!-- open", ""), (None, None),
    ],
)
def test_layout(source, want):
    assert html.to_text(source) == want


def test_all_visible_words(spark, small):
    import re
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    bare = lambda t: re.sub(r"\s|^\d+\. |(?<=\n)- |^- ", "", t).replace("-", "")
    pages = {r.page_id: r.html for r in table(spark, small, "pages").collect()}
    for r in queries.op4_html(spark, small).collect():
        p = Words()
        p.feed(pages[r.page_id])
        p.close()
        assert bare(r.text) == bare("".join(p.out)), r.page_id


def test_deep_nesting_is_linear():
    assert html.to_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert html.to_text("<table><tr><td>" * 500 + "x").strip() == "x"


def test_viterbi_shortcut_changes_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = np.minimum(0, rng.normal(-1, 2, (rng.integers(1, 40), 3)))
        best, n = None, len(s)
        score = s[0].copy()
        back = []
        for row in s[1:]:
            step = score[:, None] - langid.SWITCH * (1 - np.eye(3))
            back.append(step.argmax(0))
            score = step.max(0) + row
        best = score.max()
        path = langid.viterbi(s)
        got = s[np.arange(n), path].sum() - langid.SWITCH * (path[1:] != path[:-1]).sum()
        assert got == pytest.approx(best)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas().set_index("doc_id") for t in ("documents", "labels"))
    lang = [r for r in queries.op10_langid(spark, sf).collect() if r.held_out]
    assert np.mean([r.lang_pred == docs.lang[r.doc_id] for r in lang]) > 0.98
    good = [r for r in queries.op9_quality(spark, sf).collect() if r.held_out and r.doc_id in labels.index]
    assert np.mean([r.predicted == labels.quality[r.doc_id] for r in good]) > 0.95
    toxic = [r for r in queries.op1_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels.index]
    assert np.mean([r.predicted == labels.toxic[r.doc_id] for r in toxic]) > 0.9
    assert not [r for r in toxic if r.predicted and not labels.toxic[r.doc_id]][2:]


def test_mixed_language_spans(spark):
    en, fr = "the window of this house was there", "les maisons que vous avez dans cette rue"
    docs = spark.createDataFrame([(i, t * 8, x) for i in range(10) for t, x in ((en + " ", "en"), (fr + " ", "fr"))], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = langid.predict(spark.createDataFrame([(1, f"{en} {en} {fr} {fr}")], "doc_id long, text string"), model, spans=True).first()
    assert [s.lang for s in got.spans] == ["en", "fr"]
