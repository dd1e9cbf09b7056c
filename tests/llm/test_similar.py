"""Near copies by five-word shingles, against plain Jaccard similarity."""

import random

import numpy as np

import corpus_pipeline
from quarry.llm import simhash, similar


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Smallest id of each component."""
    least = {i: i for i, _ in rows}
    sets = {i: plain_set(t) for i, t in rows}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    return {root(i) for i in least}


def test_planted_copies(spark):
    """k words of 400 replaced: similarity (396 - 5k) / (396 + 5k), 0.975 to 0.817 for 1 to 8, 0.796 for 9."""
    rng = random.Random(7)
    rows = []
    for case in range(20):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows.append((case * 100, " ".join(base)))
        at = rng.sample(range(10, 390, 10), 9)
        for k in (range(1, 9) if case % 2 else [9]):
            rows.append((case * 100 + k, " ".join(f"new{case}x{k}" if i in at[:k] else w for i, w in enumerate(base))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.deduplicate_documents(spark, docs, "").collect()}
    assert got == {i for i, _ in rows if i % 100 in (0, 9)}


def test_near_dedup_stage(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id for r in corpus_pipeline.deduplicate_documents(spark, spark.read.parquet(f"{small}/documents.parquet"), "").collect()}
    assert got == plain_kept(rows)


def test_sets_in_a_file(monkeypatch, tmp_path):
    """Groups above the held size, and compared in parts, give the same links."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(w if rng.random() > 0.01 else f"x{rng.randrange(9)}" for w in base) for _ in range(60)]

    def links():
        group = similar._Group(f"file://{tmp_path}")
        for i, t in enumerate(texts):
            group.add(i, similar.shingles(t))
        return group.links(0.8).to_pydict()

    want = links()
    assert len(want["a"]) > 20
    monkeypatch.setattr(similar, "HELD", 500)
    monkeypatch.setattr(similar, "PART", 300)
    assert links() == want
    assert np.array_equal(similar.shingles("a B\tc"), similar.shingles("A b c"))


def test_candidates_by_fingerprints(spark, monkeypatch):
    """Texts that SimHash links are compared, whatever their minima are; those that are less alike than 0.8 stay."""
    rng, rows, close = random.Random(1), [], set()
    for case in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        k = 2 + case % 8
        at = rng.sample(range(10, 390, 10), k)
        texts = " ".join(base), " ".join(f"new{case}" if i in at else w for i, w in enumerate(base))
        rows += [(2 * case + n, t) for n, t in enumerate(texts)]
        if (simhash.simhash(texts[0]) ^ simhash.simhash(texts[1])).bit_count() <= 3:
            close.add((2 * case + 1, k))
    assert {k for _, k in close} >= {2, 9}
    monkeypatch.setattr(similar, "BANDS", 1)
    monkeypatch.setattr(similar, "ROWS", 256)
    monkeypatch.setattr(similar, "_FLIP", np.random.default_rng(1).integers(0, 1 << 63, (256, 1), np.uint64))
    monkeypatch.setattr(similar, "_TIMES", similar._FLIP | np.uint64(1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.deduplicate_documents(spark, docs, "").collect()}
    assert got == {i for i, _ in rows} - {i for i, k in close if k < 9}
