"""Whole results of line dedup, fingerprints and quality against plain versions."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import lines, quality, queries


def runs_that_repeat(docs, least):
    """Places (doc, line) in runs of at least so many words that stand, line for line, in an earlier document."""
    out = set()
    for d, mine in enumerate(docs):
        for earlier in docs[:d]:
            for i in range(len(mine)):
                for j in range(len(earlier)):
                    if mine[i] != earlier[j] or (i and j and mine[i - 1] == earlier[j - 1]):
                        continue
                    n = 0
                    while i + n < len(mine) and j + n < len(earlier) and mine[i + n] == earlier[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in mine[i : i + n]) >= least:
                        out.update((d, i + k) for k in range(n))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_lines_that_go(spark, seed):
    """All lines of shared runs of WINDOW words go, and none that isn't in a shared run of GRAM words."""
    rng = random.Random(seed)
    pool = [" ".join(f"w{seed}x{k}y{i}" for i in range(rng.randint(3, 25))) for k in range(40)]
    docs = []
    for _ in range(60):
        new = [f"own{rng.random()} line" for _ in range(rng.randint(0, 4))]
        if docs and rng.random() < 0.7:  # a stretch of an earlier document, with something around it
            other = rng.choice(docs)
            at = rng.randrange(len(other))
            part = other[at : at + rng.randint(1, 12)]
            found = new[:2] + part + new[2:]
        else:
            found = new + rng.sample(pool, rng.randint(3, 12))
        docs.append(list(dict.fromkeys(found)) or ["one line"])  # no line twice in a document
    df = spark.createDataFrame([(k, "\n".join(x)) for k, x in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in lines.remove(df, keep_empty=True).collect()}
    gone = {(d, i) for d, mine in enumerate(docs) for i, x in enumerate(mine) if x not in got[d]}
    must, may = runs_that_repeat(docs, lines.WINDOW), runs_that_repeat(docs, lines.GRAM)
    assert must and must <= gone <= may


def lanes_of(text):
    exact, bits, paragraphs, phrases = [0] * 16, [0] * 64, 0, 0
    for p in text.split("\n"):
        paragraphs += 1
        for k in range(8):
            h = xxhash.xxh64_intdigest(("\n" + p).encode(), xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42))
            exact[2 * k] += h & 0xFFFFFFFF
            exact[2 * k + 1] += h >> 32
    for m in re.finditer("[^ \t\n\x0b\f\r.!?|]+(?:[ \t\x0b\f\r|]+[^ \t\n\x0b\f\r.!?|]+){0,3}", text):
        phrases += 1
        h = xxhash.xxh64_intdigest(m[0].encode(), 42)
        for i in range(64):
            bits[i] += h >> i & 1
    pairs = [x for i in range(32) for x in (bits[i], bits[i + 32])]
    return [x % (1 << 32) for x in [*exact, *pairs, paragraphs, phrases]], np.array(bits), phrases


def alike(a, b):
    if a[0] == b[0]:
        return 1.0
    norm = lambda v: float(np.mean(v.astype(float) ** 2))
    x, y = 2 * a[1] - a[2], 2 * b[1] - b[2]
    both, apart = norm(x) + norm(y), norm(x - y)
    return min(1.0, max(0.0, (both - apart) / (both + apart))) if both + apart else 0.0


def test_fingerprints(spark, small):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in queries.op7_fingerprint(spark, small).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        here, there, after = map(lanes_of, (text, edited, following))
        digits = lambda x: "".join(f"{v:08x}" for v in x[0])
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == sha256(edited.encode()).hexdigest()
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (digits(here), digits(there))
        assert got[i]["near_edited"] == pytest.approx(alike(here, there), abs=1e-9)
        assert got[i]["near_next"] == pytest.approx(alike(here, after), abs=1e-9)


def test_quality_agrees_with_labels_it_has_not_seen(spark):
    """On held-out rows good documents stand above bad ones in almost all pairs, and the cut at 0.3 tells them apart."""
    base = "/root/testdata/sf0.01"
    got = queries.op9_quality(spark, base).where("held_out")
    rows = got.join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where(F.col("quality").isNotNull()).select("score", "predicted", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([x > y for x in good for y in bad]) >= 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95


def test_weights_equal_a_plain_fit():
    """Newton's weights are those that gradient descent on all drawn pairs comes to."""
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(400, len(quality.FEATURES))))
    y = (x[:, 0] - x[:, 3] + rng.normal(size=400) > 0).astype(int)
    model = quality.bradley_terry(x, y, pairs=3000)
    z = np.clip((quality._expand(x) - model.mean) / model.scale, -8, 8)
    draw = np.random.default_rng(7)
    d = z[draw.choice(np.flatnonzero(y == 1), 3000)] - z[draw.choice(np.flatnonzero(y == 0), 3000)]
    w = np.zeros(z.shape[1])
    for _ in range(20_000):
        w += 0.05 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - quality.RIDGE * w)
    assert np.allclose(w, model.weights, atol=0.02)
    assert np.mean(d @ model.weights > 0) > 0.75


def test_quality_fits_on_all_labelled_documents(spark, monkeypatch):
    """all labelled documents are in pairs, a rare label too; in one block the fit is that of all pairs, and the threshold an exact quantile."""
    rng = np.random.default_rng(5)
    texts = [" ".join(["word"] * int(a) + ["###"] * int(c)) for a, c in zip(rng.integers(5, 40, 300), rng.integers(0, 9, 300), strict=True)]
    y = [int(t.count("#") < 9) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int")
    model = quality.fit(docs, labels)
    x, y = np.array([quality.features(t) for t in texts]), np.array(y)
    z = quality._expand(x)
    assert np.allclose(model.mean, z.mean(0)) and np.allclose(model.scale, z.std(0) + 1e-6, atol=1e-9)
    z = np.clip((z - model.mean) / model.scale, -8, 8)
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    p = 1 / (1 + np.exp(d @ model.weights))
    assert np.abs(d.T @ p / len(d) - quality.RIDGE * model.weights).max() < 1e-6
    r, bad = np.sort(model.rank(x)), int((y == 0).sum())
    assert np.isclose(model.threshold, (r[bad - 1] + r[bad]) / 2)
    monkeypatch.setattr(quality, "BLOCK", 20)
    seen, real = [], quality.stored
    monkeypatch.setattr(quality, "stored", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    quality.fit(docs, labels)
    rows = [r for r in dict(seen)["blocks"].collect()]
    assert len(rows) == 15 and all(r.good and r.bad for r in rows)
    monkeypatch.setattr(quality, "SORTED", 10)
    values = spark.createDataFrame([(float(v),) for v in rng.integers(0, 60, 400)], "r double")
    want = sorted(v.r for v in values.collect())
    assert quality.order_statistics(values, [0, 7, 200, 399]) == [want[i] for i in (0, 7, 200, 399)]
