"""The n-gram model against a plain Kneser-Ney model in Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import ngrams

TEXTS = ["the cat sat on the mat", "The cat  sat\ton a mat\n", "a dog sat on the cat", None, "", "  \n", "été là été", "the the the the", "the cat sat on the mat"]
SEEN = ["a cat sat on the dog", "zebra", "the", "", None, "on the mat the cat sat on the mat"]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0d]+", low), "</s>"]


class Plain:
    """Interpolated modified Kneser-Ney by dictionaries."""

    def __init__(self, texts, order):
        self.order, self.counts = order, [Counter() for _ in range(order + 1)]
        raw = [Counter() for _ in range(order + 1)]
        for t in texts:
            s = ["<s>", *words(t)]
            for k in range(1, order + 1):
                for i in range(len(s) - k + 1):
                    raw[k][tuple(s[i : i + k])] += 1
        self.raw = Counter({w[0]: n for w, n in raw[1].items() if w[0] != "<s>"})
        for k in range(1, order + 1):
            if k == order:
                self.counts[k] = raw[k]
                continue
            left = Counter(g[1:] for g in raw[k + 1])
            self.counts[k] = Counter({g: n if g[0] == "<s>" else left[g] for g, n in raw[k].items() if g != ("<s>",)})
        self.d = [None] + [ngrams.discounts([sum(1 for n in self.counts[k].values() if n == i) for i in (1, 2, 3, 4)]) for k in range(1, order + 1)]
        self.v, self.n = len(self.raw), sum(self.raw.values())
        self.after = [{} for _ in range(order + 1)]
        for k in range(1, order + 1):
            for g, n in self.counts[k].items():
                known = self.after[k].setdefault(g[:-1], [0, 0.0])
                known[0] += n
                known[1] += self.cut(k, n)

    def cut(self, k, n):
        return self.d[k][min(n, 3) - 1] if n else 0

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (self.v + 1)
        lower = self.p(gram[1:])
        found = self.after[k].get(gram[:-1])
        if not found:
            return lower
        n = self.counts[k].get(gram, 0)
        return max(n - self.cut(k, n), 0) / found[0] + found[1] / found[0] * lower

    def score(self, text):
        s = ["<s>", *words(text)]
        return sum(math.log10(self.p(tuple(s[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(s)))

    def base(self, text):
        return sum(math.log10((self.raw[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in words(text))


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("level", "shard", "data", "score")})


@pytest.mark.parametrize(("order", "shards"), [(2, None), (3, 2), (4, 8)])
def test_equals_plain_model(spark, order, shards):
    model = ngrams.train(table(spark, TEXTS), order=order, shards=shards)
    plain = Plain(TEXTS, order)
    assert (model.tokens, model.words) == (plain.n, plain.v)
    for text, r in zip(SEEN + TEXTS, sorted(ngrams.score(table(spark, SEEN + TEXTS), model).collect(), key=lambda r: r["doc_id"]), strict=True):
        assert r["n_tokens"] == len(words(text))
        assert r["n_known"] == sum(plain.raw[w] > 0 for w in words(text))
        assert r["base_score"] == pytest.approx(plain.base(text), abs=1e-9)
        assert r["score"] == pytest.approx(plain.score(text), abs=1e-9)
        assert r["perplexity"] == pytest.approx(10 ** (-plain.score(text) / len(words(text))))


def test_chances_sum_to_one(spark):
    """All known tokens and one unknown, after each context of one word."""
    model, plain = ngrams.train(table(spark, TEXTS)), Plain(TEXTS, 2)
    scorer = ngrams.Scorer(model)
    known = [w for w in plain.raw if w != "</s>"]
    for before in [*known, "never"]:
        stream, starts = ngrams.streams(pa.array([f"{before} {w}" for w in [*known, "unseen"]]))
        ended, at = ngrams.streams(pa.array([before]))
        _, p, _ = scorer.tokens(stream, starts)
        _, e, _ = scorer.tokens(ended, at)
        assert sum(10.0 ** p[starts[:-1] + 2]) + 10.0 ** e[2] == pytest.approx(1.0)


def test_no_training_rows(spark):
    none = ngrams.train(table(spark, TEXTS).limit(0))
    got = ngrams.score(table(spark, SEEN), none).collect()
    assert [r["score"] for r in got] == [0.0] * len(SEEN) == [r["base_score"] for r in got]
    assert ngrams.score(table(spark, SEEN).limit(0), none).count() == 0


def test_whole_table(spark, small):
    """The registered query's training and scores on the smallest tables, held-out rows better than by word counts."""
    import __spark_entry__

    got = {r["doc_id"]: r for r in __spark_entry__.queries()["op12_ngram_lm"](spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    plain = Plain([r["text"] for r in rows if not got[r["doc_id"]]["held_out"]], 2)
    for r in rows:
        g = got[r["doc_id"]]
        assert g["train_tokens"] == plain.n
        assert g["base_score"] == pytest.approx(plain.base(r["text"]), rel=1e-9)
        assert g["score"] == pytest.approx(plain.score(r["text"]), rel=1e-9)
    assert np.sum([g["score"] for g in got.values()]) > np.sum([g["base_score"] for g in got.values()])
