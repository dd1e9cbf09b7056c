"""Quality scores by Bradley-Terry ranking.

Documents are described by FEATURES of their whole text. From preference pairs (a
document marked good against one marked bad) the weights are learned by logistic loss
on the differences of features; the weighted sum ranks documents. The threshold is the
quantile of the training scores at the share of bad documents, and the score is a
logistic curve that passes through LIMIT there.

Fitting reads all labelled documents. They are dealt into blocks of about BLOCK, and each is
compared with all documents of the other label in its block; a label with few documents is
copied to so many blocks that each holds about RARE of it. Tasks sum the gradient and the
curvature over their blocks, and thresholds are exact order statistics of all training scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Shipped, slices, stored

PAIRS = 40_000
BLOCK, RARE = 512, 16
#: Values that are sorted on the driver; more are narrowed down by counts first.
SORTED = 50_000
LIMIT = 0.3
RIDGE = 1e-3

FEATURES = [
    "symbols", "upper", "digits", "pipes", "bangs", "marked_words", "mean_word", "long_words",
    "distinct", "top_word", "repeats", "repeated_lines", "short_lines", "ends", "log_words", "spaces",
]

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence marks, 6 other ASCII marks, 7 letters beyond ASCII
for _c in range(256):
    _ch = chr(_c)
    _KIND[_c] = 7 if _c >= 128 else 1 if _ch.islower() else 2 if _ch.isupper() else 3 if _ch.isdigit() else 4 if _ch.isspace() else 5 if _ch in ".,;:'\"()-?" else 6 if 33 <= _c < 127 else 0
_MARKED = re.compile(rb"[#$%&*|~^@<>{}\[\]\\=+_]$|!!")


def features(text: str | None) -> list[float]:
    """FEATURES of a text; null counts as empty, whose features are all 0."""
    data = (text or "").encode("utf-8")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=8)
    letters = max(1.0, kinds[1] + kinds[2] + kinds[7] / 2)
    shown = max(1.0, kinds.sum() - kinds[4])
    low = data.lower().split()
    n = len(words)
    freq = Counter(low)
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper = len([w for w in words if w.isupper()])
    marked = sum(1 for w in words if _MARKED.search(w))
    repeats = sum(map(bytes.__eq__, low, low[1:]))
    return [
        kinds[6] / shown,
        upper / n,
        kinds[3] / shown,
        counts[124] / n,
        counts[33] / n,
        marked / n,
        min(shown / n, 30.0) / 10,
        len([w for w in words if len(w) > 20]) / n,
        len(freq) / n ** 0.8,
        (max(freq.values()) - 1) / n,
        repeats / n,
        1 - len(set(lines)) / len(lines),
        len([x for x in lines if len(x) < 20]) / len(lines),
        min(1.0, counts[46] / n * 5),
        np.log(n) / 10,
        kinds[4] / max(1, len(data)),
    ]


def _expand(x: np.ndarray) -> np.ndarray:
    """Features with their square roots: small shares count for more."""
    return np.hstack((x, np.sqrt(np.maximum(x, 0.0))))


class QualityModel:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float, slope: float) -> None:
        self.mean, self.scale, self.weights, self.threshold, self.slope = mean, scale, weights, threshold, slope

    def rank(self, x: np.ndarray) -> np.ndarray:
        return (np.clip((_expand(x) - self.mean) / self.scale, -8, 8)) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.slope * (self.rank(x) - self.threshold) + np.log(LIMIT / (1 - LIMIT)), -40, 40)
        return 1 / (1 + np.exp(-z))


def bradley_terry(x: np.ndarray, y: np.ndarray, bad_share: float | None = None, pairs: int = PAIRS, seed: int = 7) -> QualityModel:
    """x: features, y: 1 good, 0 bad; bad_share: of all labelled documents (default: of y). With one label only, all documents score as that label."""
    z = _expand(x) if len(x) else np.zeros((0, 2 * len(FEATURES)))
    mean, scale = (z.mean(0), z.std(0) + 1e-6) if len(z) else (np.zeros(z.shape[1]), np.ones(z.shape[1]))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return QualityModel(mean, scale, np.zeros(z.shape[1]), -1.0 if len(good) or not len(y) else 1.0, 3.0)
    z = np.clip((z - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton's method; the loss is convex
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(w)), d.T @ p / pairs - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    r = z @ w
    share = len(bad) / len(y) if bad_share is None else bad_share
    weight = np.where(y == 1, (1 - share) / len(good), share / len(bad))
    order = np.argsort(r, kind="stable")
    k = min(max(1, int(np.searchsorted(np.cumsum(weight[order]), share * (1 - 1e-9))) + 1), len(r) - 1)
    threshold = (r[order[k - 1]] + r[order[k]]) / 2
    apart = np.median(r[good]) - np.median(r[bad])
    return QualityModel(mean, scale, w, float(threshold), float(8 / max(apart, 1e-6)))


def order_statistics(values: DataFrame, places: list[int]) -> list[float]:
    """Exact values of column r at places (from 0) of their order: counts by bins narrow a place down to SORTED rows at most."""
    n, low, high = values.agg(F.count(F.lit(1)), F.min("r"), F.max("r")).first()
    if n <= SORTED:
        got = sorted(r[0] for r in values.select("r").collect())
        return [got[k] for k in places]
    out = []
    for k in places:
        part, count, lo, hi = values, n, low, high
        while count > SORTED and lo < hi:
            at = F.least(F.lit(4095), F.floor((F.col("r") - F.lit(lo)) / F.lit((hi - lo) / 4096)))
            for _, count, lo, hi in sorted(tuple(x) for x in part.groupBy(at.alias("bin")).agg(F.count(F.lit(1)), F.min("r"), F.max("r")).collect()):
                if k < count:
                    break
                k -= count
            part = values.where(F.col("r").between(lo, hi))
        out.append(lo if lo == hi else sorted(r[0] for r in part.select("r").collect())[k])
    return out


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, squares = 0, 0.0, 0.0
    for b in batches:
        z = _expand(np.asarray(b.column("x").flatten()).reshape(b.num_rows, -1))
        n, total, squares = n + len(z), total + z.sum(0), squares + (z * z).sum(0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in (total, squares))], ["n", "total", "squares"])


def _packed(group: pa.Table) -> pa.Table:
    """A block's features by label, in the order of the documents."""
    group = group.combine_chunks().sort_by([("doc_id", "ascending"), ("x0", "ascending")])
    x = np.array(group["x"].to_pylist())
    y = group["label"].to_numpy()
    return pa.table({c: pa.array([x[y == v].tobytes()], pa.binary()) for c, v in (("good", 1), ("bad", 0))})


def _slope(mean: np.ndarray, scale: np.ndarray, w: np.ndarray):
    """Sums of gradient and curvature of the logistic loss over all pairs of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, g, h = 0, np.zeros(len(w)), np.zeros((len(w), len(w)))
        for b in batches:
            for row in zip(b.column("good").to_pylist(), b.column("bad").to_pylist(), strict=True):
                good, bad = (np.clip((_expand(np.frombuffer(x).reshape(-1, len(FEATURES))) - mean) / scale, -8, 8) for x in row)
                p = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - bad @ w, -40, 40)))
                q = p * (1 - p)
                both = good.T @ q @ bad
                g += good.T @ p.sum(1) - bad.T @ p.sum(0)
                h += (good * q.sum(1)[:, None]).T @ good + (bad * q.sum(0)[:, None]).T @ bad - both - both.T
                pairs += p.size
        yield pa.RecordBatch.from_arrays([pa.array([pairs], pa.int64()), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in (g, h.ravel()))], ["pairs", "g", "h"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
    """Fit on all labelled documents; one labelled twice counts as its larger label. Features are joined to labels, not texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = pa.array([features(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), x], ["doc_id", "x"])

    one = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    told = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")
    rows = stored(told.join(one, "doc_id"), "features")
    width = 2 * len(FEATURES)
    counts = dict(tuple(r) for r in rows.groupBy("label").count().collect())
    good, bad = counts.get(1, 0), counts.get(0, 0)
    sums = rows.select("x").mapInArrow(_moments, "n long, total array<double>, squares array<double>").collect()
    n = good + bad
    mean = np.sum([r.total for r in sums], axis=0) / n if n else np.zeros(width)
    scale = np.sqrt(np.maximum(np.sum([r.squares for r in sums], axis=0) / n - mean**2, 0.0)) + 1e-6 if n else np.ones(width)
    if not good or not bad:
        return QualityModel(mean, scale, np.zeros(width), -1.0 if good or not n else 1.0, 3.0)
    blocks = -(-n // BLOCK)
    copies = {v: min(blocks, max(1, -(-RARE * blocks // k))) for v, k in counts.items()}
    extra = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == 1, copies[1] - 1).otherwise(copies[0] - 1)))
    dealt = rows.select("doc_id", "label", "x", F.col("x")[0].alias("x0"), F.xxhash64("doc_id").alias("at"), extra.alias("copy")).withColumn("block", F.pmod(F.pmod("at", F.lit(blocks)) + F.col("copy"), F.lit(blocks)))
    packed = stored(dealt.groupBy("block").applyInArrow(_packed, "good binary, bad binary"), "blocks")
    w = np.zeros(width)
    for _ in range(30):  # Newton's method; the loss is convex
        got = packed.mapInArrow(_slope(mean, scale, w), "pairs long, g array<double>, h array<double>").collect()
        pairs = max(1, sum(r.pairs for r in got))
        g, h = (np.sum([r[c] for r in got], axis=0) / pairs for c in ("g", "h"))
        step = np.linalg.solve(h.reshape(width, width) + RIDGE * np.eye(width), g - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model = QualityModel(mean, scale, w, 0.0, 1.0)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = model.rank(np.asarray(b.column("x").flatten()).reshape(b.num_rows, -1))
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(r, pa.float64())], ["label", "r"])

    ranks = stored(rows.select("label", "x").mapInArrow(ranked, "label int, r double"), "ranks")
    k = min(max(1, bad), n - 1)
    threshold = np.mean(order_statistics(ranks, [k - 1, k]))
    medians = [np.mean(order_statistics(ranks.where(F.col("label") == v), [(m - 1) // 2, m // 2])) for v, m in ((1, good), (0, bad))]
    return QualityModel(mean, scale, w, float(threshold), float(8 / max(medians[0] - medians[1], 1e-6)))


def predict(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row; null and empty texts get the score of all features 0. Other columns are ignored."""
    shared = Shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([features(t) for t in b.column("text").to_pylist()]).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(x), pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
