"""Toxicity: a support vector machine on a subsequence string kernel with Nystroem landmarks, trained on labelled sentences.

Kernel. A word is seen through windows of WIDTH characters (whole, if it has at most one
more), with marks for its two ends. Two windows are compared by the runs of ORDER
characters they hold in order, gaps allowed: a run that spans s characters weighs
DECAY**s in each. The kernel is normed (1 for equal windows) and raised to POWER. So an
insult is still close to its stem with another ending, and with characters put in, left
out or doubled. Marks inside a word are taken out (l-o-s-e-r), runs of single characters
joined (l o s e r), digits and signs that stand for letters read as those.

Training. The examples are sentences with their document's label, each different one once
(one that clean documents have too is clean; it counts for its least document). A toxic
sentence is a bag: it needs one toxic window, not only such, so the machine labels the
windows of toxic sentences itself (mi-SVM): at first by whether a window, or the words
that begin like it, help on both halves of the documents, then by its own value, round by
round. Windows are mapped to kernel values with LANDMARKS windows, whitened (Nystroem), and
separated by a linear machine with squared hinge loss; words with characters put in,
doubled and left out are learned too, on both sides.

Scores. A text is judged by its TOP highest different words, through an additive logistic
curve fitted on labelled documents that the machine was not trained on. Every word of a
whole text is compared with the landmarks.

Fitting reads at most about 2 * PER_LABEL labelled documents and of these at most
4 * MOST_WINDOWS different windows.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Shipped, slices, worker_cache
from quarry.llm.sampling import labelled_documents

PER_LABEL, MOST_WINDOWS = 2500, 30_000
WIDTH, ORDER, DECAY, POWER = 8, 4, 0.7, 3
#: Landmarks (half of them the most telling windows), rounds of training, cost, weight of the toxic side.
LANDMARKS, ROUNDS, COST, TOXIC_SHARE = 128, 4, 0.3, 0.05
#: Windows are also judged by those that begin a word with the same so many characters (the mark for the word's start counts).
HEADS = (4, 5, 6, 7)
#: So many standard deviations more often in toxic documents than by chance, in both halves: a telling window.
TELLING = 2.0
#: So many windows of either side (twice as many clean ones) are also learned disturbed, TIMES each.
DISTURBED, TIMES = 400, 4
#: One labelled document in so many calibrates instead of training.
CALIBRATE = 4
TOP, LIMIT = 3, 0.7
#: Values below the floor tell nothing; the curve has a ramp from each step on.
FLOOR = -0.8
STEPS = np.arange(FLOOR, 1.0, 0.2)
MOST_CACHED = 600_000

_SENTENCE = re.compile(r"[.!?]+\s+|\n")
_ENDS = ".,;:!?\"'()[]{}<>*&%#|~_-+=/\\"
_SIGNS = str.maketrans({"@": "a", "$": "s"})
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_SINGLES = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_REPEATED = re.compile(r"(.)\1{2,}")
_START, _END, _EDGE = "^", "$", 63
_LONGEST = WIDTH + 3


def _class(ch: str) -> int:
    """1 to 26: a to z; 27 to 61: other letters; 62: other characters; 63: a word's edge."""
    if ch in (_START, _END):
        return _EDGE
    ch = _DIGITS.get(ch, ch)
    if "a" <= ch <= "z":
        return ord(ch) - 96
    return 27 + ord(ch) % 35 if ch.isalpha() else 62


_TABLE = np.array([_class(chr(c)) for c in range(0x3000)], np.int64)


def core(token: str) -> str:
    """A lower-case token without marks; a character repeated three times and more stands once."""
    token = token.strip(_ENDS)
    if not token.isalnum():
        token = "".join([c for c in token.translate(_SIGNS) if c.isalnum()])
    return _REPEATED.sub(r"\1", token)


def tokens_of(text: str | None) -> set[str]:
    """The different tokens of a text, lower-case, and its runs of three and more single characters, joined."""
    lower = (text or "").lower()
    out = set(lower.split())
    if sum([len(p) == 1 for p in out]) > 1:
        out.update(["".join(run.split()) for run in _SINGLES.findall(lower)])
    return out


def windows(word: str) -> list[str]:
    if not word:
        return []
    if len(word) <= WIDTH + 1:
        return [_START + word + _END]
    return [_START + word[:WIDTH], *[word[i : i + WIDTH] for i in range(WIDTH // 2, len(word) - WIDTH, WIDTH // 2)], word[-WIDTH:] + _END]


#: Numbers of subsequences: their codes, folded into so many (two different ones seldom meet).
_NUMBERS = 1 << 22


def _places(n: int) -> tuple[np.ndarray, ...]:
    """For windows of n characters: the pairs of places; of each subsequence its first and its last pair, and its weight."""
    pairs = {x: k for k, x in enumerate(itertools.combinations(range(n), 2))}
    some = list(itertools.combinations(range(n), ORDER))
    at = lambda k: np.array([pairs[x[k : k + 2]] for x in some], np.int64)
    left, right = (np.array([x[k] for x in pairs], np.int64) for k in (0, 1))
    return left, right, at(0), at(2), np.array([DECAY ** (x[-1] - x[0] + 1) for x in some], np.float32)


_PLACES = [_places(n) for n in range(_LONGEST + 1)]
#: The least norm of windows of n characters: that without repeated subsequences.
_LEAST_NORM = [float(np.sqrt((x[4].astype(float) ** 2).sum())) for x in _PLACES]


def encode(some: list[str]) -> np.ndarray:
    """Windows of equal length as rows of character classes."""
    flat = np.frombuffer("".join(some).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    flat = np.where(flat < len(_TABLE), _TABLE[np.minimum(flat, len(_TABLE) - 1)], 27 + flat % 35)
    return flat.reshape(len(some), -1).astype(np.uint32)


def subsequences(codes: np.ndarray) -> np.ndarray:
    """The numbers of the subsequences of each window, in the order of _PLACES."""
    left, right, first, last, _ = _PLACES[codes.shape[1]]
    pairs = codes[:, left] * np.uint32(64) + codes[:, right]
    return (pairs[:, first] * np.uint32(4096) + pairs[:, last]) * np.uint32(2654435761) >> np.uint32(10)


def norms(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The square root of each window's kernel with itself: weights of a subsequence's occurrences are summed, then squared."""
    order = np.argsort(found, axis=1)
    sorted_ = np.take_along_axis(found, order, 1)
    new = np.ones(sorted_.shape, bool)
    new[:, 1:] = sorted_[:, 1:] != sorted_[:, :-1]
    sums = np.bincount(np.cumsum(new.ravel()) - 1, weights[order].ravel())
    return np.sqrt(np.bincount(np.nonzero(new)[0], sums * sums, len(found)))


def _parts(some: list[str], size: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indexes of windows of one length, their subsequences, these' weights), a bounded number at a time; none for shorter ones than ORDER."""
    lengths = np.fromiter(map(len, some), np.int64, len(some))
    for n in np.unique(lengths[lengths >= ORDER]).tolist():
        at = np.flatnonzero(lengths == n)
        for k in range(0, len(at), size):
            mine = at[k : k + size]
            yield mine, subsequences(encode([some[i] for i in mine.tolist()])), _PLACES[n][4]


class Landmarks:
    """Weights of the subsequences that occur in the landmark windows."""

    def __init__(self, marks: list[str]) -> None:
        self.marks = marks
        found = [(mine, x, weights, norms(x, weights)) for mine, x, weights in _parts(marks)]
        self.used = np.unique(np.concatenate([x.ravel() for _, x, _, _ in found])) if found else np.zeros(0, np.uint32)
        self.table = np.zeros((len(self.used) + 1, len(marks)), np.float32)
        for mine, x, weights, norm in found:
            np.add.at(self.table, (np.searchsorted(self.used, x) + 1, mine[:, None]), weights / norm[:, None])
        self._place: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_place": None}

    def place(self, found: np.ndarray) -> np.ndarray:
        """Rows of the table; 0: in no landmark."""
        if self._place is None:
            self._place = np.zeros(_NUMBERS, np.int32 if len(self.used) > 32_000 else np.int16)
            self._place[self.used] = np.arange(1, len(self.used) + 1)
        return self._place[found]

    def kernel(self, some: list[str]) -> np.ndarray:
        """windows x landmarks: normed kernel to the power POWER."""
        out = np.zeros((len(some), len(self.marks)), np.float32)
        for mine, found, weights in _parts(some):
            place = self.place(found)
            r, c = np.nonzero(place)
            if len(r):
                rows = self.table[place[r, c]]
                rows *= weights[c][:, None]
                starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                some_of = r[starts]
                out[mine[some_of]] = np.add.reduceat(rows, starts, axis=0) / norms(found[some_of], weights)[:, None]
        return out**POWER

    def within(self, some: list[str], alpha: np.ndarray, least: float) -> np.ndarray:
        """Indexes of windows whose kernel values times alpha can exceed least: an upper bound, so that no other can.

        Each kernel value is at most the sum of its subsequences' largest weights, over the least norm.
        """
        plus = np.maximum(alpha, 0).astype(np.float32)
        largest, total = self.table.max(1), self.table @ plus
        out = []
        for mine, found, weights in _parts(some):
            place = self.place(found)
            norm = np.float32(_LEAST_NORM[len(some[int(mine[0])])])
            most = np.minimum(largest[place] @ weights / norm, 1)
            out.append(mine[most ** (POWER - 1) * (total[place] @ weights / norm) > least])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Linear machine with squared hinge loss (last column of x: the constant), by Newton steps on the primal."""
    w, small = np.zeros(x.shape[1]), np.ones(x.shape[1])
    small[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        short = np.maximum(0, 1 - y * (x @ w.astype(x.dtype)))
        return float((small * w * w).sum() + (cost * short * short).sum()) / 2

    now = loss(w)
    for _ in range(rounds):
        short = 1 - y * (x @ w.astype(x.dtype))
        inside = short > 0
        hessian, slope = np.diag(small), small * w
        for rows in np.array_split(np.flatnonzero(inside), inside.sum() // 8192 + 1):
            xi = x[rows].astype(np.float64)
            hessian += (xi * cost[rows, None]).T @ xi
            slope -= xi.T @ (cost[rows] * y[rows] * short[rows])
        step = np.linalg.solve(hessian, slope)
        share = 1.0
        while share > 1e-4 and loss(w - share * step) >= now:
            share /= 2
        then = loss(w - share * step)
        if then >= now:
            break
        w, gain, now = w - share * step, now - then, then
        if gain < 1e-5 * now:
            break
    return w


def _disturb(window: str, rng: np.random.Generator, times: int = TIMES) -> list[str]:
    """The window with a character put in, doubled, or (of longer ones) left out."""
    out = []
    for _ in range(times):
        k, kind = int(rng.integers(2, max(3, len(window) - 1))), int(rng.integers(3))
        other = chr(97 + int(rng.integers(26)))
        out.append((window[:k] + window[k + 1 :] if kind == 2 and len(window) > 6 else window[:k] + (window[k - 1] if kind == 1 else other) + window[k:])[:_LONGEST])
    return out


def _far(some: list[str], n: int, chosen: list[str]) -> list[str]:
    """n windows far from one another and from those chosen: each next one is that least like them."""
    if not some:
        return []
    best = Landmarks(chosen).kernel(some).max(1) if chosen else np.zeros(len(some), np.float32)
    out: list[str] = []
    for _ in range(n):
        k = int(best.argmin())
        if best[k] > 0.9:
            break
        out.append(some[k])
        best = np.maximum(best, Landmarks([some[k]]).kernel(some)[:, 0])
    return out


def train(counts: dict[str, tuple[int, int, int, int]], documents: tuple[int, int, int, int]) -> ToxicityModel | None:
    """A machine from numbers of documents: of each window (and beginning, written with a ~ behind), toxic and clean, of either half.

    None if nothing tells toxic sentences from clean ones.
    """
    names = sorted(k for k in counts if not k.endswith("~"))
    if not names or not documents[0] + documents[2] or not documents[1] + documents[3]:
        return None

    def strength(n: np.ndarray) -> np.ndarray:
        halves = []
        for t, c, all_t, all_c in ((n[:, 0], n[:, 1], *documents[:2]), (n[:, 2], n[:, 3], *documents[2:])):
            share = max(all_t, 0.5) / max(all_t + all_c, 1)
            halves.append((t - share * (t + c)) / np.sqrt(share * (t + c) + 0.5))
        return np.minimum(*halves)

    n = np.array([counts[k] for k in names], float)
    toxic, clean, own = n[:, 0] + n[:, 2], n[:, 1] + n[:, 3], strength(n)
    starts = sorted(k for k in counts if k.endswith("~"))
    told = dict(zip([k[:-1] for k in starts], strength(np.array([counts[k] for k in starts], float)).tolist(), strict=True)) if starts else {}
    best = np.array([max([s, *(told.get(w[:h], 0.0) for h in HEADS if w[0] == _START and len(w) > h)]) for w, s in zip(names, own.tolist(), strict=True)])
    if not (best >= TELLING).any():
        return None
    rng = np.random.default_rng(11)
    strongest = np.argsort(-own, kind="stable")[: LANDMARKS // 2]
    lead = list(dict.fromkeys([names[i] for i in strongest] + [k for k in sorted(told, key=lambda k: (-told[k], k))[: LANDMARKS // 4] if told[k] >= TELLING]))
    common = np.argsort(-clean, kind="stable")
    others = [names[i] for i in common[:2000]] + [names[i] for i in rng.choice(len(names), min(len(names), 1500), replace=False)]
    landmarks = Landmarks(lead + _far(others, LANDMARKS // 2, lead))
    value, vector = np.linalg.eigh(landmarks.kernel(landmarks.marks).astype(np.float64))
    keep = value > 1e-2 * value[-1]
    white = (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)
    taken = np.unique(np.concatenate((np.argsort(-best, kind="stable")[: MOST_WINDOWS // 2], common[: MOST_WINDOWS // 2], rng.choice(len(names), min(len(names), MOST_WINDOWS // 2), replace=False))))
    names, toxic, clean, best = [names[i] for i in taken], toxic[taken], clean[taken], best[taken]

    def mapped(some: list[str]) -> np.ndarray:
        return np.hstack((landmarks.kernel(some) @ white, np.ones((len(some), 1), np.float32)))

    x = mapped(names)
    f, w = np.zeros(len(names)), np.zeros(x.shape[1])
    for k in range(ROUNDS):
        plus = (toxic > 0) & (clean <= toxic / 4) & ((best >= TELLING) | (f > 0))
        if k:  # a telling window must not be far on the other side
            plus &= (f > -0.5) | (best >= 1.5 * TELLING)
        if not plus.any():
            return None
        heaviest = np.flatnonzero(plus)[np.argsort(-toxic[plus], kind="stable")][:DISTURBED]
        disturbed = [[v for i in some for v in _disturb(names[i], rng)] for some in (heaviest, np.flatnonzero(~plus)[np.argsort(-clean[~plus], kind="stable")][: 2 * DISTURBED])]
        both = plus & (clean > 0)
        sides = [(x[plus], 1, np.sqrt(toxic[plus]).clip(1, 20)), (mapped(disturbed[0]), 1, np.full(len(disturbed[0]), 0.5))]
        sides += [(x[~plus], -1, np.sqrt(clean + toxic)[~plus].clip(1, 20)), (x[both], -1, np.sqrt(clean[both])), (mapped(disturbed[1]), -1, np.ones(len(disturbed[1])))]
        y, cost = np.concatenate([np.full(len(a), float(s)) for a, s, _ in sides]), np.concatenate([c for _, _, c in sides])
        cost[y > 0] *= TOXIC_SHARE * max(cost[y < 0].sum(), 1.0) / cost[y > 0].sum()
        w = svm(np.vstack([a for a, _, _ in sides]), y, COST * cost)
        f = x @ w.astype(np.float32)
    return ToxicityModel(landmarks, white @ w[:-1], float(w[-1]))


def ramps(top: np.ndarray) -> np.ndarray:
    """For each of a text's highest values, how far it is above each of STEPS (0 to 1)."""
    return np.clip((top[:, :, None] - STEPS) / (STEPS[1] - STEPS[0]), 0, 1).reshape(len(top), -1)


def curve(x: np.ndarray, y: np.ndarray, small: float = 1.0, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Logistic regression with weights that are not negative, both classes weighing alike, by projected gradient steps."""
    cost = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w, b = np.zeros(x.shape[1]), 0.0
    rate = 1 / (0.25 * np.linalg.eigvalsh((x * cost[:, None]).T @ x)[-1] + 0.25 * len(y) + small)
    for _ in range(rounds):
        error = cost * (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y)
        w, b = np.maximum(0, w - rate * (x.T @ error + small * w)), b - rate * error.sum()
    return w, float(b)


class ToxicityModel:
    """A linear machine on kernel values with landmarks, and the curve from a text's highest values to its score.

    Without landmarks every window is clean. Uncalibrated, one window at the middle of the margin reaches LIMIT.
    """

    def __init__(self, landmarks: Landmarks | None = None, alpha: np.ndarray | None = None, bias: float = 0.0) -> None:
        self.name = uuid.uuid4().hex
        self.landmarks, self.alpha, self.bias = landmarks, alpha, bias
        self.weights, self.cut, self.scale = np.zeros(TOP * len(STEPS)), 0.0, 1.0
        self.weights[: len(STEPS)] = 1.0
        self.cut = float((ramps(np.array([[0.0] + [-1.0] * (TOP - 1)])) @ self.weights)[0])

    def values(self, some: list[str]) -> np.ndarray:
        """The value of each window; -1 for those that can't exceed FLOOR."""
        out = np.full(len(some), -1.0)
        if self.landmarks is not None and some:
            at = self.landmarks.within(some, self.alpha, FLOOR - self.bias)
            for k in range(0, len(at), 4096):
                part = at[k : k + 4096]
                out[part] = self.landmarks.kernel([some[i] for i in part.tolist()]) @ self.alpha + self.bias
        return out

    def calibrate(self, top: np.ndarray, y: np.ndarray) -> None:
        """Fit the curve; the cut has the fewest errors and stays near the clean side of the gap, so that a single insult counts."""
        if not (0 < y.sum() < len(y)):
            return
        x = ramps(top)
        self.weights, _ = curve(x, y)
        z = x @ self.weights
        cuts = np.unique(z)
        errors = np.array([((z >= c) & (y == 0)).sum() + ((z < c) & (y == 1)).sum() for c in cuts])
        k = int(np.argmin(errors))
        below = cuts[k - 1] if k else cuts[0] - 1.0
        self.cut = float(below + 0.3 * (cuts[k] - below))
        self.scale = float(max(np.median(z[y == 1]) - self.cut, 0.05)) / 3

    def score(self, top: np.ndarray) -> np.ndarray:
        z = (ramps(top) @ self.weights - self.cut) / self.scale + np.log(LIMIT / (1 - LIMIT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def top_values(model: ToxicityModel, texts: list[str | None]) -> np.ndarray:
    """The TOP highest values of different words of each text, the highest first; -1 fills up and stands for all below FLOOR."""
    cache = worker_cache("toxicity")
    if cache.get("name") != model.name or len(cache["known"]) > MOST_CACHED:
        cache.update(name=model.name, known=set(), high={})
    known, high = cache["known"], cache["high"]
    sets = [tokens_of(t) for t in texts]
    out = np.full((len(texts), TOP), -1.0)
    at = 0
    while at < len(sets):  # a few texts at a time, so that new words are valued together but don't pile up
        end, new = at, set()
        while end < len(sets) and len(new) < 50_000:
            new |= sets[end] - known
            end += 1
        cores = {t: core(t) for t in new}
        parts = {c: windows(c) for c in set(cores.values())}
        some = list({w for p in parts.values() for w in p})
        valued = {w: v for w, v in zip(some, model.values(some).tolist(), strict=True) if v > FLOOR}
        if valued:
            best = {c: max([valued.get(w, -1.0) for w in p], default=-1.0) for c, p in parts.items()}
            high.update({t: (best[c], c) for t, c in cores.items() if best[c] > FLOOR})
        known |= new
        for k in range(at, end):
            found = {high[t] for t in high.keys() & sets[k]}
            for j, (v, _) in enumerate(sorted(found, reverse=True)[:TOP]):
                out[k, j] = v
        at = end
    return out


def _counts(rows: DataFrame) -> tuple[dict[str, tuple[int, int, int, int]], tuple[int, int, int, int]]:
    """Numbers of documents by half and label, for each window and beginning, and in all.

    Each different sentence counts for one document (clean ones before toxic ones, the least
    id), so copies of a document don't add up.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [(i, label, s) for i, text, label in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True) for s in {s.strip() for s in _SENTENCE.split(text or "")} if s]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], b.column("doc_id").type), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.string())], ["doc_id", "label", "sentence"])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in slices(batches):
            for half, label, some in zip(*(b.column(c).to_pylist() for c in ("half", "label", "sentences")), strict=True):
                found = {w for s in some for t in tokens_of(s) for w in windows(core(t))}
                starts = {w[:h] + "~" for w in found if w[0] == _START for h in HEADS if len(w) > h}
                counts.update((x, 2 * half + 1 - label) for x in itertools.chain(found, starts, ("",)))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([c for _, c in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["key", "cell", "n"])

    owned = rows.mapInArrow(sentences, f"doc_id {kind}, label int, sentence string").groupBy("sentence").agg(F.min(F.struct("label", "doc_id")).alias("x"))
    whole = owned.groupBy("x").agg(F.collect_list("sentence").alias("sentences"))
    cells = whole.select(F.pmod(F.xxhash64("x.doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half"), "x.label", "sentences").mapInArrow(seen, "key string, cell int, n long")
    counts = cells.groupBy("key").agg(*[F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)])
    toxic, clean = F.col("n0") + F.col("n2"), F.col("n1") + F.col("n3")
    one = counts.where(toxic > 0).orderBy(toxic.desc(), "key").limit(2 * MOST_WINDOWS)
    two = counts.where(~F.col("key").endswith("~") & (clean > 0)).orderBy(clean.desc(), "key").limit(MOST_WINDOWS)
    three = counts.where(~F.col("key").endswith("~") & (toxic == 0)).orderBy(F.xxhash64("key"), "key").limit(MOST_WINDOWS)
    out = {r[0]: tuple(r[1:]) for r in itertools.chain(one.collect(), two.collect(), three.collect())}
    return out, out.pop("", (0, 0, 0, 0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = PER_LABEL) -> ToxicityModel:
    """Fit on a bounded sample of the labelled documents given. If they show no difference, every text scores low."""
    rows = labelled_documents(docs, labels, label, per_label)
    aside = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATE)) == 0
    model = train(*_counts(rows.where(~aside)))
    if model is None:
        return ToxicityModel()
    shared = Shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            top = top_values(shared.value, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(top.tolist(), pa.list_(pa.float64())), b.column("label").cast(pa.int32())], ["top", "label"])

    got = rows.where(aside).mapInArrow(run, "top array<double>, label int").collect()
    model.calibrate(np.array([r.top for r in got]).reshape(-1, TOP), np.array([r.label for r in got]))
    return model


def predict(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row; null and empty texts have no word and score as such. Other columns are ignored."""
    shared = Shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            score = shared.value.score(top_values(shared.value, b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
