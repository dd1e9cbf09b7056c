"""Language identification of mixed texts.

Each word gets a score for every learned language: its log-likelihood under a character
trigram model. The word's script narrows the candidates to the languages that use this
script. A Viterbi pass with a penalty for switching labels each word, so runs of one
language come out as spans; a text's language is that of most of its words.

Fitting reads a sample of at most about PER_LANGUAGE whole documents for each language,
and the model keeps MOST_TRIGRAMS trigrams.
"""

from __future__ import annotations

import math
import re
import sys
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Shipped, slices, worker_cache
from quarry.llm.sampling import bounded_sample

PER_LANGUAGE = 1500
MOST_TRIGRAMS = 200_000
SWITCH = 12.0  # nats
CLIP = 6.0  # most a word can speak against a language
OTHER_SCRIPT = 2 * CLIP
#: A language uses a script if this part of its words is written in it.
SCRIPT_SHARE = 0.05
#: The language stage of a pipeline rejects texts with a lower score.
LEAST_SCORE = 0.3
MOST_WORDS_CACHED = 300_000
UNDETERMINED = "und"

# First code points of scripts; a range lasts to the next one.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFF21, "latin"), (0xFF5B, "other"), (0x20000, "han"), (0x30000, "other"),
]
_STARTS = [s for s, _ in SCRIPTS]
_WORD = re.compile(r"[^\W\d_]+")
# Letters only: _WORD has number signs too (superscripts, fractions, numbers in circles). Slow, so for texts that have some
_SIGNS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_LETTERS = re.compile(rf"[^\W\d_{_SIGNS}]+")


def script_of(word: str) -> str:
    import bisect

    return SCRIPTS[bisect.bisect_right(_STARTS, ord(word[0])) - 1][1]


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    words = _WORD.findall(low)
    return words if "".join(words).isalpha() else _LETTERS.findall(low)


class LanguageModel:
    def __init__(self, languages: list[str], trigrams: dict[tuple[str, str], int], scripts: dict[tuple[str, str], int]) -> None:
        """trigrams, scripts: counts by (language, trigram) and by (language, script)."""
        self.name = uuid.uuid4().hex
        self.languages = sorted(languages)
        at = {x: i for i, x in enumerate(self.languages)}
        n = len(self.languages)
        counts: dict[str, np.ndarray] = {}
        for (lang, tri), k in trigrams.items():
            counts.setdefault(tri, np.zeros(n))[at[lang]] += k
        kept = sorted(counts, key=lambda t: (-counts[t].sum(), t))[:MOST_TRIGRAMS]
        total = sum((counts[t] for t in kept), np.zeros(n))
        follow: dict[str, np.ndarray] = {}
        for t in kept:
            follow.setdefault(t[:2], np.zeros(n))
            follow[t[:2]] += counts[t]
        base = {}
        for t in kept:
            base.setdefault(t[2], np.zeros(n))
            base[t[2]] += counts[t]
        letters = len(base) + 1
        single = {c: (v + 0.5) / (total + 0.5 * letters) for c, v in base.items()}
        # Trigram probabilities backed off to those of the letter, with weight 2
        self.log = {t: [math.log(x) for x in (counts[t] + 2.0 * single[t[2]]) / (follow[t[:2]] + 2.0)] for t in kept}
        self.unseen = [math.log(0.5 / (x + 1.0)) for x in np.minimum(total, 200.0)]
        uses: dict[str, list[int]] = {}
        words = Counter()
        for (lang, _), k in scripts.items():
            words[lang] += k
        for (lang, script), k in scripts.items():
            if k >= SCRIPT_SHARE * words[lang]:
                uses.setdefault(script, []).append(at[lang])
        self.uses = {s: sorted(v) for s, v in uses.items()}

    def word(self, word: str) -> list[float]:
        """Scores by language: 0 for the likeliest, below for others."""
        n = len(self.languages)
        sums = [0.0] * n
        log, unseen = self.log, self.unseen
        padded = f"^^{word}$"
        for i in range(len(padded) - 2):
            row = log.get(padded[i : i + 3], unseen)
            for k in range(n):
                sums[k] += row[k]
        could = self.uses.get(script_of(word))
        if could is None:
            return [0.0] * n
        best = max(sums[k] for k in could)
        out = [-OTHER_SCRIPT] * n
        for k in could:
            out[k] = max(sums[k] - best, -CLIP)
        return out


class _Scores(dict):
    """Row numbers of words in a growing matrix of their scores."""

    def __init__(self, model: LanguageModel) -> None:
        super().__init__()
        self.model, self.rows = model, np.empty((1024, len(model.languages)))

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k == len(self.rows):
            self.rows = np.concatenate((self.rows, np.empty_like(self.rows)))
        self.rows[k] = self.model.word(word)
        self[word] = k
        return k


def _scores(model: LanguageModel) -> _Scores:
    cache = worker_cache("langid")
    if cache.get("name") != model.name or len(cache["scores"]) > MOST_WORDS_CACHED:
        cache.update(name=model.name, scores=_Scores(model))
    return cache["scores"]


def viterbi(s: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each row of scores s, where a change of label costs switch.

    If against the label with the largest sum no other gains more than switch / 2 over any
    stretch, that label throughout is the best path, and no search is made.
    """
    n, k = s.shape
    top = int(s.sum(0).argmax())
    gain = np.cumsum(s - s[:, top : top + 1], axis=0)
    low = np.minimum(np.minimum.accumulate(np.vstack((np.zeros(k), gain[:-1])), axis=0), 0.0)
    if (gain - low).max() <= switch / 2:
        return np.full(n, top)
    back, best = [], s[0].tolist()
    for row in s[1:].tolist():
        lead = max(range(k), key=best.__getitem__)
        floor = best[lead] - switch
        came = [j if best[j] >= floor else lead for j in range(k)]
        best = [max(best[j], floor) + row[j] for j in range(k)]
        back.append(came)
    at = max(range(k), key=best.__getitem__)
    out = [at]
    for came in reversed(back):
        at = came[at]
        out.append(at)
    return np.array(out[::-1])


def label(model: LanguageModel, text: str | None) -> tuple[str, float, np.ndarray | None]:
    """(language, score, label of each word). score: the part of the words in that language, shaded by how clear they are."""
    words = words_of(text)
    if not words or not model.languages:
        return UNDETERMINED, 0.0, None
    known = _scores(model)
    rows = [known[w] for w in words]
    s = known.rows[rows]
    path = viterbi(s)
    counts = np.bincount(path, minlength=len(model.languages))
    sums = s.sum(0)
    top = max(range(len(counts)), key=lambda k: (counts[k], sums[k]))
    own = s[path == top]
    # Probability of the language over the words it was given, from the mean scores of a few words
    odds = np.exp(np.clip((own.mean(0) - own.mean(0)[top]) * min(len(own), 20), -50, 50))
    return model.languages[top], float(counts[top] / len(words) / odds.sum()), path


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key: tuple[str, ...] = ("doc_id",), per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on a bounded sample of the rows with a language and a text. No such rows: a model without languages, which answers `und`."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    taken = bounded_sample(rows, lang_col, per_language, list(key)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scripts = Counter(), Counter()
        for b in slices(batches):
            words = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                words.update((lang, w) for w in words_of(text))
            for (lang, w), k in words.items():
                scripts[lang, script_of(w)] += k
                padded = f"^^{w}$"
                for i in range(len(padded) - 2):
                    grams[lang, padded[i : i + 3]] += k
        for kind, counts in (("t", grams), ("s", scripts)):
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.string()), pa.array([x for x, _ in keys], pa.string()), pa.array([x for _, x in keys], pa.string()), pa.array([counts[x] for x in keys], pa.int64())], ["kind", "lang", "gram", "n"])

    counts = taken.mapInArrow(count, "kind string, lang string, gram string, n long").groupBy("kind", "lang", "gram").agg(F.sum("n").alias("n"))
    # The commonest trigrams only, so what comes to the driver is bounded
    tri = counts.where("kind = 't'").orderBy(F.desc("n"), "lang", "gram").limit(2 * MOST_TRIGRAMS).collect()
    scripts = counts.where("kind = 's'").collect()
    return LanguageModel(sorted({r.lang for r in scripts}), {(r.lang, r.gram): r.n for r in tri}, {(r.lang, r.gram): r.n for r in scripts})


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", columns: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """columns, lang_pred, score and, if asked for, spans (lang, first and end character) for each row.

    Null text and text without letters: `und`, score 0. Ties go to the language with the larger
    sum of scores, then to the first in the alphabet.
    """
    shared = Shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            texts = b.column("_text").to_pylist()
            found = [label(m, t) for t in texts]
            out = [*b.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            names = [*b.schema.names[:-1], "lang_pred", "score"]
            if spans:
                out.append(pa.array([_spans(m, t, p) for t, (_, _, p) in zip(texts, found, strict=True)], pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(out, names)

    kept = docs.select(*columns, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])
    return kept.mapInArrow(run, schema + ", lang_pred string, score double" + ", spans array<struct<lang:string,start:int,end:int>>" * spans)


def _spans(model: LanguageModel, text: str | None, path: np.ndarray | None) -> list[dict]:
    out: list[dict] = []
    if path is not None:
        low = text.lower()
        pattern = _WORD if "".join(_WORD.findall(low)).isalpha() else _LETTERS
        for m, k in zip(pattern.finditer(low), path.tolist(), strict=True):
            if out and out[-1]["lang"] == model.languages[k]:
                out[-1]["end"] = m.end()
            else:
                out.append({"lang": model.languages[k], "start": m.start(), "end": m.end()})
    return out


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """docs whose language is found with a score of at least `least`; all columns, as they are."""
    shared = Shipped(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [label(shared.value, t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
