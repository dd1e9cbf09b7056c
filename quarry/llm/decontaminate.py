"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Texts are normalised to words: A-Z lower-cased, then runs of characters other than
ASCII controls, punctuation and blanks. The automaton holds all items; a document's
words stream through it, and at each word the longest suffix that also occurs in an
item is known. A window is WINDOW consecutive words of an item, or a whole item of
fewer words; every word inside an occurrence of a window is a hit.

The automaton is sent to the executors, so its size is bounded: items are dealt into
shards of SHARD_WORDS words at most on average (an automaton of about 70 MB), and each
batch of documents streams through one shard's automaton after another. The driver
builds one shard at a time, and a worker holds at most two of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Shipped, slices

WINDOW = 10
#: A document of which more than this part is hit is removed whole.
COVERAGE = 0.8
SHARD_WORDS = 100_000

_LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_NORMAL = bytes(c if c in _LETTERS else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD_CASED = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_NORMAL).split() if text else []


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items that hold each window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        sequences = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items if ws]
        for _, ids in sequences:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        #: For a state with suffixes of window words: the state of those; whole short items by state.
        self.window_state = [self._holds(v, window) if n >= window else -1 for v, n in enumerate(self.length)]
        self.items: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, object]]] = {}
        self.least = min([window, *(len(ids) for _, ids in sequences)])
        for item, ids in sequences:
            v = 0
            for k, c in enumerate(ids):
                v = self.next[v][c]
                if k + 1 >= window:
                    self.items.setdefault(self.window_state[v], set()).add(item)
            if len(ids) < window:
                self.short.setdefault(self._holds(v, len(ids)), []).append((len(ids), item))
        #: The next state up the suffix links (itself counted) with a whole short item, or -1.
        self.short_up = [-1] * len(self.length)
        for v in sorted(range(len(self.length)), key=self.length.__getitem__):
            self.short_up[v] = v if v in self.short else self.short_up[self.link[v]] if self.link[v] >= 0 else -1

    def _holds(self, v: int, n: int) -> int:
        """The state of the suffix of n words."""
        while self.length[self.link[v]] >= n:
            v = self.link[v]
        return v

    def _clone(self, p: int, c: int) -> int:
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        new = len(self.length)
        self.length.append(self.length[p] + 1)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._clone(last, c)
        new = len(self.length)
        self.length.append(self.length[last] + 1)
        self.next.append({})
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._clone(p, c)
        return new

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans [start, end) of hit words, and the items whose windows occur."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        outside = np.flatnonzero(ids < 0)
        edges = np.concatenate(([-1], outside, [len(ids)]))
        spans: list[tuple[int, int]] = []
        items: set = set()
        for k in np.flatnonzero(np.diff(edges) > self.least).tolist():
            start = int(edges[k]) + 1
            self._stream(ids[start : int(edges[k + 1])].tolist(), start, spans, items)
        return spans, items

    def _stream(self, ids: list[int], start: int, spans: list[tuple[int, int]], items: set) -> None:
        step, link, length, window, short_up = self.next, self.link, self.length, self.window, self.short_up
        v = n = 0
        for at, c in enumerate(ids, start + 1):
            to = step[v].get(c)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = step[v].get(c)
            if to is None:
                n = 0
                continue
            v, n = to, n + 1
            most = 0
            if n >= window:
                # v may hold longer suffixes only, or n may be cut short of them
                u = self.window_state[v]
                items |= self.items[u]
                most = window
            u = short_up[v]
            while u >= 0:
                for m, item in self.short[u]:
                    if m <= n:
                        items.add(item)
                        most = max(most, m)
                u = short_up[link[u]] if link[u] >= 0 else -1
            if most:
                if spans and spans[-1][1] >= at - most:
                    first = min(spans[-1][0], at - most)
                    while len(spans) > 1 and spans[-2][1] >= first:
                        first = min(spans[-2][0], first)
                        del spans[-2]
                    spans[-1] = (first, at)
                else:
                    spans.append((at - most, at))


def _automata(benchmark: DataFrame, item_col: str, text_col: str) -> list:
    """Broadcast automata of the shards (one, unless the items have more than SHARD_WORDS words)."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    shards = max(1, -(-size // SHARD_WORDS))
    out = []
    for k in range(shards):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k).orderBy("item", "text").collect()
        out.append(Shipped(spark, ItemAutomaton([(r.item, words_of(r.text)) for r in rows])))
    return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _scan(automata: list, texts: list[str | None]) -> list[tuple[list[bytes], list[tuple[int, int]], set]]:
    """(words, merged spans, items) of each text. All texts pass one shard's automaton before the next is unpacked."""
    words = [words_of(t) for t in texts]
    found: list[tuple[list[tuple[int, int]], set]] = [([], set()) for _ in texts]
    for a in automata:
        hits = a.value.hits
        for k, w in enumerate(words):
            spans, items = hits(w)
            if spans:
                found[k] = (_merge(found[k][0] + spans) if found[k][0] else spans, found[k][1] | items)
    return [(w, *x) for w, x in zip(words, found, strict=True)]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), spans (of words, [start, end)).

    Null text has no words. Items without words have no windows; a null item_id isn't listed. Empty tables: no rows,
    or no hits. Other columns are ignored.
    """
    automata = _automata(benchmark, item_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n_words, n_hit, ids, spans = [], [], [], []
            for words, found, items in _scan(automata, b.column("text").to_pylist()):
                n_words.append(len(words))
                n_hit.append(sum(e - s for s, e in found))
                ids.append(sorted(i for i in items if i is not None))
                spans.append([{"start": s, "end": e} for s, e in found])
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "item_ids", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<start:int,end:int>>")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD_CASED.finditer(text)]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : places[s][0]])
        at = places[e - 1][1]
    out.append(text[at:])
    return " ".join(x for x in (p.strip() for p in out) if x)


def cleaner(automata: list, coverage: float) -> Callable[[list[str | None]], list[str | None]]:
    def clean(texts: list[str | None]) -> list[str | None]:
        """The texts without hits; None for one that was hit beyond the coverage limit or of which nothing is left."""
        out, at, first = list(texts), list(range(len(texts))), True
        while at:  # what a cut brings together may hit again
            again = []
            for k, (words, spans, _) in zip(at, _scan(automata, [out[k] for k in at]), strict=True):
                if not spans:
                    continue
                if first and sum(e - s for s, e in spans) > coverage * len(words):
                    out[k] = None
                elif new := cut(out[k], spans):
                    out[k] = new
                    again.append(k)
                else:
                    out[k] = None
            at, first = again, False
        return out

    return clean


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str | None = None, coverage: float = COVERAGE) -> DataFrame:
    """docs without hit spans: same columns, texts cut (length_col, if given, is set anew); documents hit beyond coverage go.

    Texts without a hit stay as they are, null and empty ones too.
    """
    automata = _automata(benchmark, "item_id", "text")
    clean = cleaner(automata, coverage)
    at, length_at = docs.columns.index(text_col), docs.columns.index(length_col) if length_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            new = clean(texts)
            keep = pa.array([t is None or n is not None for t, n in zip(texts, new, strict=True)], pa.bool_())
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if length_at is not None:
                n_chars = [old if n == t else None if n is None else len(n) for t, n, old in zip(texts, new, b.column(length_at).to_pylist(), strict=True)]
                columns[length_at] = pa.array(n_chars, b.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def report(found: DataFrame) -> DataFrame:
    """The digest columns of find(): items_sha256 and contaminated."""
    ids = F.array_join("item_ids", ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(ids, "utf-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item, w, least(len(w), {WINDOW}) AS m FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, m, list_aggregate(w[i : i + m - 1], 'string_agg', ' ') AS gram FROM (SELECT item, w, m, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM s)),
sizes AS (SELECT DISTINCT m FROM g),
p AS (SELECT r, w, m, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM d, sizes WHERE len(w) >= m),
h AS (SELECT p.r, p.i, p.m, g.item FROM (SELECT r, i, m, list_aggregate(w[i : i + m - 1], 'string_agg', ' ') AS gram FROM p) p JOIN g ON p.gram = g.gram AND p.m = g.m),
n AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS x FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""
