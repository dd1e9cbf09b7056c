"""Near-duplicates: SimHash and banded minima lead to candidates, then word shingles are compared exactly.

A document is the set of its runs of `shingle` words (A-Z and ASCII white space folded; a
shorter text is one shingle, a blank one the empty set). Equal sets of equal fingerprints
are folded first. Fingerprints, their links at FAR bits and the components of these are
those of `simhash`; two texts that it links are always compared. Its distance leads to few
of the pairs near the limit, so BANDS keys of ROWS minima each lead to candidates as well;
two sets of similarity 0.8 share such a key with probability 1 - (1 - 0.8**4)**24, more than
0.99999, and more above. Sets that share a key or a component are linked to the least of
them, not expanded into pairs. The components of these links are candidate groups; a group's
texts are brought together once, and there sets that share a key, or whose fingerprints are
close, are compared exactly. Sets already reached aren't compared again, so a large group of
near copies costs about one comparison each.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_path, fresh, id_kind, id_of, shared_path, slices, stored
from quarry.llm.graph import components
from quarry.llm.simhash import FAR, reached, simhash
from quarry.llm.warc import open_fs

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS, SEED = 24, 4, 42
#: Shingles of a candidate group held in memory; those of a larger one lie in a file of the shared folder (in memory where that is no mounted path).
HELD = 1 << 24
#: Shingles compared at once.
PART = 1 << 20

_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64, endpoint=False)
_TIMES = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64, endpoint=False) | np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1))
    spans = zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, len(starts)))


def band_keys(found: np.ndarray) -> np.ndarray:
    """BANDS keys of a set; none for the empty set."""
    import xxhash

    if not len(found):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(found), 4096):
        least = np.minimum(least, ((found[i : i + 4096] ^ _FLIP) * _TIMES).min(1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), c) for c, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _mark(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches, name="similar"):
            same, keys, fps = [], [], []
            for text in b.column("text").to_pylist():
                found = shingles(text, size)
                same.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                keys.append(band_keys(found))
                fps.append(simhash(text))
            same, fps = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (same, fps))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), same, fps, pa.array(keys, pa.list_(pa.int64()))], ["id", "text_hash", "same", "fp", "keys"])

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, same), sorted: links of each key's sets to the first of them."""
    key, lead = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        k, same = b.column("key").to_numpy(), b.column("same").to_numpy()
        new = np.concatenate(([k[0] != key], k[1:] != k[:-1]))
        leads = np.concatenate(([lead], same[new]))[np.cumsum(new)]
        key, lead = k[-1], leads[-1]
        yield _pairs(same[leads != same], leads[leads != same])


def close_sets(sets: np.ndarray, ends: np.ndarray, keys: np.ndarray, fps: np.ndarray, least: float) -> list[np.ndarray]:
    """Index groups (of two and more) connected by steps of at least that similarity; set i is sets[ends[i]:ends[i + 1]] and has keys[i] and fps[i].

    The last key is a component of fingerprints; of its sets those are compared whose fingerprints differ in FAR bits at most.
    """
    n, sizes = len(keys), np.diff(ends)
    bucket = np.unique(keys.ravel(), return_inverse=True)[1].reshape(keys.shape)
    order = np.argsort(bucket.ravel(), kind="stable")
    cuts = np.flatnonzero(np.diff(bucket.ravel()[order])) + 1
    left = np.split(order // keys.shape[1], cuts)  # of each bucket, the sets not reached yet
    new, out = np.ones(n, bool), []
    for seed in range(n):
        if not new[seed]:
            continue
        new[seed] = False
        group, at = [seed], 0
        while at < len(group):
            u, at = group[at], at + 1
            mine, others = sets[ends[u] : ends[u + 1]], []
            for k in bucket[u]:
                left[k] = left[k][new[left[k]]]
                others.append(left[k])
            others[-1] = others[-1][np.bitwise_count(fps[others[-1]] ^ fps[u]) <= FAR]
            others = np.unique(np.concatenate(others))
            others = others[np.minimum(sizes[others], sizes[u]) >= least * np.maximum(sizes[others], sizes[u]) - 1e-9]
            part = (np.cumsum(sizes[others]) - 1) // PART
            for p in np.unique(part):
                some = others[part == p]
                values = np.concatenate([sets[ends[v] : ends[v + 1]] for v in some])
                hits = mine[np.minimum(np.searchsorted(mine, values), len(mine) - 1)] == values
                common = np.add.reduceat(hits, np.concatenate(([0], np.cumsum(sizes[some])[:-1])), dtype=np.int64)
                some = some[common >= least * (sizes[some] + sizes[u] - common) - 1e-9]
                new[some] = False
                group += some.tolist()
        if len(group) > 1:
            out.append(np.array(group))
    return out


class _Group:
    """The sets of one candidate group. directory: where a large group's sets may lie."""

    def __init__(self, directory: str) -> None:
        target, base = open_fs(directory)
        self.path = f"{base}/{uuid.uuid4().hex}" if isinstance(target, pafs.LocalFileSystem) else None
        self.names, self.fps, self.keys, self.ends, self.held, self.n, self.file = [], [], [], [0], [], 0, None

    def add(self, name: int, found: np.ndarray, fp: int = 0, near: int | None = None) -> None:
        """fp, near: the set's fingerprint and its component, where there are any."""
        self.names.append(name)
        self.fps.append(fp)
        self.keys.append(np.append(band_keys(found), name if near is None else near))
        self.ends.append(self.ends[-1] + len(found))
        self.held.append(found)
        self.n += len(found)
        if self.n > HELD and self.path:
            if not self.file:
                os.makedirs(os.path.dirname(self.path), exist_ok=True)
                self.file = open(self.path, "wb")  # noqa: SIM115, closed in links()
            np.concatenate(self.held).tofile(self.file)
            self.held, self.n = [], 0

    def links(self, least: float) -> pa.RecordBatch:
        sets = np.concatenate(self.held) if self.held else np.empty(0, np.uint64)
        if self.file:
            sets.tofile(self.file)
            self.file.close()
            sets = np.memmap(self.path, np.uint64, "r")
            os.remove(self.path)  # the mapping keeps it
        names, a, b = np.array(self.names, np.int64), [], []
        for group in close_sets(sets, np.array(self.ends), np.array(self.keys), np.array(self.fps, np.int64).view(np.uint64), least):
            a.append(names[group[1:]])
            b.append(np.full(len(group) - 1, names[group[0]]))
        return _pairs(np.concatenate(a), np.concatenate(b)) if a else _pairs(names[:0], names[:0])


def _links(size: int, least: float, directory: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (blob, same, fp, near, text), sorted: links that the exact check leaves."""
        blob, group = None, _Group(directory)
        for b in slices(batches):
            for at, same, fp, near, text in zip(*(b.column(c).to_pylist() for c in ("blob", "same", "fp", "near", "text")), strict=True):
                if at != blob:
                    if len(group.names) > 1:
                        yield group.links(least)
                    blob, group = at, _Group(directory)
                if not group.names or (group.names[-1], group.fps[-1]) != (same, fp):
                    group.add(same, shingles(text, size), fp, near)
        if len(group.names) > 1:
            yield group.links(least)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(id, text_hash, component): a row for each row of docs; rows connected by steps of at least that similarity share a component.

    Null text counts as empty, and all empty texts as equal; a null id counts as the least id. Ids that aren't integers are compared as texts.
    """
    rows = docs.select(id_of(docs, id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    marked = stored(rows.mapInArrow(_mark(shingle), f"id {id_kind(docs, id_col)}, text_hash long, same long, fp long, keys array<long>"), "shingles")
    sets = stored(marked.where(F.size("keys") > 0).groupBy("same", "fp").agg(F.min(F.struct("id", "text_hash")).alias("x"), F.first("keys").alias("keys")), "sets")
    near = reached(sets.select("fp").distinct()).withColumnRenamed("component", "near")
    named = stored(sets.select("x", "same", "fp").join(near, "fp", "left").withColumn("near", F.coalesce("near", "fp")), "near")
    keyed = sets.select("same", F.explode("keys").alias("key")).unionAll(named.select("same", F.col("near").alias("key")))
    keyed = keyed.repartition(F.col("key")).sortWithinPartitions("key", "same")
    blobs = components(keyed.mapInArrow(_leads, "a long, b long"))
    wanted = named.join(blobs.select(F.col("node").alias("same"), F.col("component").alias("blob")), "same").select("x.id", "x.text_hash", "same", "fp", "near", "blob")
    texts = rows.join(wanted, ["id", "text_hash"]).select("blob", "same", "fp", "near", "text").repartition(F.col("blob")).sortWithinPartitions("blob", "same", "fp")
    directory = shared_path(docs.sparkSession, "groups")
    label = components(texts.mapInArrow(_links(shingle, least, directory), "a long, b long"))
    drop_path(docs.sparkSession, directory)  # what tasks that were lost left there
    label = label.select(F.col("node").alias("same"), "component")
    return marked.select("id", "text_hash", "same").join(label, "same", "left").select("id", "text_hash", F.coalesce("component", "same").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """docs with one row of each component: that of its smallest id (then the smallest text hash); all columns, as they are."""
    found = near_duplicates(docs, id_col, text_col, shingle, least).groupBy("component").agg(F.min(F.struct("id", "text_hash")).alias("x"))
    key, hashed = fresh("_id", docs.columns), fresh("_text_hash", docs.columns)
    chosen = found.select(F.col("x.id").alias(key), F.col("x.text_hash").alias(hashed))
    rows = docs.withColumns({key: id_of(docs, id_col), hashed: F.xxhash64(F.col(text_col))})
    return rows.join(chosen, [key, hashed]).dropDuplicates([key, hashed]).select(*docs.columns)
