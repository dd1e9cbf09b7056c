"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

A 64-bit fingerprint is cut into 6 blocks. Two fingerprints that differ in 3 bits at
most agree on at least 3 whole blocks, so each fingerprint goes to the 20 buckets that
its choices of 3 blocks name, and every close pair shares a bucket. Exact copies are
folded to one fingerprint first. A bucket isn't expanded into pairs: its task verifies
Hamming distances in memory and gives one link for each fingerprint to the smallest id
it is connected to inside the bucket. A bucket above SPLIT rows is dealt once more by
the same rule over its free bits; the buckets of that second level can't hold more than
2**18 different fingerprints, whatever the data, so no row is ever dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import NO_ID, fresh, id_kind, id_of, slices, stored
from quarry.llm.graph import components

SHINGLE, SEED, FAR = 3, 42, 3
BLOCKS, AGREE = 6, 3
#: Rows of a bucket that one task compares directly.
SPLIT = 2048


def bit_blocks(bits: list[int], n: int) -> list[int]:
    """Masks of n runs of the given bit positions, as even as can be."""
    cut = [round(i * len(bits) / n) for i in range(n + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cut, cut[1:], strict=False)]


def agreement_masks(bits: list[int]) -> list[int]:
    """One mask for each choice of AGREE of BLOCKS blocks of these bits."""
    return [sum(c) for c in combinations(bit_blocks(bits, BLOCKS), AGREE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -SHINGLE] + 1))
    ends = ends[SHINGLE - 1 :]
    digest, n, ones = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = zip(starts[i : i + (1 << 16)].tolist(), ends[i : i + (1 << 16)].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in part], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _simhash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        fps = np.fromiter((simhash(t) for t in b.column("text").to_pylist()), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), pa.array(fps)], ["id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fp): a row for each row of docs; null ids as the least long, null text as empty."""
    rows = docs.select(id_of(docs, id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_simhash_batches, f"id {id_kind(docs, id_col)}, text_hash long, fp long")


def _stars(reached: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each group's members to its smallest id."""
    a, b = [], []
    for group in reached:
        own = ids[group]
        least = own.min()
        own = own[own != least]
        a.append(own)
        b.append(np.full(len(own), least))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2


def close_groups(fps: np.ndarray) -> list[np.ndarray]:
    """Index groups (of two and more) connected by steps of FAR differing bits at most; compares all of a bucket of SPLIT rows at most."""
    left, out = np.arange(len(fps)), []
    while len(left):
        group, front = left[:1], left[:1]
        left = left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(front), 256):
                near |= (np.bitwise_count(fps[front[i : i + 256], None] ^ fps[None, left]) <= FAR).any(0)
            front, left = left[near], left[~near]
            group = np.concatenate((group, front))
        if len(group) > 1:
            out.append(group)
    return out


def close_groups_dense(fps: np.ndarray, free: list[int]) -> list[np.ndarray]:
    """As close_groups, for different fingerprints that differ in the free bits only: neighbours are looked up in a table of all values."""
    code = np.zeros(len(fps), np.int64)
    for k, bit in enumerate(free):
        code |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    at = np.full(1 << len(free), -1, np.int64)
    at[code] = np.arange(len(fps))
    flips = np.array([sum(1 << k for k in c) for n in range(1, FAR + 1) for c in combinations(range(len(free)), n)], np.int64)
    new, out = np.ones(len(fps), bool), []
    for seed in range(len(fps)):
        if not new[seed]:
            continue
        new[seed] = False
        group, front = [np.array([seed])], np.array([seed])
        while len(front):
            found = []
            for i in range(0, len(front), 2048):
                to = at[(code[front[i : i + 2048], None] ^ flips).ravel()]
                to = np.unique(to[to >= 0])
                to = to[new[to]]
                new[to] = False
                found.append(to)
            front = np.concatenate(found)
            group.append(front)
        if (members := np.concatenate(group)).size > 1:
            out.append(members)
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], bound: int) -> Iterator[tuple[np.ndarray, dict, bool]]:
    """From sorted batches: (starts of runs of equal keys, columns, False); a run above bound comes in parts, marked True."""
    held: dict | None = None
    flowing = False  # the run at hand has parts that went out already
    for b in batches:
        cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
        if held is not None:
            cols = {n: np.concatenate((held[n], cols[n])) for n in cols}
        n = len(cols[keys[0]])
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            new[1:] |= cols[k][1:] != cols[k][:-1]
        starts = np.flatnonzero(new)
        last = starts[-1]
        if flowing and len(starts) > 1:  # the rest of the long run
            yield np.array([0]), {k: v[: starts[1]] for k, v in cols.items()}, True
            cols, starts = {k: v[starts[1] :] for k, v in cols.items()}, starts[1:] - starts[1]
            last, flowing = starts[-1], False
        if len(starts) > 1:
            yield starts[:-1], {k: v[:last] for k, v in cols.items()}, False
        held = {k: v[last:] for k, v in cols.items()}
        if len(held[keys[0]]) > bound:
            yield np.array([0]), held, True
            held, flowing = {k: v[-1:] for k, v in held.items()}, True
    if held is not None and (not flowing or len(held[keys[0]]) > 1):
        yield np.array([0]), held, flowing


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of small buckets; the rows of large ones go on, with c >= 0."""
    for starts, x, large in _runs(batches, ["c", "key"], SPLIT):
        n, fps = len(x["c"]), x["fp"].view(np.uint64)
        if large:
            yield _out(x["id"], x["fp"], x["c"])
            continue
        sizes = np.diff(np.append(starts, n))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= FAR]
        a, b, big = [x["id"][two]], [x["id"][two + 1]], []
        for s, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if m > SPLIT:
                big.append(slice(s, s + m))
                continue
            u, v = _stars(close_groups(fps[s : s + m]), x["id"][s : s + m])
            a.append(u)
            b.append(v)
        a, b = np.concatenate(a), np.concatenate(b)
        yield _out(a, b, np.full(len(a), -1, np.int32))
        for s in big:
            yield _out(x["id"][s], x["fp"][s], x["c"][s])


def _out(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32())], ["a", "b", "c"])


def _second_level() -> list[tuple[int, int]]:
    """(first choice, mask) of the second level, in the order of its numbers c."""
    out = []
    for c, mask in enumerate(agreement_masks(list(range(64)))):
        out += [(c, mask | more) for more in agreement_masks([b for b in range(64) if not mask >> b & 1])]
    return out


def _dense_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = [m for _, m in _second_level()]
    for starts, x, _ in _runs(batches, ["c", "key"], 1 << 40):
        ends = np.append(starts[1:], len(x["c"]))
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            fps, first = np.unique(x["fp"][s:e].view(np.uint64), return_index=True)
            if len(fps) > 1:
                mask = masks[int(x["c"][s])]
                groups = close_groups(fps) if len(fps) <= SPLIT else close_groups_dense(fps, [b for b in range(64) if not mask >> b & 1])
                a, b = _stars(groups, x["id"][s:e][first])
                yield _out(a, b, np.full(len(a), -1, np.int32))


def _buckets(rows: DataFrame, choices: list) -> DataFrame:
    """rows (id, fp) in their buckets (c, key): choices is a list of (number, mask) columns as structs."""
    out = rows.select("id", "fp", F.explode(F.array(*choices)).alias("x")).select("x.c", "x.key", "fp", "id")
    return out.repartition(F.col("c"), F.col("key")).sortWithinPartitions("c", "key", "id")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b), b < a, that connect what steps of FAR bits connect; fps: (id, fp), one row for each fingerprint."""
    choices = [F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for c, m in enumerate(agreement_masks(list(range(64))))]
    first = stored(_buckets(fps, choices).mapInArrow(_links, "a long, b long, c int"), "links")
    large = first.where("c >= 0").select(F.col("a").alias("id"), F.col("b").alias("fp"), F.col("c").alias("c0"))
    at: dict[int, list] = {}
    for k, (c, m) in enumerate(_second_level()):
        at.setdefault(c, []).append(F.struct(F.lit(k).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")))
    out = first.where("c < 0").select("a", "b")
    for c in sorted(r[0] for r in large.select("c0").distinct().collect()):  # 20 values at most
        rows = large.where(F.col("c0") == c).select("id", "fp")
        out = out.unionAll(_buckets(rows, at[c]).mapInArrow(_dense_links, "a long, b long, c int").select("a", "b"))
    return out


def reached(fps: DataFrame) -> DataFrame:
    """(fp, component) for every fingerprint with a link; component is the least one that steps of FAR bits reach. fps: (fp), each once."""
    return components(links(fps.select(F.col("fp").alias("id"), "fp"))).select(F.col("node").alias("fp"), "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fp, component, component_id): a row for each row of docs.

    Fingerprints are linked, not ids: component is the least fingerprint reachable, and
    component_id the smallest id of its rows. Null text counts as empty (fingerprint 0). A
    null id is NO_ID (ids that aren't integers are texts, null the empty one), and no component is named by it unless it has no other id. Rows that
    repeat give repeated rows; rows that share an id but not a text are rows of their own.
    Other columns are ignored. Empty table: no rows.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "simhash")
    none = F.lit(NO_ID if id_kind(docs, id_col) == "long" else "")
    fps = rows.groupBy("fp").agg(F.min(F.when(F.col("id") != none, F.col("id"))).alias("id"))
    named = fps.join(reached(fps), "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.coalesce(F.min("id"), none).alias("component_id"))
    return rows.join(named.select("fp", "component").join(least, "component"), "fp").select("id", "text_hash", "fp", "component", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of its smallest id (then the smallest text hash); all columns, as they are."""
    found = near_duplicates(docs, id_col, text_col)
    least = found.groupBy("component").agg(F.min(F.struct("id", "text_hash")).alias("x"))
    key, hashed = fresh("_id", docs.columns), fresh("_text_hash", docs.columns)
    chosen = least.select(F.col("x.id").alias(key), F.col("x.text_hash").alias(hashed))
    rows = docs.withColumns({key: id_of(docs, id_col), hashed: F.xxhash64(F.col(text_col))})
    return rows.join(chosen, [key, hashed]).dropDuplicates([key, hashed]).select(*docs.columns)


def hex16(fp) -> object:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
