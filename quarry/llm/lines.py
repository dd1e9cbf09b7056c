"""Repeated passages across documents: winnowing over line hashes.

A document is the sequence of its non-blank lines. A gram is the shortest run of whole
lines from a line on that has GRAM words; a window is the shortest run from a line on
that has WINDOW words. In each window the gram with the least hash is selected (the last
one of equals). What a window selects depends on its lines only, so every run of
WINDOW words and more that two documents share has a selected gram in both.

Occurrences of a gram are ordered by document id and line. The lines before and after, as
far as a window reaches, travel with the gram; beyond that another selected gram takes
over. A gram with its k lines before (or after) is a key, for every k, and the first
occurrence of a key its source. So each occurrence is extended, on either side, as far as
any earlier one agrees with it, and no pairs are made. Lines of matches are deleted, so
the first occurrence of a passage stays. Repeats inside one document are also found and
extended while it is read.

Rows are keyed by id and a hash of the text; rows that repeat (equal id and text) count
as one document and share its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import fresh, id_kind, id_of, slices, stored

GRAM, WINDOW = 30, 50

_RUN = pa.struct([("first", pa.int32()), ("last", pa.int32())])
_GRAM = pa.struct([("gram", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64()))])


def lines_of(text: str | None) -> list[str]:
    return [x for x in text.split("\n") if x.strip()] if text else []


def line_hashes(lines: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(x.encode("utf-8")) for x in lines], np.uint64).view(np.int64)


def selected(lines: list[str]) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]]]:
    """Line hashes and (gram, first line, last line, first line of its window's reach before, last line after) of the selected grams."""
    import xxhash

    hashes = line_hashes(lines)
    total = np.concatenate(([0], np.cumsum([len(x.split()) for x in lines]))) if lines else np.zeros(1, np.int64)
    n = len(lines)
    gram_end = np.searchsorted(total, total[:-1] + GRAM) - 1
    window_end = np.searchsorted(total, total[:-1] + WINDOW) - 1
    digests: dict[int, int] = {}
    chosen: dict[int, None] = {}
    for i in range(n):
        if window_end[i] >= n:
            break
        best = None
        k = i
        while k < n and gram_end[k] <= window_end[i]:
            if k not in digests:
                digests[k] = xxhash.xxh64_intdigest(hashes[k : gram_end[k] + 1].tobytes(), 1)
            if best is None or digests[k] <= digests[best]:
                best = k
            k += 1
        chosen[best] = None
    out = []
    for k in sorted(chosen):
        end = int(gram_end[k])
        low = int(np.searchsorted(total, total[k] - WINDOW, side="right")) - 1 if total[k] > WINDOW else 0
        high = min(n - 1, int(np.searchsorted(total, total[end + 1] + WINDOW)) - 1)
        out.append((digests[k] - (1 << 64) if digests[k] >> 63 else digests[k], k, end, low, high))
    return hashes, out


def own_repeats(hashes: np.ndarray, grams: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int]]:
    """Runs of lines that repeat earlier lines of the same document."""
    seen: dict[int, int] = {}
    runs: list[tuple[int, int]] = []
    n = len(hashes)
    for g, first, last, _, _ in grams:
        source = seen.setdefault(g, first)
        if source == first or runs and runs[-1][1] >= last:
            continue
        a, b, behind = first, last, first - source
        while a > 0 and a - 1 - behind >= 0 and hashes[a - 1] == hashes[a - 1 - behind]:
            a -= 1
        while b + 1 < n and hashes[b + 1] == hashes[b + 1 - behind]:
            b += 1
        if runs and runs[-1][1] + 1 >= a:
            runs[-1] = (min(a, runs[-1][0]), max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, name="lines"):
        own, grams = [], []
        for text in b.column("text").to_pylist():
            hashes, found = selected(lines_of(text))
            own.append([{"first": x, "last": y} for x, y in own_repeats(hashes, found)])
            grams.append([{"gram": g, "first": first, "last": last, "before": hashes[low:first][::-1].tolist(), "after": hashes[last + 1 : high + 1].tolist()} for g, first, last, low, high in found])
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), pa.array(own, pa.list_(_RUN)), pa.array(grams, pa.list_(_GRAM))], ["id", "text_hash", "own", "grams"])


def _keys(side: str):
    """(side, depth, key) for each number of lines, from 0 on, that a gram has on that side."""
    return F.transform(F.sequence(F.lit(0), F.size(side)), lambda k: F.struct(F.lit(side).alias("side"), k.alias("depth"), F.xxhash64("gram", F.lit(side), F.slice(side, F.lit(1), k)).alias("key")))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, first, last, source_id, source_first): runs of non-blank lines, numbered from 0, that repeat earlier ones.

    source_id is null for repeats inside the document. Null and blank texts have no lines; a null id counts as the least. Ids that aren't integers are compared as texts.
    """
    rows = docs.select(id_of(docs, id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    scanned = stored(rows.mapInArrow(_scan, f"id {id_kind(docs, id_col)}, text_hash long, own array<struct<first:int,last:int>>, grams array<struct<gram:long,first:int,last:int,before:array<long>,after:array<long>>>"), "lines")
    grams = scanned.select("id", "text_hash", F.explode("grams").alias("g")).select("id", "text_hash", "g.*")
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    keyed = grams.join(shared, "gram").select("id", "text_hash", "first", "last", F.explode(F.concat(_keys("before"), _keys("after"))).alias("k")).select("id", "text_hash", "first", "last", "k.*")
    sources = keyed.groupBy("key").agg(F.min(F.struct("id", "text_hash", "first")).alias("s"))
    later = keyed.join(sources, "key").where(F.struct("id", "text_hash", "first") != F.col("s"))
    deepest = later.groupBy("id", "text_hash", "first", "last", "side").agg(F.max(F.struct("depth", "s")).alias("x"))
    back, on = (F.when(F.col("side") == x, F.col("x.depth")).otherwise(0) for x in ("before", "after"))
    outside = (F.col("id") != F.col("x.s.id")) | (F.col("text_hash") != F.col("x.s.text_hash"))
    crossed = deepest.select("id", "text_hash", (F.col("first") - back).alias("first"), (F.col("last") + on).alias("last"), F.when(outside, F.col("x.s.id")).alias("source_id"), F.when(outside, F.col("x.s.first") - back).alias("source_first"))
    own = scanned.select("id", "text_hash", F.explode("own").alias("r")).select("id", "text_hash", "r.first", "r.last", F.lit(None).cast(id_kind(docs, id_col)).alias("source_id"), F.lit(None).cast("int").alias("source_first"))
    return crossed.unionByName(own)


def without(text: str, runs: list[dict]) -> tuple[str, int, int]:
    """text without the runs of its non-blank lines; numbers of its non-blank lines and of those deleted."""
    lines = text.split("\n")
    shown = [k for k, x in enumerate(lines) if x.strip()]
    gone = {shown[k] for r in runs for k in range(r["first"], r["last"] + 1)}
    return "\n".join(x for k, x in enumerate(lines) if k not in gone), len(shown), len(gone)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, keep_empty: bool = False, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs without their repeated runs: same columns, texts cut (length_col, if given, is set anew).

    A document all of whose lines are deleted goes, unless keep_empty; others, blank and null ones too, stay.
    counts: names of two more columns, the numbers of non-blank lines and of deleted lines; docs must not have them yet.
    """
    if clashing := {c.lower() for c in counts or ()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has columns {', '.join(sorted(clashing))} already; name the counts otherwise")
    found = repeats(docs, id_col, text_col).groupBy("id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    key, hashed, runs = (fresh(x, docs.columns) for x in ("_id", "_text_hash", "_runs"))
    found = found.select(F.col("id").alias(key), F.col("text_hash").alias(hashed), F.col("runs").alias(runs))
    rows = docs.withColumns({key: id_of(docs, id_col), hashed: F.xxhash64(F.col(text_col))})
    rows = rows.join(found, [key, hashed], "left").select(*docs.columns, runs)
    at, length_at = docs.columns.index(text_col), docs.columns.index(length_col) if length_col else None
    schema = docs.schema
    if counts:
        schema = T.StructType([*schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, cuts = b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            new = [(t, len(lines_of(t)) if counts else 0, 0) if not r else without(t, r) for t, r in zip(texts, cuts, strict=True)]
            columns = list(b.columns)[:-1]
            columns[at] = pa.array([x[0] for x in new], b.schema.field(at).type)
            if length_at is not None:
                lengths = [old if not x[2] else len(x[0]) for x, old in zip(new, b.column(length_at).to_pylist(), strict=True)]
                columns[length_at] = pa.array(lengths, b.schema.field(length_at).type)
            fields = list(b.schema)[:-1]
            if counts:
                columns += [pa.array([x[1] for x in new], pa.int64()), pa.array([x[2] for x in new], pa.int64())]
                fields += [pa.field(c, pa.int64()) for c in counts]
            out = pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))
            yield out if keep_empty else out.filter(pa.array([not x[2] or bool(x[0].strip()) for x in new], pa.bool_()))

    return rows.mapInArrow(run, schema)

