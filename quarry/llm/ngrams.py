"""Interpolated modified Kneser-Ney language model: counted by Spark, stored as sorted hash arrays, mapped by workers.

Tokens are words between ASCII white space, A-Z lower-cased, and one end token a text. An
n-gram is known by a 64-bit hash of its words' 48-bit hashes; the hash's high bits name its
shard, so n-grams of one frequent word are spread over all shards.

1. Tasks count the n-grams of the highest order in their texts and send each shard one
   array. Shards merge them, write a sorted array with counts, and send to the shards of the
   next lower order what those need: a left extension for each n-gram's suffix, and sums for
   each context. So order follows order in one job.
2. A lower order counts different left extensions; an n-gram that begins a text has none and
   counts as often as it occurs. A context holds its sum and how many continuations were
   seen once, twice and more.
3. Workers map the arrays of all orders and look up the n-grams of a batch in hash order:

   p(w | h) = max(a(hw) - D(a(hw)), 0) / sum(h) + gamma(h) p(w | h'), ending with 1 / (V + 1).

Arrays keep, within buckets of about 8 n-grams, 32 bits of the hash: two n-grams are taken
for each other with a chance of about 2e-9. The model lies in the shared folder; a worker
maps its files where that is a local path of all machines, and reads them whole elsewhere.
Defined cases: null text counts as empty (one end token); without training rows every
token has the chance 1; rows that repeat count again; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import shared_path, slices, worker_cache
from quarry.llm.warc import open_fs

ORDER = 2
BEGIN, END = 0, 1
WORD_BITS = 48
#: Tokens counted in memory before they are sent; tokens of the training texts for each shard, and the least number of shards.
FLUSH, PER_SHARD, LEAST_SHARDS = 2_000_000, 500_000, 64
_U = np.uint64
_COLUMNS = ("a", "c", "s", "n1", "n2", "n3")  # count, raw count, a context's sum, its continuations seen once, twice, more often
ROWS = "level int, shard int, data binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def key_of(words: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams given as a list of their words' hashes, first words first."""
    h = np.zeros(len(words[0]), _U)
    for w in words:
        h = _mixed(h * _U(0x9E3779B97F4A7C15) + w + _U(1))
    return h


def _word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    f = xxhash.xxh64_intdigest
    h = np.fromiter((f(w) for w in words), _U, len(words)) & _U((1 << WORD_BITS) - 1)
    return np.maximum(h, _U(2))


def streams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of BEGIN, the words and END of each text, one text after another, and where each begins."""
    lower = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    split = pc.ascii_split_whitespace(lower)
    numbered = split.flatten().dictionary_encode()
    number, names = np.asarray(numbered.indices), numbered.dictionary.to_pylist()
    offsets = np.asarray(split.offsets).astype(np.int64) - split.offsets[0].as_py()
    hashes = _word_hashes(names) if names else np.zeros(0, _U)
    if "" in names:  # white space at the ends
        real = number != names.index("")
        before = np.concatenate([[0], np.cumsum(real)])
        number, offsets = number[real], before[offsets]
    n = len(offsets) - 1
    starts = offsets + 2 * np.arange(n + 1)
    out = np.empty(starts[-1], _U)
    lengths = np.diff(offsets)
    out[np.arange(len(number)) + 2 * np.repeat(np.arange(n), lengths) + 1] = hashes[number] if len(number) else 0
    out[starts[:-1]], out[starts[1:] - 1] = BEGIN, END
    return out, starts


def _grams(stream: np.ndarray, starts: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, end positions): of order `order` wherever so many words stand in one text, shorter ones that begin a text."""
    place = np.arange(len(stream)) - np.repeat(starts[:-1], np.diff(starts))
    yield order, np.flatnonzero(place >= order - 1)
    for level in range(2, order):
        yield level, np.flatnonzero(place == level - 1)


def _pack(words: list[np.ndarray], columns: list[np.ndarray]) -> bytes:
    parts = [np.array([len(words[0])], "<i8").tobytes()]
    for w in words:
        parts += [(w & _U(0xFFFFFFFF)).astype("<u4").tobytes(), (w >> _U(32)).astype("<u2").tobytes()]
    return b"".join(parts + [c.astype("<i8").tobytes() for c in columns])


def _unpack(data: bytes, level: int, columns: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    n, at, words = int(np.frombuffer(data, "<i8", 1)[0]), 8, []
    for _ in range(level):
        low, high = np.frombuffer(data, "<u4", n, at), np.frombuffer(data, "<u2", n, at + 4 * n)
        words.append(low.astype(_U) | (high.astype(_U) << _U(32)))
        at += 6 * n
    return words, [np.frombuffer(data, "<i8", n, at + 8 * n * k) for k in range(columns)]


def _width(level: int, order: int) -> int:
    return 1 if level == order else len(_COLUMNS)


def _sent(level: int, words: list[np.ndarray], columns: list[np.ndarray], bits: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows (level, shard, data) of n-grams, by shard."""
    shard = (key_of(words) >> _U(64 - bits)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[by], np.arange((1 << bits) + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        at = by[cuts[s] : cuts[s + 1]]
        yield level, s, _pack([w[at] for w in words], [c[at] for c in columns])


def _merged(words: list[np.ndarray], columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sorted keys, words and summed columns of the different n-grams."""
    key = key_of(words)
    by = np.argsort(key)
    key = key[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], [w[by[first]] for w in words], [np.add.reduceat(c[by], first) if len(first) else c[:0] for c in columns]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    level, shard, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(shard, pa.int32()), pa.array(data, pa.binary())], ["level", "shard", "data"])


def _counter(order: int, bits: int):
    """Texts to rows of counted n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for level, found in held.items():
                words = [np.concatenate([x[i] for x in found]) for i in range(level)]
                found.clear()
                _, words, (n,) = _merged(words, [np.ones(len(words[0]), np.int64)])
                zero = np.zeros(len(n), np.int64)
                rows = list(_sent(level, words, [n] if level == order else [n, n, zero, zero, zero, zero], bits))
                for i in range(0, len(rows), 64):
                    yield _batch(rows[i : i + 64])

        for b in slices(batches, name="ngrams"):
            stream, starts = streams(b.column(0))
            for level, ends in _grams(stream, starts, order):
                held.setdefault(level, []).append([stream[ends - level + 1 + i] for i in range(level)])
            size += len(stream)
            if size >= FLUSH:
                yield from flush()
                held, size = {}, 0
        if size:
            yield from flush()

    return run


def file_name(level: int, shard: int) -> str:
    return f"{level}-{shard:06d}"


def _write(directory: str, name: str, columns: dict[str, np.ndarray]) -> None:
    """A file with a header line and aligned arrays, renamed when it is whole, so that tasks may run again."""
    kept, at = {}, 0
    for k, v in columns.items():
        kept[k] = (v.dtype.str, len(v), at)
        at += -(-v.nbytes // 8) * 8
    head = json.dumps(kept).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    target, base = open_fs(directory)
    own = f"{base}/_{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with target.open_output_stream(own) as out:
        out.write(head)
        for v in columns.values():
            out.write(v.tobytes() + b"\0" * (-v.nbytes % 8))
    target.move(own, f"{base}/{name}")


def _small(v: np.ndarray) -> np.ndarray:
    return v.astype(np.min_scalar_type(int(v.max()) if len(v) else 0))


def _bucket_bits(n: int) -> int:
    return max(0, (n >> 3).bit_length() - 1)


def _arrays(key: np.ndarray, bits: int) -> dict[str, np.ndarray]:
    """Bucket borders and 32 bits of each hash: the high bits are the shard, then the bucket, then what is kept."""
    b = _bucket_bits(len(key))
    bucket = ((key << _U(bits)) >> _U(64 - b)).astype(np.int64) if b else np.zeros(len(key), np.int64)
    return {"starts": np.searchsorted(bucket, np.arange((1 << b) + 1)).astype(np.uint32), "rest": ((key << _U(bits + b)) >> _U(32)).astype(np.uint32)}


def _reducer(level: int, order: int, bits: int, directory: str):
    """A shard's rows of one level to its file, to rows of the next lower level and a row of statistics (level 0)."""

    def run(table: pa.Table) -> pa.Table:
        levels, shards, data = (table.column(c).to_pylist() for c in ("level", "shard", "data"))
        out = [r for r in zip(levels, shards, data, strict=True) if r[0] != level]
        mine = [_unpack(d, level, _width(level, order)) for k, d in zip(levels, data, strict=True) if k == level]
        if mine:
            key, words, columns = _merged([np.concatenate([w[i] for w, _ in mine]) for i in range(level)], [np.concatenate([c[i] for _, c in mine]) for i in range(_width(level, order))])
            a = columns[0]
            raw = a if level == order else columns[1]
            found = _arrays(key, bits) | {"a": _small(a)}
            names = _COLUMNS if level < order else ("a",)
            found |= {k: _small(v) for k, v in zip(names, columns, strict=True) if k != "a" and (k != "c" or level == 1)}
            _write(directory, file_name(level, shards[0]), found)
            once, twice = a == 1, a == 2
            told = {"level": level, "n": [int((a == i).sum()) for i in (1, 2, 3, 4)], "more": int((a > 2).sum()), "different": int((a > 0).sum()), "sum": int(a.sum()), "raw": int(raw.sum())}
            out.append((0, shards[0], json.dumps(told).encode()))
            if level > 1:
                zero = np.zeros(len(a), np.int64)
                suffix = (words[1:], [(a > 0).astype(np.int64), raw, zero, zero, zero, zero])
                context = (words[:-1], [zero, zero, a, once.astype(np.int64), twice.astype(np.int64), (a > 2).astype(np.int64)])
                _, w, c = _merged([np.concatenate(x) for x in zip(suffix[0], context[0], strict=True)], [np.concatenate(x) for x in zip(suffix[1], context[1], strict=True)])
                out += _sent(level - 1, w, c, bits)
        return pa.Table.from_batches([_batch(out)])

    return run


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the statistics of each level."""

    directory: str
    order: int
    bits: int
    tokens: int  # training tokens
    words: int  # different training tokens
    discounts: tuple[tuple[float, float, float], ...]  # by level, for counts of 1, 2, 3 and more
    unigrams: tuple[int, int, int, int]  # sum of the words' counts, and words counted once, twice, more often


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams counted 1 to 4 times; 0.5, 1, 1.5 where they aren't defined."""
    usual = (0.5, 1.0, 1.5)
    if min(n) <= 0:
        return usual
    y = n[0] / (n[0] + 2 * n[1])
    found = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return found if all(0 < d <= k for k, d in enumerate(found, 1)) else usual


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER, shards: int | None = None) -> Model:
    """The model of docs' texts; a number of shards that is a power of two follows the texts' size."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (max(2, shards or max(LEAST_SHARDS, size // 6 // PER_SHARD)) - 1).bit_length()
    directory = shared_path(spark, "ngrams")
    target, base = open_fs(directory)
    target.create_dir(base, recursive=True)
    rows = texts.mapInArrow(_counter(order, bits), ROWS)
    for level in range(order, 0, -1):
        rows = rows.groupBy("shard").applyInArrow(_reducer(level, order, bits, directory), ROWS)
    told: dict[int, list[dict]] = {}
    for r in rows.where("level = 0").select("data").collect():  # a row for each shard and level
        x = json.loads(bytes(r["data"]))
        told.setdefault(x["level"], []).append(x)
    total = lambda level, f: sum(map(f, told.get(level, [])))
    n = {k: [total(k, lambda x, i=i: x["n"][i]) for i in range(4)] for k in range(1, order + 1)}
    return Model(
        directory, order, bits, total(1, lambda x: x["raw"]), total(1, lambda x: x["different"]), tuple(discounts(n[k]) for k in range(1, order + 1)),
        (total(1, lambda x: x["sum"]), n[1][0], n[1][1], total(1, lambda x: x["more"])),
    )


class _Arrays:
    """The arrays of one level, opened shard by shard."""

    def __init__(self, model: Model, level: int) -> None:
        self.model, self.level, self.open = model, level, {}

    def _shard(self, s: int) -> dict[str, np.ndarray]:
        if s not in self.open:
            source, base = open_fs(self.model.directory)
            path = f"{base}/{file_name(self.level, s)}"
            if not source.get_file_info(path).is_file:
                self.open[s] = {}
            else:
                local = isinstance(source, pafs.LocalFileSystem)
                data = np.memmap(path, np.uint8, "r") if local else np.frombuffer(source.open_input_stream(path).read(), np.uint8)
                stop = int(np.flatnonzero(data[: 1 << 12] == 10)[0]) + 1
                head = json.loads(bytes(data[:stop]))
                self.open[s] = {k: data[stop + at : stop + at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in head.items()}
        return self.open[s]

    def look_up(self, key: np.ndarray, columns: tuple[str, ...]) -> list[np.ndarray]:
        """The columns of sorted keys, 0 where there is no such n-gram."""
        out = [np.zeros(len(key), np.int64) for _ in columns]
        bits = self.model.bits
        cuts = np.searchsorted(key >> _U(64 - bits), np.arange((1 << bits) + 1).astype(_U))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            held = self._shard(s)
            if not held:
                continue
            mine = key[cuts[s] : cuts[s + 1]]
            b = (len(held["starts"]) - 1).bit_length() - 1
            bucket = ((mine << _U(bits)) >> _U(64 - b)).astype(np.int64) if b else np.zeros(len(mine), np.int64)
            rest = ((mine << _U(bits + b)) >> _U(32)).astype(np.uint32)
            low, end = held["starts"][bucket].astype(np.int64), held["starts"][bucket + 1].astype(np.int64)
            all_rest, high = held["rest"], end.copy()
            while np.any(low < high):
                mid = (low + high) >> 1
                less = (all_rest[np.minimum(mid, len(all_rest) - 1)] < rest) & (low < high)
                high = np.where(less, high, np.minimum(mid, high))
                low = np.where(less, mid + 1, low)
            at = np.minimum(low, len(all_rest) - 1)
            hit = np.flatnonzero((low < end) & (all_rest[at] == rest))
            for x, c in zip(out, columns, strict=True):
                x[cuts[s] + hit] = held[c][at[hit]]
        return out


def _discounted(a: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(a - np.array([0.0, *d])[np.minimum(a, 3)], 0.0)


class Scorer:
    """Log10 probabilities of tokens, by the model and by its smoothed raw word counts."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.levels = [_Arrays(model, k) for k in range(1, model.order + 1)]

    def tokens(self, stream: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(raw count, log10 p, log10 of the base) for all places of the stream but those of BEGIN, where they mean nothing."""
        m = self.model
        place = np.arange(len(stream)) - np.repeat(starts[:-1], np.diff(starts))
        total, *seen = m.unigrams
        p = np.full(len(stream), 1.0 / (m.words + 1))
        if total:
            p *= float(np.dot(seen, m.discounts[0])) / total
        context = None  # sum and gamma of the words before each place, for the level at hand
        for level, arrays in enumerate(self.levels, 1):
            ends = np.arange(len(stream)) if level == 1 else np.flatnonzero(place >= level - 1)
            key, at = np.unique(key_of([stream[ends - level + 1 + i] for i in range(level)]), return_inverse=True)
            names = ("a",) if level == m.order else ("a", "s", "n1", "n2", "n3") + (("c",) if level == 1 else ())
            found = arrays.look_up(key, names)
            kept = _discounted(found[0], m.discounts[level - 1])[at]
            if level == 1:
                raw = found[5][at]
                p = p + (kept / total if total else 0.0)
            else:
                s, gamma = (x[ends - 1] for x in context)
                known = s > 0
                p[ends] = np.where(known, kept / np.maximum(s, 1) + gamma * p[ends], p[ends])
            if level < m.order:
                d = m.discounts[level]
                sums, gammas = np.zeros(len(stream)), np.ones(len(stream))
                some = found[1] > 0
                g = np.where(some, (d[0] * found[2] + d[1] * found[3] + d[2] * found[4]) / np.maximum(found[1], 1), 1.0)
                sums[ends], gammas[ends] = found[1][at], g[at]
                context = sums, gammas
        base = np.log10((raw + 0.5) / (m.tokens + 0.5 * (m.words + 1)))
        return raw, np.log10(p), base


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_cache("ngrams")
        if model.directory not in held:
            held.clear()
            held[model.directory] = Scorer(model)
        scorer = held[model.directory]
        for b in slices(batches, name="ngrams"):
            if not b.num_rows:
                continue
            stream, starts = streams(b.column("text"))
            raw, p, base = scorer.tokens(stream, starts)
            for x in (raw, p, base):
                x[starts[:-1]] = 0
            n = np.diff(starts) - 1
            known, scores, bases = np.add.reduceat((raw > 0).astype(np.int64), starts[:-1]), np.add.reduceat(p, starts[:-1]), np.add.reduceat(base, starts[:-1])
            columns = [b.column("doc_id"), *map(pa.array, (n, known, bases, scores, 10.0 ** np.minimum(-scores / n, 300.0)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")

