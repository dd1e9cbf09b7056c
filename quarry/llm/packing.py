"""Packing of tokenised documents into sequences of a window's length.

A document's token ids end with an end id. Its whole windows are sequences of their own;
the rest, shorter than a window, is packed by a plan over the histogram of lengths:

1. Shallow combinations of two and three lengths that fill a window are enumerated, and
   non-negative least squares solve how often to use each so that the histogram is met.
2. The counts are rounded and cut to what there is; pairs still there are taken greedily.
3. The residual is laid end to end, shortest first, and cut where windows fill; what is
   left of the last window is cut into sequences whose lengths are powers of two.

The plan holds numbers by length only, so it is bounded by the window, not by the data.
A piece finds its place by its length and its rank among the documents of this length.
Ranks are counted in salted groups, so a length that a third of all documents have is
spread over many tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Shipped, slices, stored, worker_cache

WINDOW, END_ID = 2048, 1
#: Triples are enumerated from this many of the most frequent lengths.
FREQUENT = 40
SWEEPS = 60
LEAST_SALTS, ROWS_PER_SALT = 16, 150_000
MOST_CACHED = 600_000
#: Characters of texts that are cut into words at once.
MOST_CHARACTERS = 8_000_000
#: Unknown words encoded as one text.
TOGETHER = 200

_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
# Marks that a tokenizer's pattern never joins to letters and digits before them
_MARKS = ".,;:!?%&*$#|-()[]{}\"/+=<>@^_~"


class Encoder:
    """Token ids of whole texts, put together from the ids of their words.

    Texts are cut where the tokenizer's pattern always cuts: before a single blank between visible
    characters, around a line feed between such, and between a letter or digit and marks other than
    the apostrophe. Unknown words are encoded together in one text, from which their ids are told
    apart: a word after a blank begins with the only token that has one; others stand on lines.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.blank = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.blank[k] = token.startswith("\u0120")
        # Texts with one of these aren't split into words: runs of white space, and white space of other kinds
        self.odd = [*self.special, "  ", "\n\n", " \n", "\n ", *_OTHER_SPACE]
        self.feed = self._plain("\n")
        self.bare: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # the word after a blank, the blank counted

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _plain(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _encode_words(self, words: list[str], known: dict[str, bytes], spaced: bool) -> None:
        """Put the ids of words without white space into known."""
        width, feed = self.kind.itemsize, np.frombuffer(self.feed, self.kind)[0]
        skip = 0 if spaced else 1
        for i in range(0, len(words), 100 * TOGETHER):
            parts = [words[j : j + TOGETHER] for j in range(i, min(i + 100 * TOGETHER, len(words)), TOGETHER)]
            texts = [" " + " ".join(some) if spaced else "\n".join(some) for some in parts]
            for some, found in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(found.ids, self.kind)
                ends = np.flatnonzero(self.blank[ids])[1:] if spaced else np.flatnonzero(ids == feed)
                at = [0, *(ends * width).tolist(), len(ids) * width]
                if len(at) != len(some) + 1:
                    known.update([(w, self._plain(" " + w if spaced else w)) for w in some])
                    continue
                data = ids.tobytes()
                starts = [0, *[a + skip * width for a in at[1:-1]]]
                known.update(zip(some, [data[a:b] for a, b in zip(starts, at[1:], strict=True)], strict=True))

    def _learn(self, new: set[str], known: dict[str, bytes], spaced: bool) -> None:
        marks = set(_MARKS)
        whole, cut = [w for w in new if w[-1:] not in marks], []
        for w in new.difference(whole):
            core = w.rstrip(_MARKS)
            if core and core[-1].isalnum():
                cut.append((w, core, w[len(core) :]))
            else:
                whole.append(w)
        cores = {c for _, c, _ in cut if c not in known}
        cores.difference_update(whole)
        self._encode_words([*whole, *cores], known, spaced)
        self._encode_words(list({t for _, _, t in cut if t not in self.bare}), self.bare, False)
        bare = self.bare
        known.update([(w, known[c] + bare[t]) for w, c, t in cut])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned numbers of self.kind."""
        out: list[bytes] = [b""] * len(texts)
        split, size = [], 0  # texts whose words stand between single blanks and line feeds
        for k, t in enumerate(texts):
            if t and not (t[0] in " \n" or t[-1] in " \n" or any([s in t for s in self.odd])):
                split.append(k)
                size += len(t)
                if size > MOST_CHARACTERS:
                    self._encode_split(texts, split, out)
                    split, size = [], 0
        self._encode_split(texts, split, out)
        for k, t in enumerate(texts):
            if t and not out[k]:
                out[k] = self._odd(t)
        return out

    def _encode_split(self, texts: list[str | None], at: list[int], out: list[bytes]) -> None:
        """Arrow cuts the texts and numbers their different words; NumPy puts the words' ids together."""
        if not at:
            return
        lines = pc.split_pattern(pa.array([texts[k] for k in at], pa.large_string()), "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        line_at, word_at = np.asarray(lines.offsets), np.asarray(words.offsets)
        numbered = words.flatten().dictionary_encode()
        number, names = np.asarray(numbered.indices), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        # Entries of the table: each different word as one after a blank; then as the first of a text, as the first of a later line
        n = len(names)
        segment = number.astype(np.int32)
        segment[word_at[:-1]] += 2 * n
        segment[word_at[line_at[:-1]]] -= n
        used = np.zeros(3 * n, bool)
        used[segment] = True
        spaced, first, later = (np.flatnonzero(x).tolist() for x in used.reshape(3, n))
        after = [names[k] for k in spaced]
        bare = [names[k] for k in (*first, *later)]
        new = set(bare).difference(self.bare), set(after).difference(self.spaced)
        self._learn(new[0], self.bare, False)
        self._learn(new[1], self.spaced, True)
        parts = list(map(self.spaced.__getitem__, after))
        starts = list(map(self.bare.__getitem__, bare))
        parts += starts[: len(first)]
        parts += [self.feed + x for x in starts[len(first) :]]
        flat = np.frombuffer(b"".join(parts), self.kind)
        lengths = np.zeros(3 * n, np.int32)
        lengths[used] = np.fromiter(map(len, parts), np.int32, len(parts)) // self.kind.itemsize
        begins = np.cumsum(lengths, dtype=np.int32) - lengths
        sizes = lengths[segment]
        ends = np.cumsum(sizes, dtype=np.int32)
        places = np.arange(ends[-1], dtype=np.int32)
        places += np.repeat(begins[segment] - ends + sizes, sizes)
        ids = flat[places]
        cuts = [0, *ends[word_at[line_at[1:]] - 1].tolist()]
        for k, low, high in zip(at, cuts, cuts[1:], strict=False):
            out[k] = ids[low:high].tobytes()
        for some, known in zip(new, (self.bare, self.spaced), strict=True):
            for w in [w for w in some if len(w) > 64]:  # long words aren't kept
                del known[w]
        if len(self.bare) + len(self.spaced) > MOST_CACHED:  # the words of these texts stay
            self.bare = {w: self.bare[w] for w in bare if w in self.bare}
            self.spaced = {w: self.spaced[w] for w in after if w in self.spaced}

    def _odd(self, text: str) -> bytes:
        """A text with other white space: its parts between single blanks."""
        if not text or any(s in text for s in self.special):
            return self._plain(text)
        parts = _CUT.split(text)
        return self._plain(parts[0]) + b"".join(self.spaced.get(p) or self._plain(" " + p) for p in parts[1:])


def encoder(path: str) -> Encoder:
    held = worker_cache("tokenizers")
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def combinations(counts: Counter, window: int = WINDOW, frequent: int = FREQUENT) -> list[tuple[int, ...]]:
    """Lengths that fill a window: all pairs that occur, and triples with two of the frequent lengths."""
    out = {(a, window - a) for a in counts if a <= window - a and window - a in counts}
    top = [x for x, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:frequent]]
    for i, a in enumerate(top):
        for b in top[i:]:
            c = window - a - b
            if c > 0 and c in counts:
                out.add(tuple(sorted((a, b, c))))
    return sorted(out)


def least_squares(combos: list[tuple[int, ...]], counts: Counter, window: int = WINDOW, sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative repeats of the combinations that meet the counts best, by coordinate descent."""
    a = np.zeros((window, len(combos)))
    for k, c in enumerate(combos):
        for x in c:
            a[x, k] += 1
    h = np.zeros(window)
    for x, n in counts.items():
        h[x] = n
    gram, target = a.T @ a, a.T @ h
    x, slope = np.zeros(len(combos)), -target
    for _ in range(sweeps):
        moved = 0.0
        for k in range(len(combos)):
            step = max(-x[k], -slope[k] / gram[k, k])
            if step:
                x[k] += step
                slope += step * gram[:, k]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return x


class Plan:
    """Where the pieces of each length go, by rank among their length."""

    def __init__(self, counts: dict[int, int], window: int = WINDOW) -> None:
        self.window = window
        left = Counter({x: n for x, n in counts.items() if n and 0 < x < window})
        self.count = dict(left)
        #: length -> [(first rank, number, first sequence, offset)]
        self.given: dict[int, list[tuple[int, int, int, int]]] = {x: [] for x in left}
        self.used: Counter = Counter()
        self.sequences = 0
        combos = combinations(left, window)
        solved = least_squares(combos, left, window) if combos else np.zeros(0)
        for k in np.argsort(-solved, kind="stable").tolist():
            self._take(combos[k], round(float(solved[k])), left)
        for c in combos:  # what rounding left over, greedily
            self._take(c, max(left.values(), default=0), left)
        #: The residual's place on a line of tokens, shortest first
        self.line: dict[int, int] = {}
        at = 0
        for x in sorted(left):
            self.line[x] = at
            at += x * left[x]
        self.length = at
        self.first_line_sequence = self.sequences
        whole = at // window * window
        self.cuts = [whole]  # ends of the sequences after the last whole window
        for bit in range(window.bit_length() - 1, -1, -1):
            if (at - whole) >> bit & 1:
                self.cuts.append(self.cuts[-1] + (1 << bit))
        self.sequences += whole // window + len(self.cuts) - 1
        #: Number of the first document of each length, for the sequences of whole windows
        self.documents: dict[int, int] = {}
        n = 0
        for x in sorted(counts):
            self.documents[x] = n
            n += counts[x]

    def _take(self, combo: tuple[int, ...], most: int, left: Counter) -> None:
        need = Counter(combo)
        n = min(most, *(left[x] // k for x, k in need.items()))
        if n <= 0:
            return
        offset = 0
        for x in combo:
            self.given[x].append((self.used[x], n, self.sequences, offset))
            self.used[x] += n
            left[x] -= n
            offset += x
            if not left[x]:
                del left[x]
        self.sequences += n

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of the rank-th rest of this length."""
        for first, n, sequence, offset in self.given[length]:
            if first <= rank < first + n:
                return [(0, length, sequence + rank - first, offset)]
        at = self.line[length] + (rank - self.used[length]) * length
        end, out, start = at + length, [], 0
        while at < end:
            if at < self.cuts[0]:
                sequence, low = self.first_line_sequence + at // self.window, at // self.window * self.window
                high = low + self.window
            else:
                k = next(i for i in range(1, len(self.cuts)) if at < self.cuts[i])
                sequence, low, high = self.first_line_sequence + self.cuts[0] // self.window + k - 1, self.cuts[k - 1], self.cuts[k]
            n = min(end, high) - at
            out.append((start, n, sequence, at - low))
            start, at = start + n, at + n
        return out


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless ids is False, ids.

    Null text counts as empty (one piece, the end id). Rows that repeat are packed each. Other columns are
    ignored. Empty table: no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        end, width = np.array([end_id], made.kind).tobytes(), made.kind.itemsize
        for b in slices(batches):
            data = [x + end for x in made.encode(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // width for x in data], pa.int64()), pa.array(data, pa.binary())], ["doc_id", "n", "ids"])

    tokens = rows.mapInArrow(tokenise, f"doc_id {kind}, n long, ids binary").withColumns({"rest": (F.col("n") % window).cast("int"), "mark": F.xxhash64("doc_id", "ids")})
    tokens = stored(tokens, "tokens")
    n_docs, longest = tokens.agg(F.count(F.lit(1)), F.max("n")).first()
    salts = max(LEAST_SALTS, -(-n_docs // ROWS_PER_SALT))
    salt = F.pmod("mark", F.lit(salts)).cast("int")
    groups = tokens.groupBy("rest", salt.alias("salt")).agg(F.count(F.lit(1)).alias("k"))
    counts = {r[0]: r[1] for r in groups.groupBy("rest").agg(F.sum("k")).collect()}  # a row for each length below the window
    plan = Shipped(spark, Plan(counts, window))
    most = (longest or 1) // window + 1
    before = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("rest", "salt", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("rest", "salt").orderBy("doc_id", "mark")
    ranked = tokens.withColumn("salt", salt).withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["rest", "salt"])
    ranked = ranked.select("doc_id", "n", "ids", "rest", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for b in batches:
            out: list[tuple] = []
            for doc, n, data, rest, rank in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids", "rest", "rank")), strict=True):
                numbers = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")
                whole, first = n // window, p.sequences + (p.documents[rest] + rank) * most
                places = [(k * window, window, first + k, 0) for k in range(whole)]
                if rest:
                    places += [(whole * window + s, m, q, o) for s, m, q, o in p.pieces(rest, rank)]
                for s, m, q, o in places:
                    part = numbers[s : s + m]
                    out.append((doc, s, m, zlib.crc32(part.tobytes()), n, q, o, part if ids else None))
            for i in range(0, len(out), 4096):
                columns = list(zip(*out[i : i + 4096], strict=True))
                arrays = [pa.array(columns[0], b.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
                names = ["doc_id", *(x.split()[0] for x in PIECE.split(", "))]
                if ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return ranked.mapInArrow(place, f"doc_id {kind}, {PIECE}" + ", ids array<int>" * ids)
