"""JSON arrays in one file, read by many tasks.

A file is cut into ranges of bytes. What a byte means depends on all bytes before it, so
ranges are read twice: the first pass tells, for either case (the range begins inside a
string or not), how the range changes the case and the depth of brackets; the driver puts
these few numbers together in the order of the ranges. Then each range knows where it stands,
and gives the elements that begin inside it, read to their end, even beyond it. So any cut
gives each element once.

Files are reached by pyarrow's file systems (local or shared paths, object stores, HDFS
where libhdfs is installed). The text must be UTF-8 JSON.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE_BYTES = 16 << 20
#: Names under which an object may hold its list of rows, in the order in which they are looked for.
LIST_KEYS = ("data", "items", "samples", "examples")
_BACK = 4096  # bytes looked at before a range and before a bracket
_STEP = 1 << 20
_QUOTE, _SLASH, _COMMA = b'"'[0], b"\\"[0], b","[0]


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


class Marks:
    """Brackets and commas of a piece of text, and whether each stands inside a string, if the piece itself begins outside one."""

    def __init__(self, data: bytes, escaped: bool) -> None:
        """escaped: an odd number of backslashes stands before the piece."""
        b = np.frombuffer(data, np.uint8)
        quote = np.flatnonzero(b == _QUOTE)
        slash = b == _SLASH
        if slash.any() or escaped:
            # Backslashes in a row before each quote; an odd number makes it a part of the string
            plain = np.flatnonzero(~slash)
            before = np.searchsorted(plain, quote) - 1
            start = np.where(before >= 0, plain[np.maximum(before, 0)] if len(plain) else -1, -1)
            run = quote - start - 1 + ((start < 0) & escaped)
            quote = quote[run % 2 == 0]
        self.quotes = len(quote)
        self.at = np.flatnonzero((b == b"{"[0]) | (b == b"["[0]) | (b == b"}"[0]) | (b == b"]"[0]) | (b == _COMMA))
        self.sign = b[self.at]
        self.inside = np.searchsorted(quote, self.at) % 2 == 1
        self.step = np.where((self.sign == b"{"[0]) | (self.sign == b"["[0]), 1, np.where(self.sign == _COMMA, 0, -1))

    def real(self, in_string: bool) -> np.ndarray:
        """Which of the marks are no text, for a piece that begins inside or outside a string."""
        return self.inside if in_string else ~self.inside


def _piece(source: pa.NativeFile, start: int, end: int) -> tuple[bytes, bool]:
    """Bytes of a range, and whether an odd number of backslashes stands before it."""
    low = start
    before = b""
    while low > 0:
        low = max(0, low - _BACK)
        before = source.read_at(start - low, low)
        if before.strip(b"\\"):
            break
    return source.read_at(end - start, start), (len(before) - len(before.rstrip(b"\\"))) % 2 == 1


def _mapped(ranges: DataFrame, uri: str, f, schema: str) -> DataFrame:
    """f(open file, row) -> rows, for the rows of ranges."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, _ = opened(uri)
        for b in batches:
            for r in b.to_pylist():
                with source.open_input_file(r["path"]) as held:
                    rows = []
                    for row in f(held, r):
                        rows.append(row)
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return ranges.mapInArrow(run, schema)


def _changes(held: pa.NativeFile, r: dict) -> Iterator[tuple]:
    m = Marks(*_piece(held, r["start"], r["end"]))
    yield r["file"], r["start"], m.quotes % 2 == 1, int(m.step[m.real(False)].sum()), int(m.step[m.real(True)].sum())


def _lists(held: pa.NativeFile, r: dict) -> Iterator[tuple]:
    """(file, what, key, at): brackets that open the file's array or a list under one of its object's keys, and where such a list may end."""
    data, escaped = _piece(held, r["start"], r["end"])
    m = Marks(data, escaped)
    real = m.real(r["in_string"])
    at, sign, step = m.at[real], m.sign[real], m.step[real]
    depth = r["depth"] + np.cumsum(step)  # after each mark
    base = 1 if r["array"] else 2
    closes = np.flatnonzero((sign == b"]"[0]) & (depth == base - 1))
    found = []
    for k in np.flatnonzero((sign == b"["[0]) & (depth == base)).tolist():
        place = r["start"] + int(at[k])
        low = max(0, place - _BACK)
        name = None if base == 1 else re.search(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', held.read_at(place - low, low))
        if base == 1 or name and name[1].decode("utf-8", "replace") in LIST_KEYS:
            found.append((k, name[1].decode() if name else "", place))
    for k, key, place in found:
        yield r["file"], "open", key, place
        end = closes[np.searchsorted(closes, k) :][:1]
        if len(end):
            yield r["file"], "close", "", r["start"] + int(at[end[0]])
    if len(closes):  # the first bracket that may close what an earlier range opened
        yield r["file"], "close", "", r["start"] + int(at[closes[0]])


def _elements(held: pa.NativeFile, r: dict) -> Iterator[tuple]:
    """(file, at, text) of the elements whose separator (the list's bracket or a comma) stands in the range."""
    start, stop = max(r["start"], r["open"]), min(r["end"], r["close"])
    size, base = r["close"], r["base"]
    data, escaped = _piece(held, r["start"], r["end"])
    in_string, depth, offset = r["in_string"], r["depth"], r["start"]
    begun: int | None = None
    parts: list[bytes] = []
    ahead = _BACK  # what is read beyond the range doubles, so a small range doesn't read much for its last element
    while True:
        m = Marks(data, escaped)
        real = m.real(in_string)
        at, sign, step = m.at[real], m.sign[real], m.step[real]
        depths = depth + np.cumsum(step)
        place = at + offset
        cut = ((sign == _COMMA) & (depths == base) | (place == r["open"]) | (place == r["close"])) & (place >= r["open"]) & (place <= r["close"])
        done = False
        for p in at[cut].tolist():
            if begun is not None:
                text = b"".join([*parts, data[begun:p]]).strip()
                if text:
                    yield r["file"], first, text.decode("utf-8")
                begun, parts = None, []
            if not start <= p + offset < stop:
                if p + offset >= stop:
                    done = True
                    break
                continue
            begun, first = p + 1, p + offset
        if done or begun is None:
            return
        parts.append(data[begun:])
        begun = 0
        tail = data
        in_string, depth, offset = in_string != (m.quotes % 2 == 1), int(depths[-1]) if len(depths) else depth, offset + len(data)
        if offset > size:
            raise ValueError(f"{r['path']}: the list that begins at byte {r['open']} doesn't end")
        escaped = (len(tail) - len(tail.rstrip(b"\\"))) % 2 == 1 if tail.strip(b"\\") else (len(tail) % 2 == 1) != escaped
        data, ahead = held.read_at(min(ahead, size + 1 - offset), offset), min(2 * ahead, _STEP)


def elements(spark: SparkSession, path: str, wrapped: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, at, text): the elements of the JSON array that each file of path holds, in the order of file and at.

    wrapped: a file may also hold an object; then its first list under LIST_KEYS is taken, in their order.
    A file without such a list, or whose brackets don't close, fails.
    """
    source, base = opened(path)
    info = source.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.is_file else [f for f in source.get_file_info(pafs.FileSelector(base)) if f.is_file and not f.base_name.startswith(("_", "."))]
    files = sorted((f.path, f.size) for f in files if f.size)
    tasks = max(4 * spark.sparkContext.defaultParallelism, sum(size for _, size in files) // RANGE_BYTES)
    cuts = [(k, p, s, min(s + range_bytes, size), size) for k, (p, size) in enumerate(files) for s in range(0, size, range_bytes)]
    if not cuts:
        raise ValueError(f"{path}: no list of rows found")
    kinds = "file int, path string, start long, end long, size long"
    ranges = spark.createDataFrame(cuts, kinds).repartition(min(len(cuts), tasks), "file", "start")
    found = {(r[0], r[1]): r[2:] for r in _mapped(ranges, path, _changes, "file int, start long, odd boolean, outside long, inside long").collect()}  # a row for each range
    states, now = [], {}
    for k, p, s, e, size in cuts:
        in_string, depth = now.get(k, (False, 0))
        states.append((k, p, s, e, size, in_string, depth))
        odd, outside, inside = found[k, s]
        now[k] = (in_string != odd, depth + (inside if in_string else outside))
    for k, (in_string, depth) in now.items():
        if in_string or depth:
            raise ValueError(f"{files[k][0]}: strings or brackets don't close")
    heads = [source.open_input_file(name).read(_BACK).removeprefix(b"\xef\xbb\xbf").lstrip()[:1] == b"[" for name, _ in files]
    placed = spark.createDataFrame([(*s, heads[s[0]]) for s in states], f"{kinds}, in_string boolean, depth int, array boolean").repartition(min(len(cuts), tasks), "file", "start")
    marks: dict[int, list[tuple]] = {}
    for r in _mapped(placed, path, _lists, "file int, what string, key string, at long").collect():  # a few rows for each range
        marks.setdefault(r[0], []).append(tuple(r[1:]))
    wanted, of_file = [], {}
    for s in states:
        of_file.setdefault(s[0], []).append(s)
    for k, (name, _) in enumerate(files):
        mine = marks.get(k, [])
        opens = sorted((("", *LIST_KEYS).index(key), at) for what, key, at in mine if what == "open")
        if not opens or (opens[0][0] and not wrapped):
            raise ValueError(f"{name}: no list of rows found")
        rank, start = opens[0]
        level = 2 if rank else 1
        close = min(at for what, _, at in mine if what == "close" and at > start)
        wanted += [(*s[:4], close, s[5], s[6], start, level) for s in of_file[k] if s[3] > start and s[2] <= close]
    asked = spark.createDataFrame(wanted, "file int, path string, start long, end long, close long, in_string boolean, depth int, open long, base int")
    return _mapped(asked.repartition(min(len(wanted), tasks), "file", "start"), path, _elements, "file int, at long, text string")


def rows(spark: SparkSession, path: str, schema: T.StructType, wrapped: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of the elements, which must be objects; keys that the schema lacks are left out, a value of another type fails."""
    found = elements(spark, path, wrapped, range_bytes)
    checked = F.when(F.col("text").startswith("{"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.left("text", F.lit(80)))))
    return found.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
