"""WARC archives: writer with deduplicated payloads, and a splittable reader.

Each record is a gzip member of its own. A reading task owns a range of bytes: it looks
for the gzip magic inside it, takes a candidate for a record if it decodes to a WARC
header, its checksum holds and it doesn't lie inside an earlier record, and reads the records
that start inside its range to their end, even beyond it. So any cut of a file into
ranges gives every record exactly once. Whether an earlier record holds a candidate is told by
the members before it: back from one to that which ends where it begins, for LOOK_BACK bytes.
(A payload may itself be an archive whose members deflate left as they are; one of more than
LOOK_BACK bytes is taken for records where a range begins inside it.)

Files are reached by pyarrow's file systems (local or shared paths, object stores, HDFS
where libhdfs is installed). A task writes under a name of its own attempt and renames
the file when it is whole, so tasks may be repeated.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import slices, stored
from quarry.sources.arrays import opened as open_fs

#: Payloads from this size on are stored once and revisited.
LEAST_SHARED = 100
RANGE_BYTES = 4 << 20
#: Compressed bytes before a range whose members tell whether its first candidate is a record.
LOOK_BACK = 64 << 10
#: Payloads that a larger part of all rows shares (so at most as many payloads) are joined by broadcast, the others by key.
MOST_COMMON = 1000
MAGIC = b"\x1f\x8b\x08"
DATE = "2000-01-01T00:00:00Z"  # of records without a date of their own
_STEP = 1 << 20

RECORD = "record_id string, record_type string, target_uri string, page_id string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _clean(value: object) -> str:
    return str(value).replace("\r", " ").replace("\n", " ")


def record(page: object, uri: str | None, digest: str, size: int, payload: bytes | None, refers_to: object = None) -> bytes:
    """A response record (payload given) or a revisit record, as WARC bytes. page None: a record without a page."""
    revisit = payload is None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if uri:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        ids, uris, sizes, digests, out = b.column("id").to_pylist(), b.column("uri").to_pylist(), [], [], []
        for page, uri, html in zip(ids, uris, b.column("html").to_pylist(), strict=True):
            payload = (html or "").encode("utf-8")
            digests.append(hashlib.sha256(payload).hexdigest())
            sizes.append(len(payload))
            out.append(member(record(page, uri, digests[-1], len(payload), payload)))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("uri"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(out, pa.binary())], ["id", "uri", "size", "digest", "member"])


def write(pages: DataFrame, directory: str, id_col: str = "page_id", uri_col: str | None = "url", html_col: str = "html") -> int:
    """Write one record for each row of pages to <directory>/part-*.warc.gz; returns the number of records.

    Of rows with equal payloads of LEAST_SHARED bytes and more, that with the smallest id is a response
    and the others revisit it; rows that repeat this id are responses too. Null html is an empty
    payload, and a row without an id a response. Other columns are ignored; no rows: no files.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    uri = F.col(uri_col) if uri_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), uri.alias("uri"), F.col(html_col).alias("html"))
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    # Only ids and digests are grouped; the shuffle below carries compressed records.
    slim = rows.select("id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= LEAST_SHARED)
    shared = slim.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(shared, "payloads")
    least = max(2, -(-pages.count() // MOST_COMMON))
    common = shared.where(F.col("n") >= least).select("digest", F.col("first").alias("common"))  # MOST_COMMON rows at most
    rare = shared.where(F.col("n") < least).select(F.col("digest").alias("key"), F.col("first").alias("rare"))
    made = rows.mapInArrow(_members, f"id {kind}, uri string, size long, digest string, member binary")
    made = made.join(F.broadcast(common), "digest", "left")
    # A common or small payload matches nothing among the rare ones: a key of its own keeps its many copies apart
    alone = F.concat(F.lit("-"), F.xxhash64("id", "uri").cast("string"))
    made = made.withColumn("key", F.when((F.col("size") >= LEAST_SHARED) & F.col("common").isNull(), F.col("digest")).otherwise(alone))
    joined = made.join(rare, "key", "left").withColumn("first", F.coalesce("common", "rare"))
    joined = joined.select("id", "uri", "size", "digest", "first", F.when(F.col("first").isNull() | F.col("id").isNull() | (F.col("id") == F.col("first")), F.col("member")).alias("member"))
    target, path = open_fs(directory)
    target.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        out, base = open_fs(directory)
        name = f"part-{task.partitionId():06d}.warc.gz"
        own, n, stream = f"{base}/_{name}.{task.taskAttemptId()}.{os.getpid()}", 0, None
        for b in batches:
            for r in b.to_pylist():
                data = r["member"] or member(record(r["id"], r["uri"], r["digest"], r["size"], None, r["first"]))
                stream = stream or out.open_output_stream(own)
                stream.write(data)
                n += 1
        if stream:
            stream.close()
            out.move(own, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return joined.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


class _Bytes:
    """A growing view of a file from `start` on."""

    def __init__(self, source, start: int, upto: int, size: int) -> None:
        self.source, self.start, self.size = source, start, size
        self.data = bytearray(source.read_at(min(upto, size) - start, start))

    def more(self) -> bool:
        at = self.start + len(self.data)
        if at >= self.size:
            return False
        self.data += self.source.read_at(min(_STEP, self.size - at), at)
        return True


class DamagedRecord(ValueError):
    """A member that begins like a record and can't be decoded, or bytes between members that are neither padding nor a member."""


def _decode(view: _Bytes, at: int) -> tuple[bytes, int] | None:
    """Content and end of the member at offset `at` of the view, or None if no record starts there."""
    z, out, done = zlib.decompressobj(31), [], at
    checked = False
    while not z.eof:
        if done == len(view.data) and not view.more():
            if checked:
                raise DamagedRecord(f"record at byte {view.start + at} ends before its time")
            return None
        part = bytes(view.data[done : done + (256 if not checked else 1 << 16)])
        try:
            out.append(z.decompress(part))
        except zlib.error as e:
            if checked:
                raise DamagedRecord(f"record at byte {view.start + at}: {e}") from e
            return None
        done += len(part) - len(z.unused_data)
        if not checked:
            head = b"".join(out)[:7]
            if head != b"WARC/1."[: len(head)]:
                return None
            checked = len(head) == 7
    return (b"".join(out), done) if checked else None


def _padding(view: _Bytes, at: int) -> int:
    """The offset after zeros that may stand behind a member."""
    while True:
        while at < len(view.data) and not view.data[at]:
            at += 1
        if at < len(view.data) or not view.more():
            return at


def _held_by_earlier(source, place: int, size: int) -> bool:
    """Whether the member at that place of a file lies inside a record that begins before it."""
    begins, low, data = place, place, b""
    at = 0  # where the search goes on, from the end of data to its start
    while True:
        at = data.rfind(MAGIC, 0, at)
        if at < 0:
            if not low:
                return False
            step = min(low, LOOK_BACK)
            # A magic may lie across the border of two parts
            data, low, at = source.read_at(min(step + len(MAGIC) - 1, place - low + step), low - step), low - step, step + len(MAGIC) - 1
            continue
        view = _Bytes(source, low + at, low + at + (16 << 10), size)
        try:
            found = _decode(view, 0)
        except DamagedRecord:
            found = None
        if found is None:
            continue
        if low + at + found[1] > begins:
            return True
        if low + at + _padding(view, found[1]) == begins:
            begins = low + at
        if place - low - at >= LOOK_BACK:
            return False


def records_in(source, start: int, end: int, size: int, damaged: list[str] | None = None) -> Iterator[bytes]:
    """The decoded members that start in [start, end) of an open file.

    A damaged record raises; with a list for it, it is told there instead, and reading goes on
    with the next member that decodes.
    """
    view = _Bytes(source, start, end + len(MAGIC) - 1, size)

    def tell(trouble: str) -> None:
        if damaged is None:
            raise DamagedRecord(trouble)
        damaged.append(trouble)

    at, due = 0, -1  # due: where the next record must begin, once one has been read
    while True:
        at = view.data.find(MAGIC, at)
        mine = at >= 0 and view.start + at < end
        found = None
        if mine:
            try:
                found = _decode(view, at)
            except DamagedRecord as e:
                tell(str(e))
                at, due = at + 1, -1
                continue
        if found is None and mine or mine and at != due and start + at > 0 and _held_by_earlier(source, start + at, size):
            at += 1
            continue
        if due >= 0 and at != due and (due < len(view.data) and (mine or view.start + due < end or not _begins(view, due))):
            tell(f"no record at byte {view.start + due}, where one ends")
        if not mine:
            return
        yield found[0]
        at = due = _padding(view, found[1])
        while len(view.data) < at + 512 and view.more():
            pass


def _begins(view: _Bytes, at: int) -> bool:
    """Whether a record seems to begin at that offset of the view."""
    try:
        return zlib.decompressobj(31).decompress(bytes(view.data[at : at + 512])).startswith(b"WARC/1.")
    except zlib.error:
        return False


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record in a member."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields.get("content-length", 0))
        yield fields, data[stop + 4 : stop + 4 + length]
        at = stop + 8 + length


def _bare(uri: str | None) -> str | None:
    return uri.strip("<>").removeprefix("urn:page:") if uri is not None else None


def read(spark: SparkSession, directory: str, payload: bool = True, range_bytes: int = RANGE_BYTES, damaged: str = "raise") -> DataFrame:
    """RECORD rows of all *.gz files of a directory, read in ranges of bytes.

    A record that can't be decoded raises; with damaged="keep" it gives a row of record_type
    `damaged` instead, whose record_id says where and why. Zeros after a member are padding.

    payload_bytes and payload_digest are those of the full payload: computed from the payload of a
    response (a digest that differs from the header's is an error), taken from the header of a revisit.
    """
    found, path = open_fs(directory)
    files = [(f.path, f.size) for f in found.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.is_file and f.path.endswith(".gz") and not f.base_name.startswith(("_", "."))]
    parts = max(1, sum(-(-size // range_bytes) for _, size in files))
    table = spark.createDataFrame(files, "path string, size long")
    ranges = table.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0), (F.col("size") - 1), F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(min(parts, 100_000), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, _ = open_fs(directory)
        for b in batches:
            for r in b.to_pylist():
                rows: list[tuple] = []
                trouble: list[str] | None = None if damaged == "raise" else []
                with source.open_input_file(r["path"]) as f:
                    for data in records_in(f, r["start"], min(r["start"] + range_bytes, r["size"]), r["size"], trouble):
                        rows += map(_row, parse(data))
                rows += [(f"{r['path']}: {x}", "damaged", *[None] * (len(_NAMES) - 2)) for x in trouble or ()]
                for i in range(0, len(rows), 512):
                    columns = list(zip(*rows[i : i + 512], strict=True))
                    if not payload:
                        columns[-1] = [None] * len(columns[0])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    return ranges.mapInArrow(run, RECORD)


_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_TYPES = [pa.int64() if x == "payload_bytes" else pa.binary() if x == "payload" else pa.string() for x in _NAMES]


def _row(found: tuple[dict[str, str], bytes]) -> tuple:
    fields, block = found
    kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest", "").partition(":")[2] or None
    body = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    if kind == "revisit":
        size, digest, body = int(fields["x-payload-length"]) if "x-payload-length" in fields else None, stated, None
    else:
        size, digest = len(body), hashlib.sha256(body).hexdigest()
        if stated and fields["warc-payload-digest"].startswith("sha256:") and stated != digest:
            raise ValueError(f"payload of {fields.get('warc-record-id')} differs from its digest")
    return fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("x-page-id"), size, digest, _bare(fields.get("warc-refers-to")), body


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, h, CAST(strlen(h) AS BIGINT) AS n, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN n >= {LEAST_SHARED} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST_SHARED} AND page_id <> first THEN first END AS refers_to
FROM q
"""
