"""Homomorphic multiset fingerprints of documents (native: DataFrame functions only).

A document is the multiset of its paragraphs (runs between line feeds). Each
paragraph is hashed to a wide vector, and the document's fingerprint is the sum
of these vectors, each lane modulo 2**32:

* EXACT lanes: hashes of the whole paragraph. They settle equality.
* SKETCH lanes: for every phrase of the paragraph (up to four words,
  counted from the start of a sentence) 64 hash bits. As sums of bits they form a
  sign projection of the phrase multiset, from which likeness is estimated. A
  text of 2**31 characters has fewer phrases than wrap a lane.
* two counters: paragraphs and phrases.

Sums commute, so the order of paragraphs doesn't matter, and paragraphs can be
inserted or removed by adding or subtracting the vector of the change
(`combine`). Defined cases: null text counts as empty; an empty text is one empty
paragraph without phrases; equal texts have equal fingerprints; two texts without
any phrase are alike (1.0) if equal, else 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import id_kind
from quarry.operators.order import numbered

EXACT_HASHES = 8  # of 64 bits each: two lanes a hash
WORDS = 32  # packed sums; each holds two sketch lanes
LANES = 2 * WORDS
PHRASE = r"[^\s.!?|]+(?:[\s|&&[^\n]]+[^\s.!?|]+){0,3}"
PAIR_MASK = (1 << 32) | 1
LOW32 = (1 << 32) - 1

#: Rows of one window partition when neighbours are looked up, and the most partitions (beyond, they grow, and Spark's windows spill).
ROWS_PER_BUCKET, MAX_BUCKETS = 512, 1 << 16


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and fp, array<int>: EXACT lanes, SKETCH lanes, paragraph count, phrase count.

    keys must tell the rows of texts apart. Paragraphs and phrases are exploded and summed
    again in generated code; a document's sums are complete before any shuffle, and there is
    none if texts are clustered by some of the keys.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    # A phrase never starts with a line feed, so that marks the paragraphs.
    units = F.concat(F.transform(F.split(whole, "\n"), lambda p: F.concat(F.lit("\n"), p)), F.regexp_extract_all(whole, F.lit(PHRASE), F.lit(0)))
    rows = texts.select(*keys, F.explode(units).alias("_u")).withColumn("_p", F.col("_u").startswith("\n"))
    rows = rows.select(
        *keys,
        F.when(F.col("_p"), 1).otherwise(0).alias("_np"),
        F.when(F.col("_p"), F.lit(0)).otherwise(F.xxhash64("_u")).alias("_h"),
        *[F.when(F.col("_p"), F.xxhash64(F.lit(k), "_u")).otherwise(F.lit(0)).alias(f"_e{k}") for k in range(EXACT_HASHES)],
    )
    sums = [F.sum("_np").alias("_np"), F.sum(1 - F.col("_np")).alias("_ns")]
    sums += [F.sum(F.col(f"_e{k}").bitwiseAND(F.lit(LOW32))).alias(f"_a{k}") for k in range(EXACT_HASHES)]
    sums += [F.sum(F.shiftrightunsigned(f"_e{k}", 32)).alias(f"_b{k}") for k in range(EXACT_HASHES)]
    sums += [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(PAIR_MASK))).alias(f"_w{i}") for i in range(WORDS)]
    lanes = [_low32(F.col(f"_{x}{k}")) for k in range(EXACT_HASHES) for x in "ab"]
    lanes += [_low32(x) for i in range(WORDS) for x in (F.col(f"_w{i}"), F.shiftrightunsigned(f"_w{i}", 32))]
    return rows.groupBy(*keys).agg(*sums).select(*keys, F.array(*lanes, _low32(F.col("_np")), _low32(F.col("_ns"))).alias("fp"))


def _low32(c: Column) -> Column:
    """The low 32 bits as a signed int."""
    return (c.bitwiseAND(F.lit(LOW32)).bitwiseXOR(F.lit(1 << 31)) - F.lit(1 << 31)).cast("int")


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the multiset union (sign 1), or of a without the paragraphs of b (sign -1)."""
    return F.zip_with(a, b, lambda x, y: _low32(x.cast("long") + sign * y.cast("long")))


def to_hex(fp: Column) -> Column:
    """Lower-case hex: 8 digits a lane."""
    digits = F.transform(fp, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(LOW32))), 8, "0"))
    return F.lower(F.array_join(digits, ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: Tanimoto similarity of the phrase multisets as the sketch lanes estimate it; 1.0 for equal fingerprints."""
    lanes = lambda fp: F.slice(fp, 2 * EXACT_HASHES + 1, LANES)
    count = lambda fp: F.element_at(fp, -1).cast("long").bitwiseAND(F.lit(LOW32))
    norm = lambda v, n: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(2.0 * x - n, F.lit(2.0)), lambda s: s / LANES)
    apart = norm(F.zip_with(lanes(a), lanes(b), lambda x, y: x.cast("long") - y.cast("long")), count(a) - count(b))
    both = norm(lanes(a), count(a)) + norm(lanes(b), count(b))
    estimate = F.when(both + apart > 0, (both - apart) / (both + apart)).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), estimate)))


def with_next(docs: DataFrame, key: str, order: list[Column], carried: list[str]) -> DataFrame:
    """Add bucket, place, guest and next_<c> for each carried column: those of the following row by ascending key, of the first row after the last.

    Rows are dealt by quantiles of the key into buckets of about ROWS_PER_BUCKET rows; the
    rows that begin a bucket also go, as guests, to the bucket before it (their own next is
    not set). So one shuffle and a small window in each bucket do, and no task holds all
    rows. place numbers the rows of a bucket from 1, its guests last. Rows with equal keys
    follow one another in the given order. Null keys come first.
    """
    at = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    buckets = max(1, min(MAX_BUCKETS, -(-docs.count() // ROWS_PER_BUCKET)))
    low, cuts = docs.agg(F.min(at), F.percentile_approx(at, [i / buckets for i in range(buckets)], 10 * max(buckets, 1000))).first()
    starts = sorted({low, *cuts}) if cuts else [0]
    steps = max(1, len(starts).bit_length())
    bounds = F.array(*map(F.lit, starts)) if len(starts) < 64 else F.from_json(F.lit(str(starts)), "array<bigint>")
    # Number of starts <= key, by halving
    halving = F.aggregate(
        F.array(*[F.lit(1 << s) for s in range(steps - 1, -1, -1)]),
        F.lit(0),
        lambda pos, s: pos + F.when(F.coalesce(F.get(bounds, pos + s - 1) <= at, F.lit(False)), s).otherwise(0),
    )
    begins = F.col("_at") == F.get(bounds, F.col("_b") - 1)
    home = F.struct(F.col("_b").alias("b"), F.lit(0).alias("wrap"), F.lit(False).alias("guest"))
    before = F.struct((F.col("_b") - 1).alias("b"), F.lit(0).alias("wrap"), F.lit(True).alias("guest"))
    around = F.struct(F.lit(len(starts)).alias("b"), F.lit(1).alias("wrap"), F.lit(True).alias("guest"))
    rows = docs.withColumns({"_at": at, "_b": halving}).withColumn(
        "_go", F.explode(F.when(begins & (F.col("_b") > 1), F.array(home, before)).when(begins, F.array(home, around)).otherwise(F.array(home)))
    )
    rows = rows.withColumns({"bucket": F.col("_go.b"), "guest": F.col("_go.guest"), "_wrap": F.col("_go.wrap")}).drop("_go", "_b")
    w = Window.partitionBy("bucket").orderBy("_wrap", "guest", "_at", *order)
    return rows.withColumns({"place": F.row_number().over(w)} | {f"next_{c}": F.lead(c).over(w) for c in carried}).drop("_at", "_wrap")


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n/2) characters replaced by the first as many (or all) of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its fingerprint, that of its half-edited text, and likenesses to that and to the next document.

    Rows that repeat (equal id and text) each get their row. Other columns are ignored. Empty table: no rows.
    Ids that aren't integers take their places by range partitions first.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = "doc_id"
    if id_kind(docs, id_col) != "long":
        base, key = numbered(base, ["doc_id", "text"], name="at"), "at"
    led = with_next(base, key, [F.col("text")], ["text"]).withColumn("change", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    here = F.struct(F.lit(0).alias("edit"), F.col("text").alias("t"), F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2(F.encode("change", "utf-8"), 256)).alias("sha"))
    there = F.struct(F.lit(1).alias("edit"), F.col("change").alias("t"), F.lit(None).cast("long").alias("n_chars"), F.lit(None).cast("binary").alias("sha"))
    both = led.select("bucket", "place", "guest", "doc_id", F.explode(F.when(F.col("guest"), F.array(here)).otherwise(F.array(here, there))).alias("x"))
    both = both.select("bucket", "place", "guest", "doc_id", "x.*")
    fps = fingerprints(both, ["bucket", "place", "edit", "guest", "doc_id", "n_chars", "sha"], "t")
    # Behind a document's fingerprint stands that of its edited text, then that of the next document
    w = Window.partitionBy("bucket").orderBy("place", "edit")
    fps = fps.withColumns({"efp": F.lead("fp", 1).over(w), "next_fp": F.lead("fp", 2).over(w)}).where((F.col("edit") == 0) & ~F.col("guest"))
    return fps.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        to_hex(F.col("fp")).alias("fingerprint"), to_hex(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
