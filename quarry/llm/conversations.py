"""Repair of conversations whose turns were lost, emptied, repeated, cut or given to the wrong role.

A conversation is written as a compact string, a sign for each row: the role's initial and
the row's first fault. The cheapest edits that give the roles `(s?(ua)+)?` depend on that string
alone, so each different signature is solved once, by recursion over its places with memory,
and its edits (K keep, R rerole, D delete, I insert) go back to all conversations that have it.

1. Rows are dealt by conversation; only role, turn and a digest of the text move. They are
   read in order, a conversation after the other: a task holds one sign for each row.
2. Distinct signatures are solved in parallel. Those that many conversations share are joined
   by broadcast (MOST_COMMON of them at most), the others by key.
3. Whole rows are dealt by conversation behind their edits, and replayed in order.

Rows stand by turn (nulls first), then role, then the digest of role and text. Defined cases: null role,
text, turn and id count as one space where text is asked for; a null id is a conversation of
its own; an empty role has the initial of no known role; rows that repeat are duplicates;
a conversation without rows has an empty signature; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import crc_sql, slices, stored

BLANK_CHARS = " \t\n\x0b\f\r"
#: Fixed signs: role initials s, u, a and others (o), in four kinds: sound, truncated, blank, duplicate.
SOUND, TRUNCATED, BLANK, DUPLICATE = "suao", "SUAO", "1234", "5678"
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
#: Signatures that this part of all conversations share are joined by broadcast.
MOST_COMMON = 1000
_INF = 1 << 60
# States: nothing yet, after s, after u, after a. Where each role leads, and which role may be put in.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_AFTER = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ENDS = (_START, _ASSISTANT)


def _choices(sign: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) for a row with that sign."""
    yield "D", DELETE_COST, state
    low = sign.lower()
    if low in SOUND:
        extra = TRUNCATED_COST if sign != low else 0
        if state in _AFTER.get(low, ()):
            yield "K", KEEP_COST + extra, _AFTER[low][state]
        yield "R", REROLE_COST + extra, _NEXT[state]


def solve(signature: str) -> tuple[int, str]:
    """Cost and edits, the ASCII-least of the cheapest ones. Blank and duplicate rows are written x."""
    memory: dict[int, list[int]] = {}

    def costs(i: int) -> list[int]:
        """The least cost from place i on, for each state."""
        if i not in memory:
            if i == len(signature):
                found = [0 if s in _ENDS else _INF for s in range(4)]
            else:
                rest = costs(i + 1)
                found = [min(cost + rest[to] for _, cost, to in _choices(signature[i], s)) for s in range(4)]
            for _ in range(2):  # an insertion leads to a state from which one more may be needed
                found = [min(c, INSERT_COST + found[_NEXT[s]]) for s, c in enumerate(found)]
            memory[i] = found
        return memory[i]

    for i in range(len(signature), -1, -200):  # the recursion finds the places behind it solved
        costs(i)
    i, state, out, left = 0, _START, [], costs(0)[_START]
    while i < len(signature) or state not in _ENDS or left:
        options = [("I", INSERT_COST, _NEXT[state], i)]
        if i < len(signature):
            options += [(e, cost, to, i + 1) for e, cost, to in _choices(signature[i], state)]
        edit, cost, state, i = min(o for o in options if o[1] + costs(o[3])[o[2]] == left)
        left -= cost
        out.append(edit)
    return costs(0)[_START], "".join(out)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there) after damage by the checksum of `conv_id:turn`; a dropped row has there = false."""
    hit = F.crc32(F.encode(F.concat(_text("conv_id"), F.lit(":"), _text("turn")), "utf-8")) % 20
    text = F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace(_text("text"), "[.!?]", "")).otherwise(_text("text"))
    rows = conversations.select("conv_id", "turn", F.when(hit == 4, F.lit("user")).otherwise(_text("role")).alias("role"), text.alias("text"), (hit != 0).alias("there"), F.when(hit == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def _prepared(rows: DataFrame) -> DataFrame:
    there = F.col("there") if "there" in rows.columns else F.lit(True)
    out = rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), there.alias("there"))
    return out.withColumn("digest", F.unhex(F.sha2(F.encode(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), "utf-8"), 256)))


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to one row (conv_id, signs, gaps) for each conversation."""
    out: list[tuple] = []
    kind, none = None, object()
    held: object = none
    signs, turns, low, high, last = [], 0, None, None, None

    def done() -> None:
        out.append((held, "".join(signs), high - low + 1 - turns if turns else 0))

    def batch() -> pa.RecordBatch:
        ids, found, gaps = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(found, pa.string()), pa.array(gaps, pa.int64())], ["conv_id", "signs", "gaps"])

    for b in slices(batches, 10_000):
        kind = b.schema.field("conv_id").type
        for conv, turn, sign in zip(*[b.column(c).to_pylist() for c in ("conv_id", "turn", "sign")], strict=True):
            if held is none or conv != held:
                if held is not none:
                    done()
                held, signs, turns, low, high, last = conv, [], 0, None, None, None
            if sign is None:
                continue
            signs.append(sign)
            if turn is not None and turn != last:
                low, high, turns, last = turn if low is None else low, turn, turns + 1, turn
        if len(out) > 1000:
            yield batch()
            out.clear()
    if held is not none:
        done()
    if out:
        yield batch()


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signs, gaps) of each conversation. rows: conv_id, turn, role, text, and there (false: a lost row, which only names its conversation)."""
    trimmed = F.rtrim("text", F.lit(BLANK_CHARS))
    fault = F.when(trimmed == "", 2).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise(F.lit("o"))
    slim = _prepared(rows).select("conv_id", "turn", "role", "digest", "there", fault.alias("fault"), initial.alias("initial")).repartition("conv_id")
    # Dealt by conversation already: the window over its equal rows needs no shuffle of its own
    again = F.row_number().over(Window.partitionBy("conv_id", "digest", "there").orderBy("turn")) > 1
    kinds = F.when(F.col("fault") == 2, 2).when(F.col("again"), 3).otherwise(F.col("fault"))
    signs = F.array(*map(F.lit, SOUND + TRUNCATED + BLANK + DUPLICATE))
    sign = F.when(F.col("there"), F.element_at(signs, kinds * 4 + F.instr(F.lit(SOUND), F.col("initial"))))
    ordered = slim.withColumn("again", again).sortWithinPartitions("conv_id", "turn", "role", "digest").select("conv_id", "turn", sign.alias("sign"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(_signs, f"conv_id {kind}, signs string, gaps long")


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        cost, audit = zip(*map(solve, b.column("signature").to_pylist()), strict=True)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cost, pa.int64()), pa.array(audit, pa.string())], [*b.schema.names, "cost", "audit"])


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, signs, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation."""
    found = stored(signatures(rows).withColumn("signature", F.translate("signs", BLANK + DUPLICATE, "x" * 8)), "signatures")
    distinct = found.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    solved = stored(distinct.mapInArrow(_solved, "signature string, n long, cost long, audit string"), "solved")
    least = max(2, -(-found.count() // MOST_COMMON))
    common = solved.where(F.col("n") >= least).select("signature", "cost", "audit")  # MOST_COMMON rows at most
    rare = solved.where(F.col("n") < least).select("signature", "cost", "audit")
    told = found.join(F.broadcast(common), "signature", "left")
    both = told.where("audit IS NOT NULL").unionByName(told.where("audit IS NULL").drop("cost", "audit").join(rare, "signature"))
    of = lambda signs: F.length("signs") - F.length(F.translate("signs", signs, ""))
    roles = F.translate("signs", TRUNCATED + BLANK + DUPLICATE, SOUND * 3)
    legal = F.size(F.regexp_extract_all(roles, F.lit("(?=su|ua|au)"), F.lit(0)))
    illegal = F.greatest(F.lit(0), F.length(roles) - 1) - legal
    counts = [of(x).cast("long").alias(k) for k, x in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))]
    return both.select("conv_id", "signs", "gaps", *counts, illegal.cast("long").alias("illegal"), "cost", "audit")


def _behind_audits(rows: DataFrame, told: DataFrame) -> DataFrame:
    """A conversation's audit, then its rows in order, dealt by conversation."""
    kept = _prepared(rows).where("there").select("conv_id", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    heads = told.select("conv_id", "audit", F.lit(0).alias("kind"), *[F.lit(None).cast(rows.schema[c].dataType if c == "turn" else "string").alias(c) for c in ("turn", "role")], F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text"))
    return heads.unionByName(kept).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, position, edit, turn, role, text) of each edit, in order; position 0 and edit None begin a conversation, deleted rows have no position."""
    audit, at, state, place, conv = "", 0, _START, 0, None

    def inserted() -> Iterator[tuple]:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            state, at, place = _NEXT[state], at + 1, place + 1
            yield conv, place, "I", None, "user" if state == _USER else "assistant", ""

    for b in slices(batches):
        for c, head, kind, turn, role, text in zip(*[b.column(x).to_pylist() for x in ("conv_id", "audit", "kind", "turn", "role", "text")], strict=True):
            if not kind:
                conv, audit, at, state, place = c, head, 0, _START, 0
                yield conv, 0, None, None, None, None
            else:
                edit, at = audit[at], at + 1
                if edit == "D":
                    yield conv, None, "D", turn, role, text
                else:
                    state = _NEXT[state] if edit == "R" else _AFTER[role[0]][state]
                    place += 1
                    yield conv, place, edit, turn, ("user" if state == _USER else "assistant") if edit == "R" else role, text
            yield from inserted()


def repair(rows: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """(conv_id, position, edit, turn, role, text): the repaired rows in order, inserted ones without a turn, and the deleted ones, without a position."""
    kinds = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, position long, edit string, turn {rows.schema['turn'].dataType.simpleString()}, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = None, []

        def keep(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for b in source:
                schema = schema or pa.schema([("conv_id", b.schema.field("conv_id").type), ("position", pa.int64()), ("edit", pa.string()), ("turn", b.schema.field("turn").type), ("role", pa.string()), ("text", pa.string())])
                yield b

        for r in _replayed(keep(batches)):
            if r[2] is not None:
                out.append(r)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return _behind_audits(rows, told if told is not None else audits(rows)).mapInArrow(run, kinds)


def report(rows: DataFrame) -> DataFrame:
    """audits() of each conversation without its signs, and repaired_sha256 (of an empty text where nothing is left)."""
    told = audits(rows)
    digests = repaired_digests(repair(rows, told)).withColumnRenamed("conv_id", "_of")
    found = told.drop("signs").join(digests, F.col("conv_id").eqNullSafe(F.col("_of")), "left").drop("_of")
    return found.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of what repair() returns, read in its own order: of `role:text` lines. Conversations of which nothing is left have no row."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv: object = none
        out, arrow, state = [], None, sha256()

        def batch() -> pa.RecordBatch:
            ids, digests = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"])

        for b in slices(batches):
            arrow = b.schema.field("conv_id").type
            for c, place, role, text in zip(*[b.column(x).to_pylist() for x in ("conv_id", "position", "role", "text")], strict=True):
                if place is None:
                    continue
                if place == 1:
                    if conv is not none:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, sha256()
                state.update((("\n" if place > 1 else "") + role + ":" + text).encode("utf-8"))
            if len(out) > 1000:
                yield batch()
                out.clear()
        if conv is not none:
            out.append((conv, state.hexdigest()))
        if out:
            yield batch()

    return repaired.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def _relaxed_sql(costs: str) -> str:
    """Costs of the four states after up to two insertions."""
    once = "[least(c[1], 3 + c[3]), least(c[2], 3 + c[3]), least(c[3], 3 + c[4]), least(c[4], 3 + c[3])]"
    return f"list_transform([list_transform([{costs}], lambda c: {once})[1]], lambda c: {once})[1]"


_BARE_SQL = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_EXTRA_SQL = "(CASE WHEN g <> lower(g) THEN 3 ELSE 0 END)"
#: Costs before a row with sign g, from the costs n behind it: delete, keep, rerole.
_STEP_SQL = f"""[least(4 + n[1], CASE lower(g) WHEN 's' THEN n[2] WHEN 'u' THEN n[3] ELSE 99999999 END + {_EXTRA_SQL}, CASE WHEN g <> 'x' THEN n[3] + 3 + {_EXTRA_SQL} ELSE 99999999 END),
 least(4 + n[2], CASE lower(g) WHEN 'u' THEN n[3] ELSE 99999999 END + {_EXTRA_SQL}, CASE WHEN g <> 'x' THEN n[3] + 3 + {_EXTRA_SQL} ELSE 99999999 END),
 least(4 + n[3], CASE lower(g) WHEN 'a' THEN n[4] ELSE 99999999 END + {_EXTRA_SQL}, CASE WHEN g <> 'x' THEN n[4] + 3 + {_EXTRA_SQL} ELSE 99999999 END),
 least(4 + n[4], CASE lower(g) WHEN 'u' THEN n[3] ELSE 99999999 END + {_EXTRA_SQL}, CASE WHEN g <> 'x' THEN n[3] + 3 + {_EXTRA_SQL} ELSE 99999999 END)]"""
ORACLE_SQL = f"""
WITH RECURSIVE s AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM s, (VALUES (1), (2)) AS t(times) WHERE k <> 0 AND (times = 1 OR k = 3)),
o AS (SELECT *, {_BARE_SQL} AS bare, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(octet_length(encode(role)) || ':' || role || text)) AS i FROM d),
f AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM o),
g AS MATERIALIZED (SELECT conv_id, list(CASE WHEN fault IN ('b', 'd') THEN 'x' WHEN fault = 't' THEN upper(r) ELSE r END ORDER BY i) AS sig, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
sigs AS MATERIALIZED (SELECT DISTINCT sig FROM g),
c AS (SELECT sig, len(sig) + 1 AS i, {_relaxed_sql('[0, 99999999, 99999999, 0]')} AS n FROM sigs
  UNION ALL SELECT sig, i - 1, {_relaxed_sql(_STEP_SQL)} FROM (SELECT sig, i, n, sig[i - 1] AS g FROM c WHERE i > 1)),
cost AS MATERIALIZED (SELECT * FROM c),
w AS (SELECT sig, CAST(1 AS BIGINT) AS i, 0 AS st, n[1] AS rest, '' AS audit FROM cost WHERE i = 1
  UNION ALL SELECT sig, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN st WHEN 'K' THEN CASE lower(g) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE nx END, rest - CASE e WHEN 'D' THEN 4 WHEN 'I' THEN 3 WHEN 'K' THEN x ELSE 3 + x END, audit || e FROM
  (SELECT *, CASE WHEN g IS NOT NULL AND 4 + after[st + 1] = rest THEN 'D' WHEN 3 + now[nx + 1] = rest THEN 'I'
     WHEN (lower(g) = 's' AND st = 0 AND x + after[2] = rest) OR (lower(g) = 'u' AND st <> 2 AND x + after[3] = rest) OR (lower(g) = 'a' AND st = 2 AND x + after[4] = rest) THEN 'K' ELSE 'R' END AS e FROM
   (SELECT w.*, w.sig[w.i] AS g, CASE WHEN w.sig[w.i] <> lower(w.sig[w.i]) THEN 3 ELSE 0 END AS x, CASE st WHEN 2 THEN 3 ELSE 2 END AS nx, a.n AS now, b.n AS after
    FROM w JOIN cost AS a ON a.sig = w.sig AND a.i = w.i LEFT JOIN cost AS b ON b.sig = w.sig AND b.i = w.i + 1 WHERE w.rest > 0 OR w.i <= len(w.sig) OR w.st NOT IN (0, 3)))),
audits AS MATERIALIZED (SELECT sig, arg_max(audit, length(audit)) AS audit FROM w GROUP BY sig),
e AS (SELECT sig, j, edit, CAST(sum(CAST(edit <> 'I' AS INTEGER)) OVER (PARTITION BY sig ORDER BY j) AS BIGINT) AS i, sum(CAST(edit <> 'D' AS INTEGER)) OVER (PARTITION BY sig ORDER BY j) AS p FROM (SELECT sig, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS j FROM audits WHERE audit <> '')),
first AS (SELECT sig, max(CASE WHEN edit = 'K' AND lower(sig[i]) = 's' THEN 1 ELSE 0 END) AS system FROM e WHERE p = 1 AND edit <> 'D' GROUP BY sig),
lines AS (SELECT g.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN f.role WHEN (p - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY j)) AS digest
  FROM g JOIN e ON e.sig = g.sig AND edit <> 'D' JOIN first ON first.sig = g.sig LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.i = e.i AND edit <> 'I' GROUP BY g.conv_id)
SELECT a.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(g.blank, 0)::BIGINT AS blank, coalesce(g.duplicate, 0)::BIGINT AS duplicate, coalesce(g.truncated, 0)::BIGINT AS truncated, coalesce(g.illegal, 0)::BIGINT AS illegal,
  coalesce(cost.n[1], 0)::BIGINT AS cost, coalesce(audits.audit, '') AS audit, coalesce(lines.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN audits ON audits.sig = g.sig LEFT JOIN cost ON cost.sig = g.sig AND cost.i = 1 LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM a.conv_id
"""
