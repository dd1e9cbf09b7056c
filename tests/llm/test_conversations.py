"""Conversation repair against a plain search over all edits."""

import heapq
import itertools
import re
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quarry.llm import conversations as C


def cheapest(signature):
    """Cost and ASCII-least edits by a shortest-path search over (place, roles given so far)."""
    heap, seen = [(0, "", 0, "")], {}
    good = re.compile(r"(s?(ua)+)?")
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(signature) and good.fullmatch(roles):
            return cost, audit
        last = roles[-1:] if len(roles) > 1 or roles != "s" else "s"
        state = (i, last, bool(roles))
        if seen.get(state, (cost, audit)) < (cost, audit):
            continue
        seen[state] = (cost, audit)

        def go(edit, price, step, role, cost=cost, audit=audit, i=i, roles=roles):
            new = roles + role
            if any(re.fullmatch(r"s?(ua)*u?", x) for x in [new]):
                heapq.heappush(heap, (cost + price, audit + edit, i + step, new))

        for r in "ua":
            go("I", 3, 0, r)
        if i < len(signature):
            go("D", 4, 1, "")
            c = signature[i]
            if c != "x":
                extra = 3 if c.isupper() else 0
                if c.lower() in "sua":
                    go("K", extra, 1, c.lower())
                for r in "ua":
                    go("R", 3 + extra, 1, r)
    return None


@pytest.mark.parametrize("n", range(5))
def test_all_short_signatures(n):
    for signs in itertools.product("suaoSUAx", repeat=n):
        assert C.solve("".join(signs)) == cheapest("".join(signs)), signs


def test_long_signature():
    cost, audit = C.solve("ua" * 5000 + "u")
    assert (cost, audit) == (3, "K" * 10001 + "I")


def plain(rows):
    """The whole report by loops, from (conv, turn, role, text) rows."""
    out, convs = {}, {}
    text_of = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        k = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        mine += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\f\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initial = [r[1][:1] if r[1][:1] in ("s", "u", "a") else "o" for r in mine]
        signature = "".join("x" if f in ("b", "d") else i.upper() if f else i for f, i in zip(faults, initial, strict=True))
        cost, audit = cheapest(signature) if len(signature) < 12 else C.solve(signature)
        at, kept, source = 0, [], iter(mine)
        shape = 0
        for e in audit:
            row = None if e == "I" else next(source)
            if e == "D":
                continue
            first_s = kept and kept[0].startswith("s")
            shape = len(kept) - (1 if first_s else 0)
            role = ("user", "assistant")[shape % 2] if e in "IR" else row[1]
            kept.append(f"{role}:{row[2] if row else ''}")
            at += 1
        turns = {r[0] for r in mine if r[0] is not None}
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initial, initial[1:], strict=False)), cost, audit, sha256("\n".join(kept).encode()).hexdigest(),
        )
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in C.report(C.damaged(df)).collect()}


def test_whole_table(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    assert found(df) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


EDGES = [
    (None, 1, "user", "no conversation."), (None, None, "assistant", "no turn."), (1, None, None, None), (2, 1, "user", ""), (2, 2, "assistant", " \t"),
    (3, 1, "user", "Same."), (3, 2, "user", "Same."), (3, 2, "user", "Same."), (3, 9, "assistant", "After a gap"), (4, 1, "tool", "Unknown role."), (4, 2, "", "Empty role."),
    (5, 3, "system", "Late."), (5, 1, "user", "Early?"), (5, 2, "assistant", "Middle!"), (6, 7, "user", "word " * 50_000), (7, -5, "assistant", "日本。"), (7, 5, "system", "é."),
]


def test_edges(spark):
    df = spark.createDataFrame(EDGES, "conv_id long, turn long, role string, text string")
    wide = df.withColumns({c: F.lit("x") for c in ("there", "digest", "audit", "kind", "sign", "position", "cost")})
    assert found(wide) == plain(EDGES)
    assert found(df.limit(0)) == {}
    named = df.withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))
    assert found(named) == plain([(None if c is None else f"c{c}", *r) for c, *r in EDGES])


def test_repaired_rows(spark):
    df = spark.createDataFrame([("x", 1, "user", "One."), ("x", 2, "user", ""), ("x", 3, "user", "Two.")], "conv_id string, turn long, role string, text string")
    got = [tuple(r)[1:] for r in C.repair(df).collect()]
    assert got == [(1, "K", 1, "user", "One."), (None, "D", 2, "user", ""), (2, "R", 3, "assistant", "Two.")]


def test_many_conversations_share_a_signature(spark):
    """Common signatures are joined by broadcast, rare ones by key: none is lost."""
    df = spark.range(2500).select(F.col("id").alias("conv_id"), F.explode(F.sequence(F.lit(0), F.when(F.col("id") % 100 == 0, 2 + F.col("id") / 100).otherwise(1).cast("int"))).alias("turn"))
    df = df.withColumns({"role": F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant"), "text": F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit("."))})
    assert C.audits(df).count() == 2500
