"""Damaged archives, shards of the benchmark, and visibility rules of HTML."""

import duckdb
import pytest

from quarry.llm import decontaminate, html, queries, warc


class Source:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def members():
    return [warc.member(warc.record(k, f"u{k}", "0" * 64, 40, bytes([65 + k]) * 40 + b"some payload text")) for k in range(5)]


def all_records(data, step=None, damaged=None):
    step = step or len(data)
    return [r for at in range(0, len(data), step) for r in warc.records_in(Source(data), at, min(at + step, len(data)), len(data), damaged)]


def test_padding_after_members_loses_nothing():
    parts = members()
    for data in (b"".join(parts) + bytes(700), parts[0] + bytes(9) + b"".join(parts[1:])):
        for step in (None, 100, 37):
            assert len(all_records(data, step)) == 5


@pytest.mark.parametrize("place", [0, 1, 12, 60, -1])
def test_damage_is_told(place):
    parts = members()
    broken = bytearray(parts[2])
    broken[place] ^= 0x55
    data = b"".join(parts[:2]) + bytes(broken) + b"".join(parts[3:])
    with pytest.raises(warc.DamagedRecord):
        all_records(data)
    told = []
    assert len(all_records(data, damaged=told)) == 4 and told
    with pytest.raises(warc.DamagedRecord):
        all_records(data[:-20])


@pytest.mark.parametrize("shard", [1500, 300])
def test_shards_equal_sql(spark, small, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.op2_decontaminate(spark, small)
    assert len(decontaminate._automata(spark.read.parquet(f"{small}/benchmark.parquet"), "item_id", "text")) > 1
    got = sorted(map(str, (tuple(r) for r in df.collect())))
    result = con.execute(decontaminate.ORACLE_SQL)
    at = [[c[0] for c in result.description].index(c) for c in df.columns]
    assert got == sorted(str(tuple(r[i] for i in at)) for r in result.fetchall())


def test_visibility():
    cases = {
        "<dialog>closed</dialog>a": "a",
        "<dialog open>b</dialog>": "b",
        "<math><mi>x</mi><annotation>no</annotation></math>": "x",
        "<svg><title>no</title><text>drawn</text></svg>": "drawn",
        "<div style='visibility:hidden'>no<span style='visibility: visible'>yes</span></div>": "yes",
        "<ruby>k<rp>(</rp><rt>r</rt></ruby>": "kr",
        "<input type=submit value=Send><input value=typed><input type=hidden value=no>": "Send",
        "<p style='display:none'>no<b style='visibility:visible'>no</b></p>c": "c",
    }
    assert {k: html.to_text(k) for k in cases} == cases


@pytest.mark.parametrize("inner", [1, 2, 30])
def test_members_inside_a_payload_are_no_records(inner):
    """A payload that is an archive itself, kept as it is by deflate: its members begin like records."""
    import zlib

    held = b"".join(warc.member(warc.record(90 + k, "in", "0" * 64, 40, bytes([97 + k]) * 40)) for k in range(inner))
    outer = warc.record(7, "out", "0" * 64, len(held), b"x" * 50 + held + b"y" * 50)
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    data = members()[0] + z.compress(outer) + z.flush() + members()[1]
    assert held[:200] in data
    for step in (10, 33, 100, 777, 10_000):
        found = all_records(data, step)
        assert [len(list(warc.parse(r))) for r in found] == [1, 1, 1], step
        assert found[1] == outer


def test_common_and_rare_payloads(spark, tmp_path):
    """Payloads of many rows are joined by broadcast, others by key: each has one response and the rest revisits."""
    rows = [(k, f"u{k}", "a" * 200 if k % 3 == 0 else "b" * 150 + str(k // 10) if k % 3 == 1 else "short") for k in range(3000)] + [(None, None, "a" * 200), (5000, "x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read(spark, f"file://{tmp_path}/w", payload=False).collect() if r["page_id"]}
    first = {}
    for k, _, html in rows:
        if k is not None:
            first.setdefault(html, k)
    for k, _, html in rows:
        if k is not None:
            revisit = len(html or "") >= 100 and first[html] != k
            assert got[str(k)] == (("revisit", str(first[html])) if revisit else ("response", None)), k
