"""Passages around a line that also stands elsewhere."""

import random

from quarry.llm import lines


def test_passages_around_a_common_line(spark):
    """A has the 30-word line only, others one line more on either side; of T1, line, T2 nothing is left in later documents."""
    rng = random.Random(11)
    line = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    rows, want = [], {}
    for case in range(40):
        common, t1, t2 = line(30), [line(rng.randint(10, 14)) for _ in range(2)], [line(rng.randint(10, 14)) for _ in range(2)]
        passage, own = [*t1, common, *t2], [[line(60)] for _ in range(7)]
        i = case * 10
        rows += [(i, [*own[0], common, line(25)]), (i + 1, [*own[1], t1[1], common, line(25)]), (i + 2, [*own[2], common, t2[0], line(10)])]
        rows += [(i + 3, own[3] + passage + own[4]), (i + 4, own[5] + passage + own[6] + passage), (i + 5, passage)]
        # In documents 1 to 3 the common line, and what agrees with an earlier one, goes.
        want |= {i: rows[-6][1], i + 4: own[5] + own[6], i + 5: []}
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.remove(docs, keep_empty=True).collect()}
    assert {i: got[i] for i in want} == {i: "\n".join(t) for i, t in want.items()}


def test_only_repeats_go(spark, small):
    """Every deleted line has an equal one that stays or stands earlier; the first of equal lines stays."""
    texts = {r.doc_id: lines.lines_of(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    at = {}
    for i in sorted(texts):
        for k, x in enumerate(texts[i]):
            at.setdefault(x, (i, k))
    found = lines.repeats(spark.read.parquet(f"{small}/documents.parquet")).collect()
    assert found
    for r in found:
        for k in range(r.first, r.last + 1):
            assert at[texts[r.id][k]] < (r.id, k)
            if r.source_id is not None:
                assert texts[r.source_id][r.source_first + k - r.first] == texts[r.id][k]
