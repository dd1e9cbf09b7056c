"""rewrite_rag_offline against a plain version over whole items and whole answers."""

import re

from pyspark.sql import functions as F

from quarry.config import RetrievalConfig
from quarry.functions import providers as M
from quarry.plans import retrieval


def tokens(text):
    return [t for t in re.sub(r"[\W_]+", " ", text.lower()).split(" ") if t]


def coverage(query, text):
    q = set(tokens(query))
    return round(len(q & set(tokens(text))) / len(q), 6) if q else 0.0


def test_whole_items_count(spark, small):
    cfg = RetrievalConfig()
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    assert any(len(t) > 60 for t in items.values())
    parts = {}
    for r in retrieval._lists(spark, small).orderBy("query_id", "src_order", "rank").collect():
        if r.text.strip():
            p = parts.setdefault(r.query_id, {}).setdefault(r.text.strip(), [0.0, (r.src_order, r.rank), r.text])
            p[0] += 1.0 / (cfg.rrf_k + r.rank)
    want = {}
    for i, found in parts.items():
        q = " ".join(items[i].split())
        fused = sorted(found.values(), key=lambda p: (-round(p[0], 9), p[1]))[: cfg.rrf_top]
        best = sorted(fused, key=lambda p: -coverage(q, p[2]))[: min(10, cfg.context_top)]
        prompt = "\n".join(f"{k}. {p[2].strip()}" for k, p in enumerate(best, 1)) + "\n\n" + q
        answer = prompt.strip().split("\n")[0]
        want[i] = (len(prompt), answer, "1" if coverage(items[i], answer) >= 0.5 else "0", "")
    got = {r.query_id: (r.prompt_len, r.LLM_answer, r.judge_raw, r.error or "") for r in retrieval.rewrite_rag_offline(spark, small).collect()}
    assert any(len(x[1]) > 200 for x in want.values())
    assert got == want


def test_whole_first_line(spark):
    df = spark.createDataFrame([(1, "x" * 900 + "\nrest"), (2, " \n ")], "id long, prompt string")
    assert [r.output for r in M.generate(df, "prompt", M.TemplateProvider).orderBy(F.col("id")).collect()] == ["x" * 900, ""]
