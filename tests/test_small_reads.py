"""Steps that must not grow by workers or by listed paths."""

from quarry.functions import providers as M
from quarry.operators import posttrain as P
from quarry.sources import readers


def test_token_counts_in_one_worker(spark):
    rows = spark.createDataFrame([("ab", "", "ccc", None)], "instruction string, input string, chosen string, rejected string")
    got = P.token_counts(rows, M.token_counter(lambda: lambda texts: [len(t) for t in texts]))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.chosen_tokens, r.rejected_tokens, r.prompt_chosen_tokens - r.prompt_tokens) for r in got.collect()] == [(3, 0, 3)]


def test_labelled_folder_is_one_path(spark, tmp_path):
    """A label without files gives no rows, as the folder is listed, not each label's files."""
    (tmp_path / "click_1.jsonl").write_text('{"kind": "click", "n": 1}\n{"kind": "view", "n": 2}\nbroken\n')
    (tmp_path / "other_1.jsonl").write_text('{"kind": "click", "n": 3}\n')
    got = readers.partitioned_jsonl(spark, f"file://{tmp_path}", {"click": "click", "view": "view"}, "kind string, n long", "kind")
    assert [(r.n, r.file_name) for r in got.collect()] == [(1, "click_1.jsonl")]
