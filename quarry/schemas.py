"""Declared schemas of the entities that dataflows exchange; sources never infer."""

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "array<string>": T.ArrayType(T.StringType())}


def _schema(spec: str) -> T.StructType:
    """Fields written as `name type, ...` (parsed here: Spark's parser needs a session)."""
    pairs = (x.strip().rsplit(" ", 1) for x in spec.split(","))
    return T.StructType([T.StructField(n.strip("`"), _TYPES[t]) for n, t in pairs])


CORPUS_DOC = _schema("doc_id string, title string, rel_path string, law_group string, text string, text_len int, file_sha1 string")
CHUNK = _schema("chunk_id string, doc_id string, title string, law_group string, rel_path string, source string, piece_idx int, chunk_idx int, text string, text_len int")
QA = _schema("query string, answer string")
QA_REWRITE = _schema("query string, answer string, rewrite string")
RETRIEVAL = _schema("retriever string, index string, topk int, question string, reference string, contexts array<string>")
ANSWER = _schema("query string, answer string, LLM_answer string")
JUDGE_DETAIL = _schema("query string, answer string, LLM_answer string, judge_raw string, judge_label int, judge_error string")
INTENT = _schema("`问题` string, `类型` string")
INTENT_PRED = _schema("`问题` string, `真实类型` string, `预测类型` string, raw_output string")
REWRITE_OUT = _schema("`原始问题` string, `改写问题` string")
JOINT_PRED = _schema("`原始问题` string, `改写问题` string, `预测类型` string, `真实类型` string")
LAW_ARTICLE = _schema("law_title string, content string")
SFT = _schema("instruction string, input string, output string")
DPO_CANDIDATE = _schema("id string, instruction string, input string, cand_a string, cand_b string")
DPO_PAIR = _schema("instruction string, input string, chosen string, rejected string")
#: Dataset registry for post-training: name -> file and roles of columns.
REGISTRY = {
    "sft_law": {"file_name": "sft_law.json"},
    "dpo_law": {"file_name": "dpo_law.json", "ranking": True, "columns": {"prompt": "instruction", "query": "input", "chosen": "chosen", "rejected": "rejected"}},
}
