"""Post-training data: SFT filters, preference pairs, self-instruct results, token lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import parse as J
from quarry.functions import text as X
from quarry.functions.providers import TokenCounter
from quarry.operators.corpus import filled


def forum_answers(df: DataFrame) -> DataFrame:
    """Best answers of a forum table (title, question, reply, is_best) as (query, answer); blanks and nulls are left out."""
    best = X.strip(F.lower(F.col("is_best").cast("string"))).isin("1", "1.0", "true")
    q, a = X.remove_invisible(F.col("title")), X.remove_invisible(F.col("reply"))
    return df.where(best).select(q.alias("query"), a.alias("answer")).where("query <> '' AND answer <> ''")


def as_sft(df: DataFrame, query: str = "query", answer: str = "answer") -> DataFrame:
    return df.select(F.col(query).alias("instruction"), F.lit("").alias("input"), F.col(answer).alias("output"))


def sft_filter(df: DataFrame, least: int = 15) -> DataFrame:
    """Rows with an instruction and an output of at least `least` characters."""
    i, o = X.strip(F.coalesce("instruction", F.lit(""))), X.strip(F.coalesce("output", F.lit("")))
    return df.where((i != "") & (o != "") & (F.length(o) >= least))


def generated_sft(df: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """Valid SFT rows out of generated texts; the rest is left out."""
    obj = J.json_object(X.remove_invisible(F.col(raw)), False)
    item = J.valid_sft(J.json_field(obj, "instruction"), J.json_field(obj, "output"))
    return df.withColumn("_item", item).where(F.col("_item").isNotNull()).select(*keep, "_item.*")


def articles(df: DataFrame) -> DataFrame:
    """(law_title, content) of rows (input, answer): the title is cut off the answer's start; rows that lack either are left out."""
    rows = df.select(X.strip(F.col("input")).alias("law_title"), X.without_prefix(X.strip(F.col("answer")), X.strip(F.col("input"))).alias("content"))
    return filled(rows, "law_title", "content")


def preference_pairs(df: DataFrame, verdict: Column) -> DataFrame:
    """(instruction, input, chosen, rejected) of candidates (instruction, input, cand_a, cand_b) by an A/B verdict.

    Blank or equal candidates and rows without a verdict are left out.
    """
    q, a, b = (X.remove_invisible(F.col(c)) for c in ("instruction", "cand_a", "cand_b"))
    rows = df.select(q.alias("instruction"), F.coalesce("input", F.lit("")).alias("input"), a.alias("a"), b.alias("b"), verdict.alias("v"))
    rows = rows.where("instruction <> '' AND a <> '' AND b <> '' AND a <> b AND v IN ('A', 'B')")
    first = F.col("v") == "A"
    return rows.select("instruction", "input", F.when(first, F.col("a")).otherwise(F.col("b")).alias("chosen"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("rejected"))


def position_bias(df: DataFrame, verdict: Column) -> DataFrame:
    """How often either position wins."""
    return df.groupBy(F.coalesce(verdict, F.lit("none")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def token_counts(df: DataFrame, count) -> DataFrame:
    """Token counts of the fields of preference pairs and of prompt + answer; count: Column -> Column."""
    prompt = X.prompt_of(F.col("instruction"), F.col("input"))
    texts = prompt, F.col("chosen"), F.col("rejected")
    counts = count.several(*texts) if isinstance(count, TokenCounter) else F.array(*map(count, texts))
    out = df.select("*", *[counts[k].alias(name) for k, name in enumerate(("prompt_tokens", "chosen_tokens", "rejected_tokens"))])
    return out.withColumns({"prompt_chosen_tokens": F.col("prompt_tokens") + F.col("chosen_tokens"), "prompt_rejected_tokens": F.col("prompt_tokens") + F.col("rejected_tokens")})


def qa_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, query, answer): each user turn with the assistant's next turn.

    An equi-join on (conv_id, turn + 1): no conversation is gathered, however long it is.
    """
    user = conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    reply = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return user.join(reply, ["conv_id", "turn"])


def last_user_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, query): the last user turn that isn't blank; summed, so partial results go before the shuffle."""
    told = conversations.where((F.col("role") == "user") & (X.strip(F.col("text")) != ""))
    return told.groupBy("conv_id").agg(F.max_by(X.strip(F.col("text")), F.struct("turn", "text")).alias("query"))
