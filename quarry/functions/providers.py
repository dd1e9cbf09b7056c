"""Models behind small interfaces, called in Arrow batches inside tasks, with retry and pacing.

The offline providers are substitutes with a fixed result, for tests and dry runs; they say
nothing about the quality of real models.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import parse as J
from quarry.functions import text as X


class TextProvider(Protocol):
    """Maps a batch of prompts to texts; made once in each task."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


@dataclass(frozen=True)
class Retry:
    attempts: int = 6
    base: float = 2.0


@dataclass(frozen=True)
class Pace:
    """A rate for a whole job: rows are dealt to `tasks` tasks, and each calls at its share of the rate.

    However many tasks run at once, and however often one is tried again, their calls together don't
    exceed calls_per_second (calls of batches, or of single prompts where a provider is asked for these).
    """

    calls_per_second: float
    tasks: int = 1

    def dealt(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.tasks)

    def clock(self, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic) -> Callable[[], None]:
        """A function that waits until the next call of one task is due."""
        step, due = self.tasks / self.calls_per_second, None

        def wait() -> None:
            nonlocal due
            at = now()
            due = at + step if due is None else max(due, at)  # a task that begins anew waits first
            if due > at:
                sleep(due - at)
            due += step

        return wait


def call_with_retry(f: Callable[[list[str]], list[str]], batch: list[str], retry: Retry, sleep: Callable[[float], None] = time.sleep, wait: Callable[[], None] = lambda: None) -> tuple[list[str], list[str | None]]:
    """A text and an error (or None) for each prompt; waits base * 2**(attempt - 1) before it asks again.

    A provider with a method `each` (prompts -> texts or exceptions) is asked again only for the prompts that failed,
    so no good answer is paid for twice; another one for the whole batch.
    """
    each = getattr(f, "each", None)
    texts, errors, todo = [""] * len(batch), [None] * len(batch), list(range(len(batch)))
    for attempt in range(1, retry.attempts + 1):
        if attempt > 1:
            sleep(retry.base * 2 ** (attempt - 2))
        wait()
        asked = [batch[i] for i in todo]
        try:
            got = each(asked) if each else f(asked)
        except Exception as e:  # noqa: BLE001, a provider's error becomes a column
            got = [e] * len(asked)
        for i, x in zip(todo, got, strict=True):
            failed = isinstance(x, Exception)
            texts[i], errors[i] = ("", f"{type(x).__name__}: {x}") if failed else (x, None)
        todo = [i for i in todo if errors[i] is not None]
        if not todo:
            break
    return texts, errors


def generate(df: DataFrame, prompt: str, make: Callable[[], TextProvider], out: str = "output", error: str = "error", batch: int = 32, retry: Retry = Retry(), pace: Pace | None = None) -> DataFrame:
    """df with the provider's text and error for each prompt; pace bounds the calls of the whole job."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(error, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        wait = pace.clock() if pace else lambda: None
        for pdf in batches:
            texts, errors = [], []
            for i in range(0, len(pdf), batch):
                got, e = call_with_retry(provider, pdf[prompt].iloc[i : i + batch].fillna("").tolist(), retry, wait=wait)
                texts += got
                errors += e
            yield pdf.assign(**{out: texts, error: errors})

    return (pace.dealt(df) if pace else df).mapInPandas(run, schema)


@dataclass(frozen=True)
class Generation:
    """Settings of a generating model. Adapters are put on the base model in order: none, the tuned one, then the preference-tuned one."""

    model: str
    mode: str = "base"  # base, sft, dpo or sft+dpo
    sft: str | None = None
    dpo: str | None = None
    temperature: float = 0.0
    max_tokens: int = 512
    system: str | None = None

    def adapters(self) -> list[str]:
        wanted = [] if self.mode == "base" else self.mode.split("+")
        if not set(wanted) <= {"sft", "dpo"}:
            raise ValueError(f"unknown mode: {self.mode}")
        found = [getattr(self, x) for x in ("sft", "dpo") if x in wanted]
        if None in found:
            raise ValueError(f"mode {self.mode} lacks an adapter")
        return found


JUDGE = dict(temperature=0.0, max_tokens=8)
PAIRWISE_JUDGE = dict(temperature=0.0, max_tokens=128)


class ChatApi:
    """A provider behind a chat-completions HTTP interface. endpoints: name -> base address; the caller gives addresses and key."""

    def __init__(self, endpoints: dict[str, str], name: str, key: str, settings: Generation, timeout: float = 60.0, at_once: int = 8) -> None:
        """at_once: prompts of a batch that are under way together."""
        if name not in endpoints:
            raise ValueError(f"unknown provider: {name}")
        self.url, self.key, self.settings, self.timeout, self.at_once = endpoints[name].rstrip("/") + "/chat/completions", key, settings, timeout, at_once

    def _one(self, prompt: str) -> str:
        import json
        from urllib.request import Request, urlopen

        s = self.settings
        messages = [*([{"role": "system", "content": s.system}] if s.system else []), {"role": "user", "content": prompt}]
        body = {"model": s.model, "messages": messages, "temperature": s.temperature, "max_tokens": s.max_tokens}
        request = Request(self.url, json.dumps(body).encode("utf-8"), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"] or ""

    def each(self, prompts: list[str]) -> list[str | Exception]:
        """An answer or an exception for each prompt."""
        from concurrent.futures import ThreadPoolExecutor

        def one(prompt: str) -> str | Exception:
            try:
                return self._one(prompt)
            except Exception as e:  # noqa: BLE001, told to the caller
                return e

        with ThreadPoolExecutor(self.at_once) as pool:
            return list(pool.map(one, prompts))

    def __call__(self, prompts: list[str]) -> list[str]:
        for x in (found := self.each(prompts)):
            if isinstance(x, Exception):
                raise x
        return found


def candidates(df: DataFrame, prompt: str, make: Callable[[float], Callable[[], TextProvider]], temperatures: tuple[float, float] = (0.2, 0.9), retry: Retry = Retry()) -> DataFrame:
    """df with two generations for each prompt, cand_a and cand_b, and their errors; make: temperature -> maker of a provider."""
    for name, t in zip(("a", "b"), temperatures, strict=True):
        df = generate(df, prompt, make(t), f"cand_{name}", f"error_{name}", retry=retry)
    return df


def pairwise_judge(df: DataFrame, template: str, make: Callable[[], TextProvider], retry: Retry = Retry()) -> DataFrame:
    """df (instruction, input, cand_a, cand_b) with judge_raw, judge_error and verdict: A, B or null.

    The template's places are {instruction}, {input}, {cand_a} and {cand_b}.
    """
    names = ("instruction", "input", "cand_a", "cand_b")
    asked = df.withColumn("_prompt", X.render(template, {x: F.col(x) for x in names}))
    return generate(asked, "_prompt", make, "judge_raw", "judge_error", retry=retry).withColumn("verdict", J.better_of_two(F.col("judge_raw"))).drop("_prompt")


def judge(df: DataFrame, template: str, make: Callable[[], TextProvider], retry: Retry = Retry()) -> DataFrame:
    """df (query, answer, LLM_answer) with judge_raw, judge_error and judge_label: 1, 0 or null."""
    asked = df.withColumn("_prompt", X.render(template, {x: F.col(x) for x in ("query", "answer", "LLM_answer")}))
    return generate(asked, "_prompt", make, "judge_raw", "judge_error", retry=retry).withColumn("judge_label", J.judge_label(F.col("judge_raw"))).drop("_prompt")


def score_pairs(df: DataFrame, query: str, text: str, make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], out: str = "score", batch: int = 8) -> DataFrame:
    """df with a cross-encoder's score for each (query, text), asked for in batches; made once in each task. Null texts count as empty."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make()
        for pdf in batches:
            pairs = list(zip(pdf[query].fillna(""), pdf[text].fillna(""), strict=True))
            yield pdf.assign(**{out: [float(x) for i in range(0, len(pairs), batch) for x in score(pairs[i : i + batch])]})

    return df.mapInPandas(run, schema)


class TokenCounter:
    """A Column function text -> number of tokens; several texts of a row are counted by one tokenizer, in one Python worker."""

    def __init__(self, run: Callable[[Column], Column]) -> None:
        self.run = run

    def __call__(self, text: Column) -> Column:
        return self.several(text)[0]

    def several(self, *texts: Column) -> Column:
        """An array of the numbers of tokens of these texts."""
        return self.run(F.array(*texts))


def token_counter(make: Callable[[], Callable[[list[str]], list[int]]]) -> TokenCounter:
    """Token counts by a tokenizer (texts of a batch -> counts), made once in each task; null counts as empty."""

    @F.pandas_udf("array<long>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = make()
        for s in it:
            parts = []
            for i in range(0, len(s), 1000):  # texts are held as Python objects for one part at a time
                rows = s.iloc[i : i + 1000].tolist()
                found = iter(count([t or "" for row in rows for t in row]))
                parts += [[next(found) for _ in row] for row in rows]
            yield pd.Series(parts, dtype=object)

    return TokenCounter(run)


def tokenizer_counts(path: str, batch: int = 512):
    """Token counts by a tokenizer file (without special tokens), for token_counter."""

    def make() -> Callable[[list[str]], list[int]]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def count(texts: list[str]) -> list[int]:
            parts = (texts[i : i + batch] for i in range(0, len(texts), batch))
            return [len(x) for some in parts for x in tokenizer.encode_batch_fast(some, add_special_tokens=False)]

        return count

    return token_counter(make)


def progress(df: DataFrame, error: str | None = None, name: str = "progress") -> tuple[DataFrame, Observation]:
    """df, and an observation of its rows and errors, that is there when an action on df has run."""
    seen = Observation(name)
    failed = F.coalesce(F.col(error), F.lit("")) != "" if error else F.lit(False)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(failed).alias("errors")), seen


def throughput(run: Callable[[], int]) -> dict[str, float]:
    """Rows, seconds and rows a second of an action that returns its number of rows."""
    began = time.time()
    rows = run()
    seconds = max(time.time() - began, 1e-9)
    return {"rows": rows, "time_sec": round(seconds, 3), "rows_per_sec": round(rows / seconds, 3)}


def generate_valid(df: DataFrame, prompt: str, make: Callable[[], TextProvider], valid: Callable[[str], bool], tries: int = 5, out: str = "output") -> DataFrame:
    """df with the first valid text of up to `tries` generations, null without one; tried again inside the task."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField("tries", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for pdf in batches:
            texts, used = [None] * len(pdf), [0] * len(pdf)
            for _ in range(tries):
                todo = [i for i, t in enumerate(texts) if t is None]
                if not todo:
                    break
                for i, t in zip(todo, provider([pdf[prompt].iloc[i] for i in todo]), strict=True):
                    used[i] += 1
                    texts[i] = t if valid(t) else None
            yield pdf.assign(**{out: texts, "tries": used})

    return df.mapInPandas(run, schema)


def embed(make: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32):
    """A Column function text -> array<float> for an embedding provider."""

    @F.pandas_udf("array<float>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make()
        for s in it:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in f(texts[i : i + batch])])

    return run


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors that the mask keeps (native)."""
    kept = F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    n = F.greatest(F.size(kept).cast("double"), F.lit(1e-9))
    width = F.size(F.element_at(tokens, 1))
    return F.transform(F.sequence(F.lit(1), width), lambda i: F.aggregate(kept, F.lit(0.0), lambda s, x: s + F.element_at(x["v"], i).cast("double")) / n)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


# Offline substitutes


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A normed vector of signed token hashes (native)."""
    toks = F.transform(X.tokens(text), lambda t: F.xxhash64(t))
    return l2_normalise(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(toks, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(dims)) == d, F.when(F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)).otherwise(0.0))))


def coverage(query: Column, text: Column) -> Column:
    """Part of the query's different tokens that the text has: stands for a cross-encoder."""
    q = F.array_distinct(X.tokens(query))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, X.tokens(text))).cast("double"), F.size(q).cast("double")), F.lit(0.0)), 6)


def overlap_judge(answer: Column, output: Column, least: float = 0.5) -> Column:
    """'1' if the output covers enough of the answer's tokens, else '0': stands for a judge."""
    return F.when(coverage(answer, output) >= least, F.lit("1")).otherwise(F.lit("0"))


def whitespace_tokens(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != ""))


class TemplateProvider:
    """Answers with the first line of the prompt: stands for a generator."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [p.strip().split("\n")[0] for p in prompts]
