"""String, hash and path functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space at the ends of a text.
SPACE_CHARS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# The same in Java's regex syntax.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"


def strip(c: Column) -> Column:
    """Remove Unicode white space from both ends (looks at the ends only, not at the whole text)."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def where_found(c: Column, signs: tuple[str, ...], f: Callable[[Column], Column]) -> Column:
    """f(c) where c has one of the signs, else c itself: a search for bytes spares most texts the regex.

    The lambda binds c, so that it is evaluated once however often it is named.
    """
    has = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(s)) for s in signs])
    return F.element_at(F.transform(F.array(c), lambda x: F.when(has(x), f(x)).otherwise(x)), 1)


def blank_to_null(c: Column) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def first_filled(*columns: Column) -> Column:
    """The first column that isn't null or blank, stripped; '' if none is."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def normalise_newlines(c: Column) -> Column:
    return where_found(c, ("\r",), lambda x: F.regexp_replace(x, "\r\n?", "\n"))


def drop_code_fences(c: Column) -> Column:
    return where_found(c, ("```",), lambda x: F.regexp_replace(x, r"(?s)```.*?```", ""))


def unlink(c: Column) -> Column:
    return where_found(c, ("](",), lambda x: F.regexp_replace(x, r"\[([^\]]+)\]\([^)]+\)", "$1"))


def drop_noise_lines(c: Column) -> Column:
    """Without lines that say `Back to top` or `Raw` only; stripped."""
    kept = lambda t: F.array_join(F.filter(F.split(t, "\n"), lambda x: ~x.rlike(r"^\s*(?:Back to top|Raw)\s*$")), "\n")
    return strip(where_found(c, ("Back to top", "Raw"), kept))


def collapse_space(c: Column) -> Column:
    single = where_found(c, ("  ", "\t"), lambda x: F.regexp_replace(x, r"[ \t]+", " "))
    return strip(where_found(single, ("\n\n\n",), lambda x: F.regexp_replace(x, "\n{3,}", "\n\n")))


def clean_markdown(c: Column) -> Column:
    """Line ends, code fences, links, noise lines, white space: in this order."""
    return reduce(lambda x, f: f(x), (normalise_newlines, drop_code_fences, unlink, drop_noise_lines, collapse_space), c)


def short_sha1(c: Column, n: int) -> Column:
    return F.substring(F.sha1(F.encode(c, "utf-8")), 1, n)


def title_of(file_name: Column) -> Column:
    """File name without .md and without a date in brackets of either width."""
    return strip(F.regexp_replace(F.regexp_replace(file_name, r"(?i)\.md$", ""), r"[(（]\d{4}-\d{2}-\d{2}[)）]", ""))


def relative_path(path: Column, root: str) -> Column:
    """Path below root with forward slashes; the whole path if it isn't below root."""
    p, base = F.replace(path, F.lit("\\"), F.lit("/")), root.replace("\\", "/").rstrip("/") + "/"
    return F.when(p.startswith(base), F.substr(p, F.lit(len(base) + 1))).otherwise(p)


def path_group(rel_path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(rel_path, "/"), F.lit(2)), F.lit("unknown"))


def remove_invisible(c: Column) -> Column:
    """Without zero-width spaces and byte order marks; null counts as empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), "[​﻿]", ""))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", " ")


def without_prefix(c: Column, prefix: Column) -> Column:
    """c without the prefix, stripped; c itself if it doesn't start with it."""
    return F.when(F.startswith(c, prefix), strip(F.substr(c, F.length(prefix) + 1))).otherwise(c)


def safe_tag(c: Column, default: str, last_segment: bool = True, trim_underscores: bool = False) -> Column:
    """A name that is safe in file names."""
    name = strip(F.element_at(F.split(c, "/"), -1)) if last_segment else c
    name = F.regexp_replace(name, r"[^a-zA-Z0-9._-]+", "_")
    if trim_underscores:
        name = F.regexp_replace(name, "^_+|_+$", "")
    return F.when(name != "", name).otherwise(F.lit(default))


def prediction_tag(path: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]+$", "")
    return F.regexp_replace(stem, "^answer_(?=.)", "")


# Fixed short names of base models
MODEL_NAMES = {"Qwen2.5-7B-Instruct": "qwen2.5_7b", "Qwen2.5-3B-Instruct": "qwen2.5_3b"}


def model_tag(base: Column, dpo: Column, sft: Column | None = None) -> Column:
    last = lambda c, d: F.coalesce(F.nullif(F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1), F.lit("")), F.lit(d))
    name = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), MODEL_NAMES.items(), last(base, "base"))
    parts = [name] if sft is None else [name, F.lit("__sft_lora_"), last(sft, "sft")]
    return F.concat(*parts, F.lit("__dpo_lora_"), last(dpo, "dpo"))


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def number_contexts(contexts: Column) -> Column:
    """`{i}. {text}` lines of an array in rank order: blanks are left out but count; `(无)` if nothing is left."""
    pairs = F.transform(contexts, lambda x, i: F.struct((i + 1).alias("i"), strip(x).alias("t")))
    lines = F.transform(F.filter(pairs, lambda p: p["t"] != ""), lambda p: F.concat(p["i"].cast("string"), F.lit(". "), p["t"]))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit("(无)"))


def render(template: str, fields: dict[str, Column]) -> Column:
    """template with each {name} of fields filled in. The template is cut once, here; values are never patterns."""
    import re

    parts: list[Column] = []
    for k, piece in enumerate(re.split("\\{(" + "|".join(map(re.escape, fields)) + ")\\}", template)):
        if k % 2:
            parts.append(F.coalesce(fields[piece], F.lit("")))
        elif piece:
            parts.append(F.lit(piece.replace("{{", "{").replace("}}", "}")))
    return F.concat(*parts) if parts else F.lit("")


def render_or_append(template: str, placeholder: str, value: Column) -> Column:
    """template with a literal placeholder replaced; without one, the value is added after a blank line."""
    if placeholder in template:
        return F.replace(F.lit(template), F.lit(placeholder), value)
    return F.concat(F.lit(template + "\n\n"), value)


def chat(user: Column, system: str | None = None) -> Column:
    """Messages for a chat model: [system?, user]."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(*([message("system", F.lit(system))] if system else []), message("user", user))


def last_user_message(messages: Column) -> Column:
    """Content of the last message of the user that isn't blank; '' without one."""
    told = F.filter(messages, lambda m: (m["role"] == "user") & (strip(m["content"]) != ""))
    return F.coalesce(strip(F.try_element_at(told, F.lit(-1))["content"]), F.lit(""))


def first_or_empty(array: Column) -> Column:
    return F.coalesce(F.try_element_at(array, F.lit(1)), F.lit(""))


def prompt_of(instruction: Column, extra: Column) -> Column:
    return F.when(F.coalesce(extra, F.lit("")) != "", F.concat(instruction, F.lit("\n\n"), extra)).otherwise(instruction)


# Head of an article: 第…条 with a number in Chinese characters
ARTICLE = "第[一二三四五六七八九十百千万零〇两]+条"


def article_source(title: Column, piece: Column) -> Column:
    """`title article`, or the one of them that is there, or `unknown`."""
    head = F.nullif(F.regexp_extract(piece, rf"\A{SPACE}*({ARTICLE})", 1), F.lit(""))
    named = F.nullif(F.coalesce(title, F.lit("")), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws(" ", named, head), F.lit("")), F.lit("unknown"))


def chunk_id(doc_id: Column, piece: Column, chunk: Column, text: Column) -> Column:
    return F.format_string("%s_p%04d_c%03d_%s", doc_id, piece, chunk, short_sha1(text, 10))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits; each Han character is a token of its own."""
    low = F.lower(c)
    apart = lambda x: F.when(F.octet_length(x) > F.length(x), F.regexp_replace(x, r"(\p{IsHan})", " $1 ")).otherwise(x)
    spaced = F.element_at(F.transform(F.array(low), apart), 1)  # ASCII texts have no Han character
    return F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda t: t != "")
