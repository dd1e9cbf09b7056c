"""Parsing of model output: JSON objects, labels, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import first_filled, remove_invisible, squeeze, strip

# Intent classes, the words that give them away (in order), and other names of labels.
CLASSES = ["法律类", "违规类", "闲聊类"]
CASCADE = [("法律类", ["法律"]), ("违规类", ["违规", "敏感", "政治", "色情", "暴恐"]), ("闲聊类", ["闲聊", "聊天", "日常", "问候", "天气"])]
ALIASES = {"法律": "法律类", "法务类": "法律类", "违规": "违规类", "敏感": "违规类", "违法类": "违规类", "非法类": "违规类", "闲聊": "闲聊类", "聊天": "闲聊类"}
BOILERPLATE = ["作为一个AI", "作为AI", "作为一名AI", "我无法提供法律建议"]


def is_json_object(c: Column) -> Column:
    """Whether the whole text is one strict JSON object. Text after a closing bracket that mimics an array's end is the known gap."""
    p = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    single = F.try_variant_get(p, "$[1]", "string").isNull() & F.schema_of_variant(p).startswith("ARRAY<OBJECT<")
    return F.coalesce(p.isNotNull() & single & ~F.rtrim(c).endswith("]"), F.lit(False))


def json_span(c: Column) -> Column:
    """From the first { to the last }; null without."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def json_object(c: Column, strict_first: bool = True) -> Column:
    """The text of a JSON object: all of c if it is one, else its span if that is one, else null."""
    span = json_span(c)
    found = F.when(is_json_object(span), span)
    return F.when(is_json_object(strip(c)), strip(c)).otherwise(found) if strict_first else found


def json_field(obj: Column, name: str) -> Column:
    """A field as text, '' if it isn't there."""
    return F.coalesce(F.get_json_object(obj, f"$['{name}']"), F.lit(""))


def balanced(c: Column) -> Column:
    """The first {...} whose brackets balance, quotes not looked at; null without. A fold over the text cut at its brackets."""
    state = lambda text, depth, done: F.struct(text.alias("text"), depth.cast("int").alias("depth"), done.alias("done"))

    def step(held: Column, piece: Column) -> Column:
        depth = held["depth"] + F.when(piece == "{", 1).when((piece == "}") & (held["depth"] > 0), -1).otherwise(0)
        begun = (held["depth"] > 0) | (piece == "{")
        parts = F.when(begun, F.concat(held["text"], F.array(piece))).otherwise(held["text"])
        return F.when(held["done"], held).otherwise(state(parts, depth, (piece == "}") & (held["depth"] == 1)))

    pieces = F.regexp_extract_all(c, F.lit(r"[{}]|[^{}]+"), F.lit(0))
    begin = state(F.array().cast("array<string>"), F.lit(0), F.lit(False))
    return F.aggregate(pieces, begin, step, lambda held: F.when(held["done"], F.array_join(held["text"], "")))


# Fixed pairs of typographic quotes and the plain ones
QUOTES = ("“”‘’", "\"\"''")


def _lenient(c: Column) -> Column:
    """The text as a JSON object, if it is one but for a code fence, typographic or single quotes, or what stands behind its end; else null."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"\A(?i:```(?:json)?)\s*", ""), r"\s*```\z", "")
    plain = F.translate(bare, *QUOTES)
    ended = F.regexp_extract(plain, r"(?s)\A.*\}", 0)
    single = F.when(~F.contains(ended, F.lit('"')), F.replace(ended, F.lit("'"), F.lit('"')))
    return F.when(is_json_object(ended), ended).when(is_json_object(single), single)


def lenient_object(c: Column) -> Column:
    """The first balanced object, else the whole text, as a strict JSON object, or null."""
    return F.coalesce(_lenient(balanced(c)), _lenient(c))


def normalise_qa(query: Column, answer: Column) -> Column:
    """Struct of squeezed query and answer, or null if either is missing or blank."""
    q, a = squeeze(strip(query)), squeeze(strip(answer))
    return F.when((q != "") & (a != ""), F.struct(q.alias("query"), a.alias("answer")))


def valid_sft(instruction: Column, output: Column, least: int = 20) -> Column:
    """Struct (instruction, input, output), or null for blanks, boilerplate and short outputs."""
    i, o = remove_invisible(instruction), remove_invisible(output)
    plain = reduce(lambda x, y: x & y, [~c.startswith(p) for c in (i, o) for p in BOILERPLATE])
    return F.when((i != "") & plain & (F.length(o) >= least), F.struct(i.alias("instruction"), F.lit("").alias("input"), o.alias("output")))


def better_of_two(c: Column) -> Column:
    """A or B from {"better": ...}; null for anything else."""
    v = F.upper(strip(F.get_json_object(json_object(remove_invisible(c), False), "$.better")))
    return F.when(v.isin("A", "B"), v)


def judge_label(c: Column) -> Column:
    """The first 0 or 1 anywhere; null without."""
    return F.nullif(F.regexp_extract(c, "[01]", 0), F.lit("")).cast("int")


def intent(c: Column) -> Column:
    """A class by name, else by a word that gives it away, else UNKNOWN; order decides."""
    t = F.coalesce(c, F.lit(""))
    rules = [(x, [x]) for x in CLASSES] + CASCADE
    case = F
    for label, words in rules:
        case = case.when(reduce(lambda x, y: x | y, [F.contains(t, F.lit(w)) for w in words]), F.lit(label))
    return case.otherwise(F.lit("UNKNOWN"))


def normalise_label(c: Column, empty_as_chat: bool = True) -> Column:
    s = F.replace(strip(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    s = F.coalesce(F.try_element_at(table, s), s)
    return F.when(s == "", F.lit("闲聊类")).otherwise(s) if empty_as_chat else s


def clean_rewrite(c: Column) -> Column:
    """The first line with text, without code fence and quotes."""
    t = strip(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)\A```.*?\n", ""), r"\n```\z", "")
    t = strip(F.regexp_replace(F.regexp_replace(strip(t), '^"+|"+$', ""), "^[“”]+|[“”]+$", ""))
    lines = F.filter(F.transform(F.split(t, r"\r\n|[\n\r  \x85\x0b\x0c\x1c-\x1e]"), strip), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))


def rewrite_or_query(rewrite: Column, query: Column) -> Column:
    return first_filled(rewrite, query)


def raw_metric(raw: Column, name: str) -> Column:
    """A number out of a metrics text such as {'context_recall': 0.42}."""
    return F.nullif(F.regexp_extract(raw, f"'{name}': ([0-9.]+)", 1), F.lit("")).cast("double")


