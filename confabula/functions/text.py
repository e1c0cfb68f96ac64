"""Scalar functions of the chat domain, as column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import DEFAULTS

TRUNCATED = "\n...[truncated]"
KINDS = {"references": "reference", "templates": "template", "scripts": "script", "examples": "example"}


def contains_ignoring_case(text: Column, part: Column) -> Column:
    """An empty part is in nothing."""
    return (part != "") & F.contains(F.lower(text), F.lower(part))


def truncate(text: Column, limit: int = DEFAULTS.result_characters) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(TRUNCATED))).otherwise(text)


def token_estimate(content: Column, known: Column | None = None) -> Column:
    """A known count stays; a null text has none; else a quarter of the characters."""
    guess = F.when(content.isNull(), 0).otherwise(F.floor(F.length(content) / 4)).cast("long")
    return guess if known is None else F.coalesce(known.cast("long"), guess)


def prompt_budget(context: Column, output: Column, default: int = DEFAULTS.context_tokens, reserve: int = DEFAULTS.output_reserve_tokens, least: int = DEFAULTS.least_prompt_tokens) -> Column:
    """Zero counts as missing, as in the chat service."""
    return F.greatest(F.coalesce(F.nullif(context, F.lit(0)), F.lit(default)) - F.coalesce(F.nullif(output, F.lit(0)), F.lit(reserve)), F.lit(least)).cast("long")


_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-case runs of letters and digits of at least that length; runs of scripts without spaces as overlapping pairs."""
    runs = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda x: F.length(x) >= least)
    pairs = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substr(x, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda x: F.when(x.rlike(_UNSPACED), pairs(x)).otherwise(F.array(x))))


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id with a prefix that the same parts always give again."""
    return F.concat(F.lit(prefix), F.md5(F.concat_ws("\0", *[p.cast("string") for p in parts]).cast("binary")))


def iso_time(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def clean_title(text: Column) -> Column:
    """Without white space and quotes around it; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "^[\"']+|[\"']+$", ""), F.lit(""))


def title_or_default(text: Column, default: str = "New Chat") -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def qualified_model(name: Column, prefix: str = "openai/") -> Column:
    return F.when(F.contains(name, F.lit("/")), name).otherwise(F.concat(F.lit(prefix), name))


def masked(key: Column) -> Column:
    hidden = F.concat(F.left(key, F.lit(4)), F.lit("***"), F.right(key, F.lit(4)))
    return F.when(F.length(key) <= 8, F.repeat(F.lit("*"), F.length(key))).otherwise(hidden)


def safe_segment(x: Column) -> Column:
    return (x != "") & ~x.rlike(r"[/\\]") & ~x.isin(".", "..")


def safe_path(x: Column) -> Column:
    """Relative, not empty, and with no part '..'."""
    return F.coalesce((x != "") & ~F.startswith(x, F.lit("/")) & ~F.exists(F.split(x, "/"), lambda p: p == ".."), F.lit(False))


_KEY = r"^skills/([^/]+)/([^/]+)/(.+)$"


def object_key_part(key: Column, part: int) -> Column:
    """1: skill, 2: version, 3: path; null unless the key has the form and all parts are safe."""
    a, b, c = (F.regexp_extract(key, _KEY, i) for i in (1, 2, 3))
    good = key.rlike(_KEY) & safe_segment(a) & safe_segment(b) & safe_path(c)
    return F.when(good, (a, b, c)[part - 1])


def asset_kind(path: Column) -> Column:
    first = F.split_part(path, F.lit("/"), F.lit(1))
    found = F.lit("other")
    for folder, kind in KINDS.items():
        found = F.when(first == folder, kind).otherwise(found)
    return F.when(F.contains(path, F.lit("/")), found).otherwise("other")


def cache_key(key: Column) -> Column:
    return F.sha1(key.cast("binary"))


def utf8_or_null(content: Column) -> Column:
    """The text of bytes that are valid UTF-8, else null."""
    return F.try_validate_utf8(content.cast("string"))


def parsed_object(text: Column) -> Column:
    """A JSON object as a map of strings; an empty map for anything else."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.expr("cast(map() as map<string,string>)"))


def total_pages(total: Column, size: int) -> Column:
    return F.lit(0).cast("long") if size == 0 else F.ceil(total / size).cast("long")
