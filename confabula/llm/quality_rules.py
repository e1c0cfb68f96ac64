"""Line-first document cleaning.

Every line is judged on its own by rules for punctuation, navigation and boilerplate; failing lines are removed, and a
document that loses more than a set share of its words that way is rejected. Documents that are too short, or made
mostly of repeated three-word windows, are rejected whatever their lines say.

One pass over the partitions, no shuffle, memory bounded by a batch. Words are runs of anything but ASCII white space.

Defined cases: a null text has no words and no lines, so it fails the base rules; an empty text likewise; a text of any
length is judged whole; documents that are equal get equal verdicts, and repeated rows each have theirs; an empty table
stays empty; columns of the input that have the name of a result column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8

#: Phrases of licence, legal and browser notices in four languages, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "this work is licensed",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "enable javascript",
    "lorem ipsum",
    "tous droits réservés",
    "politique de confidentialité",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "todos los derechos reservados",
    "política de privacidad",
)
#: What may end a short line that isn't a heading or a menu entry.
ENDINGS = (".", "!", "?", ":", ";", ",", '"', "'", ")", "…", "”", "»")


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A line of fewer words must end with punctuation.
    short_line: int = 5
    #: At most so many words may a notice have.
    boilerplate_words: int = 40
    #: A document must keep this share of its words.
    min_kept_percent: int = 70


SYMBOLS = b"#*$%&|<>"
_NOTICE = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
_ENDINGS = tuple(x.encode() for x in ENDINGS)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice, its first occurrence included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    covered, until = 0, 0
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


def line_fails(line: bytes, n_words: int, rules: Rules) -> bool:
    """line has n_words words, at least one."""
    if n_words < rules.short_line and not line.rstrip(b" \t\r\x0b\x0c").endswith(_ENDINGS):
        return True
    marks = sum(map(line.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">", b"!")))
    if 2 * marks > n_words:
        return True
    bars = line.count(b"|")
    if bars >= 2 and 4 * bars >= n_words:
        return True
    return n_words <= rules.boilerplate_words and _NOTICE.search(line.lower()) is not None


def judge(text: bytes | None, rules: Rules) -> dict:
    text = text or b""
    words = text.split()
    n = len(words)
    seen: set[bytes] = set()
    repeated_lines = removed = kept_words = 0
    kept: list[bytes] = []
    for line in text.split(b"\n"):
        w = len(line.split())
        if w:
            repeated_lines += line in seen
            seen.add(line)
            if line_fails(line, w, rules):
                removed += 1
                continue
            kept_words += w
        kept.append(line)
    repeats = repeated_words(words)
    failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    return {
        "n_words": n,
        "word_chars": len(b"".join(words).decode()),
        "n_symbols": sum(text.count(bytes([c])) for c in SYMBOLS),
        "n_dup_lines": repeated_lines,
        "n_repeat_words": repeats,
        "base_failed": failed,
        "n_removed_lines": removed,
        "n_kept_words": kept_words,
        "kept": not failed and 100 * kept_words >= rules.min_kept_percent * n,
        "clean_text": b"\n".join(kept).decode() if removed else None,
    }


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_removed_lines long, n_kept_words long, kept boolean"
_TYPES = {"long": pa.int64(), "boolean": pa.bool_()}
_FIELDS = [(x.split()[0], _TYPES[x.split()[1]]) for x in RESULT.split(", ")]


def apply_rules(docs: DataFrame, text: str = "text", rules: Rules | None = None, clean: bool = False) -> DataFrame:
    """docs with the columns of RESULT. clean: also clean_text, the text without failing lines (null where it lost none)."""
    rules = rules or Rules()
    fields = _FIELDS + ([("clean_text", pa.string())] if clean else [])
    docs = docs.drop(*[c for c, _ in fields if c != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, 4 << 20):
                found = [judge(x, rules) for x in utf8(batch.column(text))]
                yield pa.RecordBatch.from_arrays(batch.columns + [pa.array([x[c] for x in found], kind) for c, kind in fields], names=batch.schema.names + [c for c, _ in fields])

    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [RESULT] + ["clean_text string"] * clean)
    return docs.mapInArrow(run, types)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_sql() -> str:
    r = Rules()
    word = r"[^\x20\x09-\x0D]+"
    endings = "|".join(re.escape(x) for x in ENDINGS).replace("'", "''")
    notices = "|".join(BOILERPLATE)
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
    wins AS (
      SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM wins) WHERE n > 1),
    rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS j FROM twice, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY doc_id),
    lines AS (
      SELECT doc_id, line, pos, len(regexp_extract_all(line, '{word}')) AS n
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d)),
    judged AS (
      SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup,
        (n < {r.short_line} AND NOT regexp_matches(line, '({endings})[ \t\r\x0b\x0c]*$'))
        OR 2 * len(regexp_replace(line, '[^#*$%&<>!]', '', 'g')) > n
        OR (len(line) - len(replace(line, '|', '')) >= 2 AND 4 * (len(line) - len(replace(line, '|', ''))) >= n)
        OR (n <= {r.boilerplate_words} AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{notices}')) AS bad
      FROM lines WHERE n > 0),
    per AS (
      SELECT doc_id, count(*) FILTER (WHERE dup) AS dups, count(*) FILTER (WHERE bad) AS removed, coalesce(sum(n) FILTER (WHERE NOT bad), 0) AS kept_words
      FROM judged GROUP BY doc_id),
    base AS (
      SELECT d.doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS n_removed_lines, coalesce(kept_words, 0)::BIGINT AS n_kept_words
      FROM d LEFT JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id))
    SELECT *, (n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words) AS base_failed,
      NOT (n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words) AND 100 * n_kept_words >= {r.min_kept_percent} * n_words AS kept
    FROM base"""
