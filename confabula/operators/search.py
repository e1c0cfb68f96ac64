"""Keyword search over messages through a token table.

Both sides are cut into tokens the same way (lower-case runs of letters and digits, two characters at least), so a query
finds what the index holds. There is no stemming and there are no stop words. Scripts without spaces are cut into pairs of
letters, or, with a lexicon, into words (functions/segmentation.py: tokens for the index, query_tokens for the query).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens, truncate
from ..settings import DEFAULTS
from ..sources.postings import TokenIndex


def token_index(messages: DataFrame, cut: Callable[[Column], Column] = tokens) -> DataFrame:
    """Distinct (token, session_id, pos)."""
    return messages.select(F.explode(F.array_distinct(cut(F.col("content")))).alias("token"), "session_id", "pos")


def words_of(spark: SparkSession, keyword: str, cut: Callable[[Column], Column] = tokens) -> list[str]:
    """The tokens of a keyword, as many as were typed."""
    return spark.range(1).select(F.array_distinct(cut(F.lit(keyword))).alias("w")).first().w


def search(messages: DataFrame, index: DataFrame | TokenIndex, keyword: str, cut: Callable[[Column], Column] = tokens) -> DataFrame:
    """Messages that have any token of the keyword. Its tokens are literal filters on the index.

    index: a token table, or an index on disk, whose folders they choose and whose scan they reach.
    """
    words = words_of(messages.sparkSession, keyword, cut)
    hits = index.postings(words) if isinstance(index, TokenIndex) else index.where(F.col("token").isin(words))
    return messages.join(hits.select("session_id", "pos").distinct(), ["session_id", "pos"], "left_semi")


def in_time_range(rows: DataFrame, time: str, start: Column, end: Column) -> DataFrame:
    """Rows within the bounds that can be parsed; a start that can't also drops the end."""
    lo, hi = F.try_to_timestamp(start), F.try_to_timestamp(end)
    bad_start = start.isNotNull() & lo.isNull()
    at = F.col(time).cast("timestamp")
    return rows.where((lo.isNull() | (at >= lo)) & (bad_start | hi.isNull() | (at <= hi)))


def limit_or_default(value: Column, default: int = 10) -> Column:
    return F.coalesce(F.try_to_number(value, F.lit("999999999")).cast("int"), F.lit(default))


def render(rows: DataFrame, key: str, order: str, stamp: Column, limit: int = DEFAULTS.search_limit, characters: int = DEFAULTS.result_characters) -> DataFrame:
    """The first rows of each key as lines '[role] (time): content', cut at the character limit."""
    from .messages import newest

    line = F.concat(F.lit("["), F.col("role"), F.lit("] ("), stamp, F.lit("): "), F.coalesce("content", F.lit("")))
    first = newest(rows, key, [F.asc(order)], limit).withColumn("line", line)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"])
    return first.groupBy(key).agg(truncate(F.array_join(lines, "\n"), characters).alias("rendered"))
