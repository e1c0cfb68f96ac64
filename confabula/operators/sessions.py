"""Session listings and owner-checked changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import iso_time, title_or_default, total_pages


def listing() -> list[Column]:
    return [F.desc("is_pinned"), F.desc_nulls_last("pinned_at"), F.desc("updated_at"), F.asc("id")]


def session_page(sessions: DataFrame, page: int, size: int) -> DataFrame:
    """That page of every user's list: pinned first, then by last change."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(*listing())).cast("long")
    return sessions.withColumn("rank", rank).where(F.col("rank").between((page - 1) * size + 1, page * size))


def user_page(sessions: DataFrame, user_id: int, page: int, size: int) -> DataFrame:
    """That page of one user's list, as a bounded top-k."""
    return sessions.where(F.col("user_id") == user_id).orderBy(*listing()).offset((page - 1) * size).limit(size)


def page_totals(sessions: DataFrame, size: int) -> DataFrame:
    return sessions.groupBy("user_id").agg(F.count("*").alias("total")).withColumn("total_page", total_pages(F.col("total"), size))


def owner_check(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (id, user_id). OK, or one error for sessions that are absent and for those of others."""
    own = sessions.select("id", "user_id").withColumn("_own", F.lit(True))
    return requests.join(own, ["id", "user_id"], "left").select("id", "user_id", F.when(F.col("_own"), "OK").otherwise("SESSION_NOT_FOUND").alias("outcome"))


def _changed(sessions: DataFrame, requests: DataFrame, change: dict[str, Column]) -> DataFrame:
    """Requests name (id, user_id) and new values with a leading underscore; only the owner's take effect."""
    hit = F.col("_hit").isNotNull()
    joined = sessions.join(requests.withColumn("_hit", F.lit(True)), ["id", "user_id"], "left")
    return joined.select(*[F.when(hit, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in sessions.columns])


def create(sessions: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """new: (id, user_id, title); an empty title becomes the default one."""
    rows = new.select("id", "user_id", title_or_default(F.col("title")).alias("title"), F.lit(False).alias("is_pinned"), F.lit(None).cast("timestamp_ntz").alias("pinned_at"), now.alias("updated_at"), F.lit(None).cast("string").alias("current_summary"))
    return sessions.unionByName(rows)


def rename(sessions: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    return _changed(sessions, requests.select("id", "user_id", F.col("title").alias("_title")), {"title": title_or_default(F.col("_title")), "updated_at": now})


def pin(sessions: DataFrame, requests: DataFrame, pinned: bool, now: Column) -> DataFrame:
    """Unpinning clears pinned_at; both count as a change."""
    return _changed(sessions, requests.select("id", "user_id"), {"is_pinned": F.lit(pinned), "pinned_at": now if pinned else F.lit(None), "updated_at": now})


def delete(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Messages stay: deleting a session doesn't cascade."""
    return sessions.join(requests.select("id", "user_id"), ["id", "user_id"], "left_anti").select(sessions.columns)


def set_summary(sessions: DataFrame, summaries: DataFrame, now: Column | None = None) -> DataFrame:
    """summaries: (id, summary). Unknown ids are ignored, an empty summary changes nothing, and updated_at stays.

    now: also set summary_updated_at.
    """
    new = summaries.where("coalesce(summary, '') <> ''").select("id", F.col("summary").alias("_summary"))
    joined = sessions.join(new, "id", "left").withColumn("current_summary", F.coalesce("_summary", "current_summary"))
    if now is not None:
        joined = joined.withColumn("summary_updated_at", F.when(F.col("_summary").isNotNull(), now).otherwise(F.col("summary_updated_at")))
    return joined.select(sessions.columns)


def auto_title(sessions: DataFrame, titles: DataFrame, default: str = "New Chat") -> DataFrame:
    """titles: (id, title). Only default titles are replaced, and only by titles that aren't empty."""
    new = titles.where("coalesce(title, '') <> ''").select("id", F.col("title").alias("_title"))
    return sessions.join(new, "id", "left").withColumn("title", F.when(F.col("title") == default, F.coalesce("_title", "title")).otherwise(F.col("title"))).select(sessions.columns)


def response(sessions: DataFrame) -> DataFrame:
    """What clients see of a session: its times as text, and no pin columns."""
    return sessions.select(F.col("id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), "title", iso_time(F.col("updated_at")).alias("updated_at"))
