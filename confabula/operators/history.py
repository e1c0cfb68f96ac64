"""The history of a session as its owner asks for it: ownership, a page of turns, its messages in parts, and the totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_time, total_pages
from .messages import history_page, turn_counts, ui_messages
from .sessions import owner_check


def history(messages: DataFrame, sessions: DataFrame, requests: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """requests: (request_id, session_id, user_id). A row for each message of the page, in order of first_pos; a request without
    messages has one row. messages: as for ui_messages(), with id and created_at.

    outcome is SESSION_NOT_FOUND for a session that is absent or someone else's; such a request sees no totals. total counts
    the session's turns, total_page its pages. Only messages of sessions that may be seen are read further than their key.
    """
    checked = requests.select("request_id", "session_id", "user_id").join(
        owner_check(sessions, requests.select(F.col("session_id").alias("id"), "user_id").distinct()).withColumnRenamed("id", "session_id"), ["session_id", "user_id"], "left"
    ).withColumn("outcome", F.coalesce("outcome", F.lit("SESSION_NOT_FOUND")))
    seen = checked.where("outcome = 'OK'").select("session_id").distinct()
    rows = messages.join(seen, "session_id", "left_semi")
    totals = seen.join(turn_counts(rows), "session_id", "left").select("session_id", F.coalesce("n_turns", F.lit(0)).alias("total"))
    shown = ui_messages(history_page(rows, page, size)).withColumn("created_at", iso_time(F.col("created_at")))
    pages = totals.withColumn("total_page", total_pages(F.col("total"), size)).join(shown, "session_id", "left").withColumnRenamed("session_id", "_session")
    out = checked.join(pages, (F.col("session_id") == F.col("_session")) & (F.col("outcome") == "OK"), "left")
    return out.select("request_id", "session_id", "outcome", "total", "total_page", "turn_no", "first_pos", "id", "role", "created_at", "parts")
