"""Queries over messages and sessions, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import messages as M
from ..operators import sessions as S
from ..sources import catalog as C

NOW = "2024-06-01 00:00:00"
BUDGET = 400
MSG = "SELECT conv_id AS session_id, turn AS pos, role, text AS content, (length(text) // 4)::BIGINT AS token_count FROM conversations"
SES = """SELECT o_orderkey AS id, o_custkey AS user_id, 'Chat ' || o_orderkey AS title, o_orderpriority = '1-URGENT' AS is_pinned,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END AS pinned_at, o_orderdate AS updated_at, NULL::VARCHAR AS current_summary FROM orders"""
TURNS = f"""SELECT *, sum((role = 'user')::BIGINT) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_no FROM ({MSG})"""


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def window(spark: SparkSession, d: str) -> DataFrame:
    return M.context_window(C.messages(spark, d), BUDGET)


WINDOW = f"""SELECT *, CASE WHEN run_tokens <= (0.5 * {BUDGET})::INTEGER THEN 'keep' ELSE 'compress' END AS bucket, total_tokens >= floor(0.8 * {BUDGET}) AS needs_compress
  FROM (SELECT *, sum(token_count) OVER (PARTITION BY session_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS run_tokens,
        sum(token_count) OVER (PARTITION BY session_id)::BIGINT AS total_tokens FROM ({MSG}))"""


def history_turns(spark, d):
    return M.turns(C.messages(spark, d)).select("session_id", "pos", "role", "turn_no")


def history_page(spark, d, page=1):
    return M.history_page(C.messages(spark, d), page, 2).select("session_id", "pos", "role", "turn_no", "turn_rank")


def page_sql(page: int, size: int = 2) -> str:
    return f"""SELECT session_id, pos, role, turn_no, turn_rank FROM (
      SELECT *, (max(turn_no) OVER (PARTITION BY session_id) - turn_no + 1)::BIGINT AS turn_rank FROM ({TURNS}))
      WHERE turn_no > 0 AND turn_rank BETWEEN {(page - 1) * size + 1} AND {page * size} AND role IN ('user', 'assistant', 'tool')"""


def backfill(newest):
    def run(spark, d):
        m = C.messages(spark, d)
        done = m.select("session_id").distinct().withColumn("summary_pos", F.expr("nullif(session_id % 3, 0)"))
        return M.backfill(m, done, 2, newest).select("session_id", "pos", "rank")

    return run


def backfill_sql(order: str) -> str:
    return f"""SELECT session_id, pos, rank FROM (SELECT session_id, pos, row_number() OVER (PARTITION BY session_id ORDER BY pos {order}) AS rank
      FROM ({MSG}) WHERE nullif(session_id % 3, 0) IS NULL OR pos > session_id % 3) WHERE rank <= 2"""


def hot_list_50(spark, d):
    rows = C.events(spark, d).select("user_id", "event_id", "ts")
    return M.hot_list(rows, "user_id", [F.desc("ts"), F.desc("event_id")], F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")).select("user_id", "event_id", "rank")


def sections(spark, d):
    w = window(spark, d)
    ids = C.messages(spark, d).select("session_id").distinct()
    facts = ids.where("session_id % 2 = 0").select("session_id", F.explode(F.array(F.lit("likes tea"), F.lit("lives far away"))).alias("fact"))
    summaries = ids.select("session_id", F.expr("if(session_id % 3 = 0, 'So far so good', '')").alias("summary"))
    return M.prompt_sections(w, summaries, facts, "Answer briefly.", chronological=False).select("session_id", "section", "pos", "role", F.length("content").cast("long").alias("n_chars"))


def requests(spark, d, what="id % 5 = 0"):
    """Change requests; every third comes from someone else than the owner."""
    return C.sessions(spark, d).where(what).select("id", F.expr("if(id % 3 = 0, user_id + 1, user_id)").alias("user_id"), F.concat(F.lit("New "), F.col("id").cast("string")).alias("title"))


CHANGED = "SELECT *, id % 5 = 0 AND id % 3 <> 0 AS hit FROM (" + SES + ")"
SHOW = ["id", "user_id", "title", "is_pinned", "pinned_at", "updated_at"]

Q: dict = {
    "history_turns": (history_turns, f"SELECT session_id, pos, role, turn_no FROM ({TURNS})"),
    "history_turns_in_parts": (
        lambda s, d: M.turns(C.messages(s, d), M.long_sessions(C.messages(s, d), 4, 3)).select("session_id", "pos", "role", "turn_no"),
        f"SELECT session_id, pos, role, turn_no FROM ({TURNS})",
    ),
    "context_window_in_parts": (
        lambda s, d: M.context_window(C.messages(s, d), BUDGET, cuts=M.long_sessions(C.messages(s, d), 4, 3)).select("session_id", "pos", "run_tokens", "total_tokens", "bucket", "needs_compress"),
        f"SELECT session_id, pos, run_tokens, total_tokens, bucket, needs_compress FROM ({WINDOW})",
    ),
    "history_page": (history_page, page_sql(1)),
    "history_page_p2": (lambda s, d: history_page(s, d, 2), page_sql(2)),
    "turn_counts": (lambda s, d: M.turn_counts(C.messages(s, d)), f"SELECT session_id, count(*) FILTER (WHERE role = 'user') AS n_turns FROM ({MSG}) GROUP BY 1"),
    "ui_message_groups": (
        lambda s, d: M.ui_groups(C.messages(s, d)),
        f"""SELECT session_id, turn_no, role = 'user' AS is_user, count(*) AS n_parts, min(pos) AS first_pos, max(pos) AS last_pos FROM (
          SELECT *, sum((role = 'user')::BIGINT) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_no FROM ({MSG}) WHERE role <> 'system') GROUP BY 1, 2, 3""",
    ),
    "context_window_split": (lambda s, d: window(s, d).select("session_id", "pos", "run_tokens", "bucket"), f"SELECT session_id, pos, run_tokens, bucket FROM ({WINDOW})"),
    "context_compress_flag": (lambda s, d: window(s, d).groupBy("session_id").agg(F.max("total_tokens").alias("total_tokens"), F.max("needs_compress").alias("needs_compress")), f"SELECT session_id, max(total_tokens) AS total_tokens, bool_or(needs_compress) AS needs_compress FROM ({WINDOW}) GROUP BY 1"),
    "hot_list_50": (
        hot_list_50,
        """SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank, max(ts) OVER (PARTITION BY user_id) AS last FROM events)
          WHERE rank <= 50 AND last >= TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 24 HOURS""",
    ),
    "backfill_oldest_n": (backfill(False), backfill_sql("ASC")),
    "backfill_newest_n": (backfill(True), backfill_sql("DESC")),
    "compress_transcript": (
        lambda s, d: M.transcript(window(s, d).where("bucket = 'compress'")),
        f"SELECT session_id, string_agg(role || ': ' || coalesce(content, 'None'), chr(10) ORDER BY pos) AS transcript FROM ({WINDOW}) WHERE bucket = 'compress' GROUP BY 1",
    ),
    "prompt_sections": (
        sections,
        f"""WITH w AS ({WINDOW}), ids AS (SELECT DISTINCT session_id FROM w)
          SELECT session_id, 1::BIGINT AS section, 0::BIGINT AS pos, 'system' AS role, length('Answer briefly.' || CASE WHEN session_id % 2 = 0 THEN chr(10) || 'likes tea' || chr(10) || 'lives far away' ELSE '' END) AS n_chars FROM ids
          UNION ALL SELECT session_id, 2, 0, 'system', length('So far so good') FROM ids WHERE session_id % 3 = 0
          UNION ALL SELECT session_id, CASE WHEN bucket = 'keep' THEN 3 ELSE 4 END, pos, role, length(content) FROM w""",
    ),
    "session_list_page": (
        lambda s, d: S.session_page(C.sessions(s, d), 1, 5).select("id", "user_id", "rank"),
        f"SELECT id, user_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY is_pinned DESC, pinned_at DESC NULLS LAST, updated_at DESC, id) AS rank FROM ({SES})) WHERE rank <= 5",
    ),
    "session_user_page2": (
        lambda s, d: S.user_page(C.sessions(s, d), 7, 2, 5).select("id", "user_id", "is_pinned"),
        f"SELECT id, user_id, is_pinned FROM ({SES}) WHERE user_id = 7 ORDER BY is_pinned DESC, pinned_at DESC NULLS LAST, updated_at DESC, id LIMIT 5 OFFSET 5",
    ),
    "session_page_totals": (lambda s, d: S.page_totals(C.sessions(s, d), 5), f"SELECT user_id, count(*) AS total, ceil(count(*) / 5.0)::BIGINT AS total_page FROM ({SES}) GROUP BY 1"),
    "session_owner_check": (
        lambda s, d: S.owner_check(C.sessions(s, d), requests(s, d).select("id", "user_id")),
        f"SELECT id, CASE WHEN id % 3 = 0 THEN user_id + 1 ELSE user_id END AS user_id, CASE WHEN id % 3 = 0 THEN 'SESSION_NOT_FOUND' ELSE 'OK' END AS outcome FROM ({SES}) WHERE id % 5 = 0",
    ),
    "session_create": (
        lambda s, d: S.create(C.sessions(s, d), C.sessions(s, d).where("id % 50 = 0").select((F.col("id") + 10**9).alias("id"), "user_id", F.expr("if(id % 100 = 0, '', title)").alias("title")), now()).select(SHOW),
        f"""SELECT id, user_id, title, is_pinned, pinned_at, updated_at FROM ({SES}) UNION ALL
          SELECT id + 1000000000, user_id, CASE WHEN id % 100 = 0 THEN 'New Chat' ELSE title END, false, NULL, TIMESTAMP '{NOW}' FROM ({SES}) WHERE id % 50 = 0""",
    ),
    "session_rename": (
        lambda s, d: S.rename(C.sessions(s, d), requests(s, d), now()).select(SHOW),
        f"SELECT id, user_id, CASE WHEN hit THEN 'New ' || id ELSE title END AS title, is_pinned, pinned_at, CASE WHEN hit THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM ({CHANGED})",
    ),
    "session_pin": (
        lambda s, d: S.pin(C.sessions(s, d), requests(s, d), True, now()).select(SHOW),
        f"SELECT id, user_id, title, is_pinned OR hit AS is_pinned, CASE WHEN hit THEN TIMESTAMP '{NOW}' ELSE pinned_at END AS pinned_at, CASE WHEN hit THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM ({CHANGED})",
    ),
    "session_unpin": (
        lambda s, d: S.pin(C.sessions(s, d), requests(s, d), False, now()).select(SHOW),
        f"SELECT id, user_id, title, is_pinned AND NOT hit AS is_pinned, CASE WHEN NOT hit THEN pinned_at END AS pinned_at, CASE WHEN hit THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at FROM ({CHANGED})",
    ),
    "session_delete": (lambda s, d: S.delete(C.sessions(s, d), requests(s, d)).select(SHOW), f"SELECT id, user_id, title, is_pinned, pinned_at, updated_at FROM ({CHANGED}) WHERE NOT hit"),
    "session_summary_update": (
        lambda s, d: S.set_summary(C.sessions(s, d), C.sessions(s, d).where("id % 4 = 0").select((F.col("id") + F.expr("if(id % 8 = 0, 0, 1000000000)")).alias("id"), F.expr("if(id % 16 = 0, '', 'short')").alias("summary"))).select("id", "current_summary", "updated_at"),
        f"SELECT id, CASE WHEN id % 8 = 0 AND id % 16 <> 0 THEN 'short' END AS current_summary, updated_at FROM ({SES})",
    ),
}
