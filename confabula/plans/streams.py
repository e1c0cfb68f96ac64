"""Streaming queries, run until their input is read; the batch results they must equal are their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import catalog as C
from ..sources.shared import listed, shared_path
from ..streaming import finish, flows, state
from . import catalogue
from .content import CHUNK


def arriving(spark, name, parts, keys, schema):
    """A stream of the parts as files, one part after the other and about a part in a batch. Rows of a key are in one file of a part,
    so files are as many as the shuffle has tasks, and a batch that ends within a part cuts no key's rows there."""
    source, most = shared_path(spark, name), 1
    for number, part in enumerate(parts):
        part.repartition(*keys).write.parquet(f"{source}/in{number}")
        most = max(most, len(listed(spark, f"{source}/in{number}")))
    return flows.file_stream(spark, source, "*.parquet", schema, most)


def ledger(spark, d):
    return flows.finished(flows.usage_by_user(flows.event_stream(spark, d)), "complete", "stream-ledger")


def hours(spark, d):
    return flows.finished(flows.usage_by_hour(flows.event_stream(spark, d)), "complete", "stream-hours")


def user_sessions(spark, d):
    return flows.finished(flows.usage_by_session(flows.event_stream(spark, d)), "complete", "stream-sessions")


def dedup(spark, d):
    twice = flows.event_stream(spark, d)
    twice = twice.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return flows.finished(flows.once_each(twice).select("event_id", "event_type"), "append", "stream-dedup")


def hot(spark, d):
    path = shared_path(spark, "stream-hot")
    state.start(state.rolling(flows.file_stream(spark, d, "events.parquet", flows.EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))), path, "update", lambda batch, _: batch.write.format("noop").mode("overwrite").save()).awaitTermination()
    return state.rolling_lists(spark, path + "-progress").select("user_id", "event_id", "rank")


def closed_hours(spark, d):
    return flows.finished(flows.usage_by_hour(flows.event_stream(spark, d)), "append", "stream-closed-hours")


def updated_users(spark, d):
    """The ledger by user in update mode, merged by key."""
    path, flow = shared_path(spark, "stream-updated"), flows.usage_by_user(flows.event_stream(spark, d))
    flows.start(flow, "update", path, keys=["user_id"]).awaitTermination()
    return flows.KeyedTable(spark, path, flows.columns(flow), ["user_id"]).read()


def lifecycle(spark, d):
    """The chunks come in three parts, cut by seq wherever that falls in a message; the last chunk of a step says that it ends."""
    path = shared_path(spark, "stream-lifecycle")
    chunks = C.chunks(spark, d)
    ends = chunks.groupBy("message_id", "step").agg(F.max("seq").alias("end"))
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("seq"))
    told = chunks.join(ends, ["message_id", "step"]).select("message_id", "step", "seq", at.alias("ts"), "reasoning", "content", F.when(F.col("seq") == F.col("end"), "stop").alias("finish_reason"), F.expr("cast(null as array<struct<index: int, id: string, name: string, arguments: string>>)").alias("tool_calls"))
    stream = arriving(spark, "stream-chunks", [told.where(part) for part in ("seq < 7", "seq >= 7 AND seq < 31", "seq >= 31")], ["message_id", "step"], state.CHUNKS)
    state.start(state.interpreted(stream, "1 day"), path).awaitTermination()
    return spark.read.schema(state.LOG).parquet(path)


_BEFORE = "WINDOW prev AS (PARTITION BY message_id, step ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
LIFECYCLE = f"""WITH k AS (SELECT message_id, step, i AS seq, nullif(reasoning, '') AS r, nullif(content, '') AS t FROM ({CHUNK})),
  w AS (SELECT *, coalesce(bool_or(t IS NOT NULL) OVER prev, false) AS t_open FROM k WHERE r IS NOT NULL OR t IS NOT NULL {_BEFORE}),
  x AS (SELECT *, CASE WHEN t_open THEN coalesce(bool_or(r IS NOT NULL AND t_open) OVER prev, false) ELSE coalesce(bool_or(r IS NOT NULL) OVER prev, false) END AS r_open FROM w {_BEFORE}),
  e AS (SELECT message_id, step, max(seq) AS seq, bool_or(t IS NOT NULL) AS text, bool_or(r IS NOT NULL) AS thought, bool_or(r IS NOT NULL AND t_open) AS later FROM x GROUP BY 1, 2)
  SELECT message_id, step, seq, 0 AS sub, 'reasoning-start' AS event, NULL AS delta FROM x WHERE r IS NOT NULL AND NOT r_open
  UNION ALL SELECT message_id, step, seq, 1, 'reasoning-delta', r FROM x WHERE r IS NOT NULL
  UNION ALL SELECT message_id, step, seq, 2, 'reasoning-end', NULL FROM x WHERE t IS NOT NULL AND NOT t_open AND (r_open OR r IS NOT NULL)
  UNION ALL SELECT message_id, step, seq, 3, 'text-start', NULL FROM x WHERE t IS NOT NULL AND NOT t_open
  UNION ALL SELECT message_id, step, seq, 4, 'text-delta', t FROM x WHERE t IS NOT NULL
  UNION ALL SELECT message_id, step, seq, 5, 'reasoning-end', NULL FROM e WHERE CASE WHEN text THEN later ELSE thought END
  UNION ALL SELECT message_id, step, seq, 6, 'text-end', NULL FROM e WHERE text"""


def exactly_once(spark, d):
    """Usage in three parts; every batch is given to the ledger twice."""
    path = shared_path(spark, "stream-counters")
    stream = arriving(spark, "stream-usage", [C.events(spark, d).where(f"event_id % 3 = {number}") for number in range(3)], ["event_id"], flows.EVENTS)
    own = state.Ledger(spark, path)
    own.create(catalogue.owned_counters(spark, d))

    def step(batch, number):
        for _ in range(2):
            own.step(catalogue.owned_usage(spark, d, batch), number)

    flows.start(stream, "append", path, step).awaitTermination()
    return own


def finished_turns(spark, d):
    """The messages of all conversations come in two parts; what the steps leave is told by kind."""
    path = shared_path(spark, "stream-finished")
    rows = C.messages(spark, d).select(
        "session_id", "pos", "role", "content", F.when(F.col("pos") % 7 == 3, "left out").alias("persisted_output_placeholder"), F.expr("cast(null as bigint)").alias("token_count"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("pos")).alias("ts"),
        (F.col("session_id") % 9).cast("string").alias("user_id"), F.concat_ws("-", "session_id", F.floor(F.col("pos") / 2)).alias("trace_id"), (F.col("session_id") % 8).alias("provider_id"), F.expr("if(session_id % 2 = 0, null, 'o')").alias("owner_user_id"),
        F.expr("if(session_id % 2 = 0, 'SYSTEM', 'USER')").alias("scope"), F.lit(3).cast("long").alias("billing_ratio"), F.lit("m").alias("model_name"), F.lit(1).cast("long").alias("model_type"),
    )
    stream = arriving(spark, "stream-turns", [rows.where(f"(pos div 2) % 2 = {number}") for number in range(2)], ["session_id"], finish.TURNS)
    own = finish.Finisher(spark, path, lambda name, e: None, 5)
    own.ledger.create(spark.range(6).select(F.col("id").alias("provider_id"), F.expr("if(id % 2 = 0, null, 'o')").alias("owner_user_id"), F.lit(0).cast("long").alias("usage_tokens"), F.lit(0).cast("long").alias("billable_usage_tokens")))
    flows.start(stream, "append", path + "-flow", own.run).awaitTermination()
    none = F.lit(None).cast("long")
    hot = own.hot.read().select(F.lit("hot").alias("kind"), F.col("session_id").alias("a"), F.col("pos").alias("b"), F.col("token_count").alias("n"))
    archive = own.archived().select(F.lit("archive"), "session_id", "pos", F.length("content").cast("long"))
    memory = own.memories().groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit("memory"), F.col("user_id").cast("long"), none, "n")
    counted = own.ledger.counters().select(F.lit("ledger"), "provider_id", "usage_tokens", "billable_usage_tokens")
    billed = own.published().select(F.from_json("value", "userId string, usageTokens long").alias("v")).groupBy("v.userId").agg(F.sum("v.usageTokens").alias("n")).select(F.lit("billing"), F.col("userId").cast("long"), none, "n")
    return hot.union(archive).union(memory).union(counted).union(billed)


FINISHED = """WITH m AS (SELECT conv_id AS s, turn AS pos, role, CASE WHEN turn % 7 = 3 THEN 'left out' ELSE text END AS content FROM conversations), t AS (SELECT *, (length(content) // 4)::BIGINT AS tokens FROM m),
  u AS (SELECT s, pos // 2 AS k, sum(tokens)::BIGINT AS usage FROM t GROUP BY 1, 2 HAVING sum(tokens) > 0)
  SELECT 'hot' AS kind, s AS a, pos AS b, tokens AS n FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY pos DESC) AS rank FROM t) WHERE rank <= 5
  UNION ALL SELECT 'archive', s, pos, length(content) FROM t
  UNION ALL SELECT 'memory', s % 9, NULL, count(*) FROM t WHERE role IN ('user', 'assistant') AND content IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'ledger', p.i, coalesce(sum(usage), 0)::BIGINT, coalesce(sum(CASE WHEN p.i % 2 = 0 THEN usage * 3 ELSE 0 END), 0)::BIGINT FROM (SELECT unnest(range(6)) AS i) p LEFT JOIN u ON u.s % 8 = p.i GROUP BY p.i
  UNION ALL SELECT 'billing', s % 9, NULL, sum(usage)::BIGINT FROM u WHERE s % 2 = 0 GROUP BY 2"""

Q: dict = {
    "stream_usage_ledger": (ledger, "SELECT user_id, count(*) AS n_events, sum(floor(value))::BIGINT AS usage_tokens FROM events GROUP BY 1"),
    "stream_usage_by_hour": (hours, "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n_events FROM events GROUP BY 1, 2"),
    "stream_session_usage": (
        user_sessions,
        """SELECT user_id, min(ts) AS started, count(*) AS n_events FROM (
          SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k""",
    ),
    "stream_dedup": (dedup, "SELECT event_id, event_type FROM events"),
    "stream_hot_list": (hot, "SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank, max(ts) OVER (PARTITION BY user_id) AS last, max(ts) OVER () AS now FROM events) WHERE rank <= 50 AND last >= now - INTERVAL 24 HOURS"),
    "stream_hours_closed": (closed_hours, "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n_events FROM events GROUP BY 1, 2 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"),
    "stream_updated_users": (updated_users, "SELECT user_id, count(*) AS n_events, sum(floor(value))::BIGINT AS usage_tokens FROM events GROUP BY 1"),
    "stream_lifecycle": (lifecycle, LIFECYCLE),
    "stream_finished_turns": (finished_turns, FINISHED),
    "stream_ledger": (lambda s, d: exactly_once(s, d).counters(), catalogue.Q["ledger_counters"][1]),
    "stream_ledger_refused": (lambda s, d: exactly_once(s, d).refused().drop("batch").groupBy("provider_id", "owner_user_id", "error").agg(F.sum("usage_tokens").alias("usage_tokens"), F.sum("billable_usage_tokens").alias("billable_usage_tokens")), catalogue.Q["ledger_refused"][1]),
}
