"""Queries over history with parts, prompts, summaries, event frames and written rows, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import completions as L
from ..operators import deltas as E
from ..operators import history as Y
from ..operators import messages as M
from ..operators import sessions as S
from ..operators import usage as U
from ..sources import catalog as C
from ..sources import written as W
from ..sources.shared import shared_path
from .chat import MSG, NOW, SES, WINDOW, now, window
from .content import CHUNK

RICH = """SELECT conv_id AS session_id, turn * 10 + k AS pos, turn, k, CASE WHEN calls AND k IN (1, 2) THEN 'tool' ELSE role END AS role,
    CASE WHEN calls AND k = 0 THEN NULL WHEN calls AND k = 1 THEN 'old' WHEN calls AND k = 2 THEN left(text, 5) ELSE text END AS content,
    CASE WHEN role = 'assistant' AND turn % 4 = 0 AND k = 0 THEN 'r' || turn END AS reasoning, calls AND k = 0 AS has_calls,
    CASE WHEN calls AND k IN (1, 2) THEN 'c' || turn || 'a' END AS call_id,
    CASE WHEN calls AND k = 1 THEN '' WHEN calls AND k = 2 AND turn % 4 = 0 THEN 'gone' END AS placeholder, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn::BIGINT) AS created_at
  FROM (SELECT *, unnest(CASE WHEN calls THEN [0, 1, 2, 3] ELSE [0] END) AS k FROM (SELECT *, role = 'assistant' AND turn % 2 = 0 AS calls FROM conversations))"""


def shown(spark, d):
    """A digest of every message's parts, one line each."""
    out = M.ui_messages(C.rich_messages(spark, d))
    line = lambda p: F.concat_ws("|", p["kind"], F.coalesce(p["text"], F.lit("-")), F.coalesce(p["call_id"], F.lit("-")), F.coalesce(p["input"], F.lit("-")))
    return out.select("session_id", "turn_no", "role", "first_pos", F.size("parts").cast("long").alias("n_parts"), F.md5(F.array_join(F.transform("parts", line), "\n").cast("binary")).alias("digest"))


SHOWN = f"""WITH m AS (SELECT *, sum((role = 'user')::BIGINT) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_no FROM ({RICH}) WHERE role <> 'system'),
  res AS (SELECT session_id, turn_no, call_id, last(content ORDER BY pos) AS output FROM m WHERE role = 'tool' GROUP BY 1, 2, 3),
  p AS (
    SELECT session_id, turn_no, true AS is_user, pos, 0 AS i, 'text|' || content || '|-|-' AS line FROM m WHERE role = 'user'
    UNION ALL SELECT session_id, turn_no, false, pos, 0, 'step-start|-|-|-' FROM m WHERE role = 'assistant'
    UNION ALL SELECT session_id, turn_no, false, pos, 1, 'reasoning|' || reasoning || '|-|-' FROM m WHERE reasoning IS NOT NULL
    UNION ALL SELECT m.session_id, m.turn_no, false, pos, 2, 'tool-search|' || coalesce(res.output, '') || '|c' || turn || 'a|{{"k": 1}}' FROM m LEFT JOIN res ON res.session_id = m.session_id AND res.turn_no = m.turn_no AND res.call_id = 'c' || turn || 'a' WHERE has_calls
    UNION ALL SELECT session_id, turn_no, false, pos, 3, 'tool-load||c' || turn || 'b|{{}}' FROM m WHERE has_calls
    UNION ALL SELECT session_id, turn_no, false, pos, 4, 'text|' || content || '|-|-' FROM m WHERE role = 'assistant' AND content IS NOT NULL)
  SELECT session_id, turn_no, CASE WHEN is_user THEN 'user' ELSE 'assistant' END AS role, min(pos)::BIGINT AS first_pos, count(*)::BIGINT AS n_parts, md5(string_agg(line, chr(10) ORDER BY pos, i)) AS digest FROM p GROUP BY session_id, turn_no, is_user"""


def owners_history(spark, d):
    """The second page, of one turn, as digests: asked by owners, by others and for sessions that aren't there; some messages have no id."""
    m = C.rich_messages(spark, d).withColumn("id", F.expr("if(pos % 10 = 3 AND session_id % 2 = 0, null, concat('m', pos))"))
    asked = C.sessions(spark, d).select(F.col("id").alias("request_id"), F.expr("if(id % 7 = 0, -id, id)").alias("session_id"), F.expr("if(id % 3 = 0, user_id + 1, user_id)").alias("user_id"))
    out = Y.history(m, C.sessions(spark, d), asked, 2, 1)
    line = lambda p: F.concat_ws("|", *[F.coalesce(p[c], F.lit("-")) for c in ("kind", "text", "state", "call_id", "input")])
    return out.withColumn("digest", F.md5(F.array_join(F.transform("parts", line), "\n").cast("binary"))).drop("parts")


HISTORY = f"""WITH r AS (SELECT id AS request_id, CASE WHEN id % 7 = 0 THEN -id ELSE id END AS session_id, CASE WHEN id % 3 = 0 OR id % 7 = 0 THEN 'SESSION_NOT_FOUND' ELSE 'OK' END AS outcome FROM ({SES})),
  a AS (SELECT *, CASE WHEN pos % 10 = 3 AND session_id % 2 = 0 THEN NULL ELSE 'm' || pos END AS id, sum((role = 'user')::BIGINT) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_no FROM ({RICH})),
  t AS (SELECT session_id, count(*) FILTER (WHERE role = 'user') AS total FROM a GROUP BY 1),
  m AS (SELECT a.* FROM a JOIN t ON t.session_id = a.session_id WHERE turn_no > 0 AND total - turn_no = 1 AND role <> 'system'),
  res AS (SELECT session_id, call_id, last(content ORDER BY pos) AS output FROM m WHERE role = 'tool' GROUP BY 1, 2),
  p AS (
    SELECT session_id, true AS is_user, pos, 0 AS i, 'text|' || content || '|done|-|-' AS line FROM m WHERE role = 'user' AND content <> ''
    UNION ALL SELECT session_id, false, pos, 0, 'step-start|-|-|-|-' FROM m WHERE role = 'assistant'
    UNION ALL SELECT session_id, false, pos, 1, 'reasoning|' || reasoning || '|done|-|-' FROM m WHERE reasoning IS NOT NULL
    UNION ALL SELECT m.session_id, false, pos, 2, 'tool-search|' || coalesce(res.output, '') || '|output-available|c' || turn || 'a|{{"k": 1}}' FROM m LEFT JOIN res ON res.session_id = m.session_id AND res.call_id = 'c' || turn || 'a' WHERE has_calls
    UNION ALL SELECT session_id, false, pos, 3, 'tool-load||output-available|c' || turn || 'b|{{}}' FROM m WHERE has_calls
    UNION ALL SELECT session_id, false, pos, 4, 'text|' || content || '|done|-|-' FROM m WHERE role = 'assistant' AND content <> ''),
  g AS (SELECT session_id, turn_no, role = 'user' AS is_user, min(pos)::BIGINT AS first_pos, strftime(min(created_at), '%Y-%m-%dT%H:%M:%S') AS created_at, coalesce(max_by(id, CASE WHEN role <> 'tool' AND id IS NOT NULL THEN pos END), '') AS id, bool_or(role <> 'tool') AS spoken FROM m GROUP BY 1, 2, 3),
  u AS (SELECT g.*, md5(coalesce((SELECT string_agg(line, chr(10) ORDER BY pos, i) FROM p WHERE p.session_id = g.session_id AND p.is_user = g.is_user), '')) AS digest FROM g WHERE spoken)
  SELECT r.request_id, r.session_id, r.outcome, CASE WHEN r.outcome = 'OK' THEN coalesce(t.total, 0) END AS total, CASE WHEN r.outcome = 'OK' THEN coalesce(t.total, 0) END AS total_page, u.turn_no, u.first_pos, u.id, CASE WHEN u.is_user THEN 'user' WHEN NOT u.is_user THEN 'assistant' END AS role, u.created_at, u.digest
  FROM r LEFT JOIN t ON t.session_id = r.session_id LEFT JOIN u ON u.session_id = r.session_id AND r.outcome = 'OK'"""


def rows_for_model(spark, d):
    return C.rich_messages(spark, d).select("session_id", "pos", M.llm_row().alias("row"))


LLM = f"""SELECT session_id, pos, '{{"role":"' || role || '","content":' || to_json(coalesce(content, '')) ||
    CASE WHEN has_calls THEN ',"tool_calls":[{{"id":"c' || turn || 'a","name":"search","arguments":"{{\\"k\\": 1}}"}},{{"id":"c' || turn || 'b","name":"load","arguments":"oops"}}]' ELSE '' END ||
    CASE WHEN call_id IS NOT NULL THEN ',"tool_call_id":"' || call_id || '","name":"search"' ELSE '' END || '}}' AS row FROM ({RICH})"""


def summarised(spark, d):
    s = C.sessions(spark, d).select("id", "updated_at", "current_summary", F.lit(None).cast("timestamp_ntz").alias("summary_updated_at"))
    given = s.where("id % 4 = 0").select((F.col("id") + F.expr("if(id % 8 = 0, 0, 1000000000)")).alias("id"), F.expr("if(id % 16 = 0, '', 'short')").alias("summary"))
    return S.set_summary(s, given, now())


def newer(spark, d):
    m = C.rich_messages(spark, d)
    s = m.select(F.col("session_id").alias("id")).distinct().withColumn("summary_updated_at", F.expr("if(id % 3 = 0, null, timestampadd(MINUTE, cast(id % 4 as int), timestamp_ntz'2024-01-01 00:00:00'))"))
    return M.after_summary(m, s).select("session_id", "pos")


def old_summaries(spark, d):
    return C.messages(spark, d).select("session_id").distinct().select("session_id", F.expr("CASE session_id % 3 WHEN 0 THEN 'So far' WHEN 1 THEN '' END").alias("summary"))


def prompts(spark, d):
    return M.summary_input(window(spark, d), old_summaries(spark, d)).select("session_id", F.md5(F.col("prompt").cast("binary")).alias("digest"))


PROMPTS = f"""SELECT session_id, md5(CASE WHEN session_id % 3 = 0 THEN 'Summary so far:' || chr(10) || 'So far' || chr(10) || chr(10) ELSE '' END || 'New messages:' || chr(10) || t) AS digest
  FROM (SELECT session_id, string_agg(role || ': ' || coalesce(content, 'None'), chr(10) ORDER BY pos) AS t FROM ({WINDOW}) WHERE needs_compress AND bucket = 'compress' GROUP BY 1)"""


def compressed(spark, d):
    w = window(spark, d)
    answers = w.select("session_id").distinct().select("session_id", F.expr("CASE session_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'all of it' END").alias("summary"))
    return M.summarised(w, answers)[1].select("session_id", "pos")


def turn_order(spark, d):
    m = M.turns(C.rich_messages(spark, d).where("role <> 'system'")).where("turn_no > 0").select("session_id", F.col("turn_no").alias("turn"), "pos", "content", "role")
    final = F.max("pos").over(M.Window.partitionBy("session_id", "turn"))
    m = m.withColumn("last", final)
    own = lambda where: m.where(where).select("session_id", "turn", "pos", "content")
    out = M.turn_rows(own("role = 'user'"), own("role <> 'user' AND pos < last"), own("role <> 'user' AND pos = last"))
    return out.select("session_id", "turn", "pos", "place")


def appended(spark, d):
    m = C.messages(spark, d)
    return M.added(m.where("session_id % 3 > 0 AND pos <= session_id % 3 + 1"), m).select("session_id", "pos")


def facts(spark, d):
    e = C.events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.expr("CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN event_type END").alias("value"), F.expr("CASE event_id % 2 WHEN 0 THEN event_id % 4 = 0 END").alias("disabled")))).alias("states"))
    return e.select("user_id", F.array_join(M.active_facts(F.col("states")), ",").alias("facts"))


def tool_calls(spark, d):
    """Two calls in the first step of every third message."""
    c = C.chunks(spark, d).where("message_id % 3 = 0 AND step = 1").select("message_id", "step").distinct()
    i = F.col("index").cast("string")
    return c.withColumn("index", F.explode(F.array(F.lit(0), F.lit(1)))).select("message_id", "step", "index", F.concat(F.lit("c"), i).alias("call_id"), F.expr("if(index = 0, 'search', 'load')").alias("tool"), F.concat(F.lit('{"k":'), i, F.lit("}")).alias("input"), F.concat(F.lit("out "), i).alias("output"))


def framed(spark, d):
    chunks = C.chunks(spark, d)
    log = E.step_log(E.lifecycle(chunks), chunks.select("message_id", "step").distinct(), tool_calls(spark, d))
    status = F.expr("CASE message_id % 7 WHEN 0 THEN 'aborted' WHEN 1 THEN 'failed' WHEN 2 THEN 'refused' ELSE 'finished' END")
    ends = chunks.select("message_id").distinct().select("message_id", status.alias("status"), F.lit("why").alias("error"))
    return E.frames(log, ends)


def loop_rows(spark, d):
    """Two steps at most; some messages call tools in the first, some in both, some say so without calling any."""
    asks = "step = 1 AND message_id % 3 < 2 OR step = 2 AND message_id % 5 = 0"
    chunks = C.chunks(spark, d).withColumn("finish_reason", F.expr(f"if({asks}, if(seq % 4 = step - 1, 'tool_calls', null), 'length')"))
    both = F.explode(F.array(F.lit(0), F.lit(1)))
    calls = chunks.select("message_id", "step").distinct().where("(message_id + step) % 4 <> 0").select(
        "message_id", "step", both.alias("index")).selectExpr("message_id", "step", "index", "concat('c', step, index) AS call_id", "'search' AS tool", "if(index = 0, '{\"k\":0}', '[1]') AS input", "concat('out', message_id) AS output", "if(index = 1, 'kept short', null) AS placeholder")
    out = L.loop_messages(L.with_warnings(chunks, calls, 2), calls)
    named = F.array_join(F.transform("tool_calls", lambda c: F.concat_ws("|", c["id"], c["name"], c["arguments"])), ",")
    return out.select("message_id", F.col("step").cast("long").alias("step"), "place", "role", "content", "reasoning_content", named.alias("calls"), "tool_call_id", "name", "placeholder")


LOOP = f"""WITH st AS (SELECT message_id, step, coalesce(string_agg(content, '' ORDER BY i), '') AS content, string_agg(reasoning, '' ORDER BY i) AS reasoning, (step = 1 AND message_id % 3 < 2 OR step = 2 AND message_id % 5 = 0) AND bool_or(i % 4 = step - 1) AND (message_id + step) % 4 <> 0 AS goes_on FROM ({CHUNK}) GROUP BY 1, 2),
  e AS (SELECT message_id, min(step) FILTER (WHERE NOT goes_on) AS last FROM st GROUP BY 1), k AS (SELECT st.* FROM st JOIN e ON e.message_id = st.message_id WHERE last IS NULL OR step <= last)
  SELECT message_id, step::BIGINT AS step, 0::BIGINT AS place, 'assistant' AS role, nullif(content, '') AS content, reasoning AS reasoning_content, 'c' || step || '0|search|{{"k":0}},c' || step || '1|search|{{}}' AS calls, NULL AS tool_call_id, NULL AS name, NULL AS placeholder FROM k WHERE goes_on
  UNION ALL SELECT message_id, step, j + 1, 'tool', 'out' || message_id, NULL, NULL, 'c' || step || j, 'search', CASE WHEN j = 1 THEN 'kept short' END FROM k, (VALUES (0), (1)) v(j) WHERE goes_on
  UNION ALL SELECT message_id, step, 0, 'assistant', content, reasoning, NULL, NULL, NULL, NULL FROM k WHERE NOT goes_on
  UNION ALL SELECT k.message_id, 3, 0, 'assistant', 'No answer after 2 steps.', NULL, NULL, NULL, NULL, NULL FROM k JOIN e ON e.message_id = k.message_id WHERE step = 2 AND goes_on AND last IS NULL"""


def line(body: str) -> str:
    return f"'data: {{\"type\":\"' || {body} || '}}' || chr(10) || chr(10)"


FRAMED = f"""WITH c AS ({CHUNK}), st AS (SELECT message_id, step, max(i) AS last, bool_or(content IS NOT NULL) AS t, bool_or(reasoning IS NOT NULL) AS r FROM c GROUP BY 1, 2),
  k AS (SELECT message_id, step, unnest([0, 1]) AS j FROM st WHERE message_id % 3 = 0 AND step = 1), far AS (SELECT 1099511627776::HUGEINT AS f),
  r AS (SELECT message_id, step, i AS seq, reasoning AS x FROM c WHERE reasoning IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY message_id, step ORDER BY seq) AS n FROM (SELECT message_id, step, i AS seq, content AS x FROM c WHERE content IS NOT NULL)),
  e AS (
    SELECT message_id, step, -1::HUGEINT AS seq, 0 AS sub, {line("'start-step\"'")} AS frame FROM st
    UNION ALL SELECT message_id, step, 4 * f, 0, {line("'finish-step\"'")} FROM st, far
    UNION ALL SELECT message_id, step, seq, 0, {line("'reasoning-start\",\"id\":\"r_' || step || '\"'")} FROM r
    UNION ALL SELECT message_id, step, seq, 1, {line("'reasoning-delta\",\"id\":\"r_' || step || '\",\"delta\":' || to_json(x)")} FROM r
    UNION ALL SELECT r.message_id, r.step, coalesce(t.seq, r.seq), CASE WHEN t.seq IS NULL THEN 5 ELSE 2 END, {line("'reasoning-end\",\"id\":\"r_' || r.step || '\"'")} FROM r LEFT JOIN t ON t.message_id = r.message_id AND t.step = r.step AND t.n = 1
    UNION ALL SELECT message_id, step, seq, 3, {line("'text-start\",\"id\":\"t_' || step || '\"'")} FROM t WHERE n = 1
    UNION ALL SELECT message_id, step, seq, 4, {line("'text-delta\",\"id\":\"t_' || step || '\",\"delta\":' || to_json(x)")} FROM t
    UNION ALL SELECT message_id, step, last, 6, {line("'text-end\",\"id\":\"t_' || step || '\"'")} FROM st WHERE t
    UNION ALL SELECT message_id, step, f + j, 0, {line("'tool-input-start\",\"toolCallId\":\"c' || j || '\",\"toolName\":\"' || CASE j WHEN 0 THEN 'search' ELSE 'load' END || '\"'")} FROM k, far
    UNION ALL SELECT message_id, step, f + j, 1, {line("'tool-input-available\",\"toolCallId\":\"c' || j || '\",\"toolName\":\"' || CASE j WHEN 0 THEN 'search' ELSE 'load' END || '\",\"input\":{\"k\":' || j || '}'")} FROM k, far
    UNION ALL SELECT message_id, step, 2 * f + j, 0, {line("'tool-output-available\",\"toolCallId\":\"c' || j || '\",\"output\":\"out ' || j || '\"'")} FROM k, far),
  n AS (SELECT message_id, count(*) AS last, message_id % 7 AS s FROM e GROUP BY 1)
  SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY step, seq, sub) AS n, frame FROM e
  UNION ALL SELECT message_id, 0, {line("'start\",\"messageId\":\"msg_' || message_id || '\"'")} FROM n
  UNION ALL SELECT message_id, last + 1, chr(10) || '[System Error]: why' FROM n WHERE s = 2
  UNION ALL SELECT message_id, last + 2, CASE s WHEN 0 THEN {line("'abort\",\"reason\":\"user_cancelled\"'")} WHEN 1 THEN {line("'error\",\"errorText\":\"why\"'")} ELSE {line("'finish\"'")} END FROM n
  UNION ALL SELECT message_id, last + 3, 'data: [DONE]' || chr(10) || chr(10) FROM n"""


def whole_prompt(spark, d):
    from .chat import sections

    ids = C.messages(spark, d).select("session_id").distinct()
    base = sections(spark, d).withColumn("content", F.lit("x")).drop("n_chars")
    skills = ids.where("session_id % 4 < 2").select("session_id", F.explode(F.array(F.lit("b-skill"), F.lit("a-skill"))).alias("skill_id"), F.lit("helps").alias("description"))
    frontend = ids.select("session_id", F.expr("if(session_id % 5 = 0, 'page 3', '')").alias("text"))
    queries = ids.select("session_id", F.concat(F.lit("Question "), F.col("session_id").cast("string")).alias("text"))
    return M.full_prompt(base, skills, frontend, queries).select("session_id", "section", "pos", "role", "content")


WHOLE = f"""WITH w AS ({WINDOW}), ids AS (SELECT DISTINCT session_id FROM w)
  SELECT session_id, 1::BIGINT AS section, 0::BIGINT AS pos, 'system' AS role, 'x' AS content FROM ids UNION ALL SELECT session_id, 2, 0, 'system', 'x' FROM ids WHERE session_id % 3 = 0
  UNION ALL SELECT session_id, 3, 0, 'system', '- a-skill: helps' || chr(10) || '- b-skill: helps' FROM ids WHERE session_id % 4 < 2
  UNION ALL SELECT session_id, CASE WHEN bucket = 'keep' THEN 4 ELSE 5 END, pos, role, 'x' FROM w
  UNION ALL SELECT session_id, 6, 0, 'system', 'page 3' FROM ids WHERE session_id % 5 = 0 UNION ALL SELECT session_id, 7, 0, 'user', 'Question ' || session_id FROM ids"""


def reasons(spark, d):
    e = C.events(spark, d).select(F.col("user_id").alias("message_id"), (F.col("event_id") % 3).alias("step"), F.col("event_id").alias("seq"), F.expr("CASE event_id % 4 WHEN 1 THEN 'length' WHEN 2 THEN 'tool_calls' END").alias("finish_reason"))
    return E.finish_reasons(e.where("message_id % 2 = 0 OR seq % 4 IN (0, 3)"))


def written(spark, d):
    path = shared_path(spark, "messages")
    m = C.messages(spark, d)
    for part in ("session_id % 2 = 0", "false", "session_id % 2 = 1"):
        W.append(m.where(part), path, ["role"])
    return spark.read.parquet(path).groupBy("role").agg(F.count("*").alias("n_messages"), F.sum("token_count").alias("tokens"))


def published(spark, d):
    path = shared_path(spark, "topic")
    send = W.publisher(path, "usage", lambda e: None)
    rows = C.messages(spark, d).select("session_id", "pos", "content")
    for number in (0, 1, 1):  # the second batch is run again
        send(rows.where(f"session_id % 2 = {number}"), number)
    return spark.read.parquet(path).select("topic", "value")


def turn_sums(spark, d):
    return U.turn_usage(M.turns(C.messages(spark, d)).withColumn("token_count", F.expr("if(pos % 5 = 0, null, token_count)")), ["session_id", "turn_no"])


def replaced(spark, d):
    rows = C.events(spark, d).select("user_id", "event_id")
    return M.replace_hot_list(rows.where("event_id % 10 = 0"), rows.where("event_id % 10 = 1 AND user_id % 2 = 0"), "user_id")


def titled(spark, d):
    from ..functions.text import clean_title

    s = C.sessions(spark, d).withColumn("title", F.expr("if(id % 3 = 0, 'New Chat', title)"))
    titles = s.select("id", clean_title(F.expr("CASE WHEN id % 5 = 0 THEN ' \"\" ' ELSE concat(' \"Talk ', id, '\"', chr(10)) END")).alias("title"))
    return S.auto_title(s, titles).select("id", "title")


Q: dict = {
    "history_parts": (shown, SHOWN),
    "history_of_owner": (owners_history, HISTORY),
    "loop_messages": (loop_rows, LOOP),
    "model_rows": (rows_for_model, LLM),
    "redacted_messages": (lambda s, d: M.redacted(C.rich_messages(s, d)).select("session_id", "pos", "content"), f"SELECT session_id, pos, coalesce(placeholder, content) AS content FROM ({RICH})"),
    "session_summary_stamped": (summarised, f"SELECT id, updated_at, CASE WHEN id % 8 = 0 AND id % 16 <> 0 THEN 'short' END AS current_summary, CASE WHEN id % 8 = 0 AND id % 16 <> 0 THEN TIMESTAMP '{NOW}' END AS summary_updated_at FROM ({SES})"),
    "messages_after_summary": (newer, f"SELECT session_id, pos FROM ({RICH}) WHERE session_id % 3 = 0 OR created_at > TIMESTAMP '2024-01-01 00:00:00' + to_minutes(session_id % 4)"),
    "summary_prompts": (prompts, PROMPTS),
    "summary_hot_list": (compressed, f"SELECT session_id, pos FROM ({WINDOW}) WHERE bucket = 'keep' AND session_id % 4 > 1"),
    "full_prompt": (whole_prompt, WHOLE),
    "session_response": (lambda s, d: S.response(C.sessions(s, d)), f"SELECT id::VARCHAR AS id, user_id::VARCHAR AS user_id, title, strftime(updated_at, '%Y-%m-%dT%H:%M:%S') AS updated_at FROM ({SES})"),
    "turn_row_order": (
        turn_order,
        f"""SELECT session_id, turn_no AS turn, pos, row_number() OVER (PARTITION BY session_id, turn_no ORDER BY pos) AS place FROM (
          SELECT *, sum((role = 'user')::BIGINT) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_no FROM ({RICH}) WHERE role <> 'system') WHERE turn_no > 0""",
    ),
    "appended_rows": (
        appended,
        f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS place, count(*) FILTER (WHERE session_id % 3 > 0 AND pos <= session_id % 3 + 1) OVER (PARTITION BY session_id) AS had FROM ({MSG}))
          SELECT session_id, pos FROM m WHERE place > had""",
    ),
    "active_facts": (
        facts,
        "SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY event_id) FILTER (WHERE event_id % 3 = 1 AND event_id % 4 <> 0), '') AS facts FROM events GROUP BY 1",
    ),
    "event_frames": (framed, FRAMED),
    "finish_reasons": (
        reasons,
        """SELECT user_id AS message_id, event_id % 3 AS step, coalesce(last(CASE event_id % 4 WHEN 1 THEN 'length' ELSE 'tool_calls' END ORDER BY event_id) FILTER (WHERE event_id % 4 IN (1, 2)), 'stop') AS finish_reason
          FROM events WHERE user_id % 2 = 0 OR event_id % 4 IN (0, 3) GROUP BY 1, 2""",
    ),
    "append_messages": (written, f"SELECT role, count(*) AS n_messages, sum(token_count)::BIGINT AS tokens FROM ({MSG}) GROUP BY 1"),
    "publish_rows": (published, f"""SELECT 'usage' AS topic, '{{"session_id":' || session_id || ',"pos":' || pos || ',"content":' || to_json(content) || '}}' AS value FROM ({MSG})"""),
    "turn_usage": (
        turn_sums,
        f"""SELECT session_id, turn_no, sum(CASE WHEN pos % 5 = 0 THEN 0 ELSE token_count END)::BIGINT AS usage_tokens FROM (
          SELECT *, sum((role = 'user')::BIGINT) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_no FROM ({MSG})) GROUP BY 1, 2 HAVING usage_tokens > 0""",
    ),
    "hot_list_replace": (
        replaced,
        """WITH new AS (SELECT user_id, event_id FROM events WHERE event_id % 10 = 1 AND user_id % 2 = 0)
          SELECT user_id, event_id FROM events WHERE event_id % 10 = 0 AND user_id NOT IN (SELECT user_id FROM new) UNION ALL SELECT * FROM new""",
    ),
    "auto_title": (titled, f"SELECT id, CASE WHEN id % 3 <> 0 THEN title WHEN id % 5 = 0 THEN 'New Chat' ELSE 'Talk ' || id END AS title FROM ({SES})"),
}
