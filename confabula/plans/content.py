"""Queries over text: search, skills, tools, memory, deltas and scalar functions, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.segmentation import Segmenter
from ..operators import deltas as E
from ..operators import memory as V
from ..operators import search as H
from ..operators import skills as K
from ..operators import tools as X
from ..sources import catalog as C
from ..sources.postings import TokenIndex
from ..sources.shared import shared_path
from .chat import MSG

KEYWORD = "The, house of QUE"
TOK = f"""SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2)) AS token, session_id, pos FROM ({MSG})"""
HIT = f"""SELECT DISTINCT session_id, pos FROM ({TOK}) WHERE token IN ('the', 'house', 'of', 'que')"""


_INDEXES: dict[tuple[str, str], str] = {}


def written_index(spark, d):
    """The token index of the messages, kept for a session and directory; it follows the table's files at every search."""
    key = (spark.sparkContext.applicationId, d)
    index = TokenIndex(spark, _INDEXES.setdefault(key, shared_path(spark, "token-index")), T.tokens)
    index.follow(f"{d}/conversations.parquet", C.messages_of)
    return index


def found(spark, d):
    return H.search(C.messages(spark, d), written_index(spark, d), KEYWORD)


def grown(spark, d):
    """An index of some messages, to which others are added; some change, some go, and the segments are merged."""
    m = C.messages(spark, d)
    index = TokenIndex(spark, shared_path(spark, "grown-index"), T.tokens)
    index.add(m.where("session_id % 3 <> 1"))
    index.add(m.where("session_id % 3 = 1"))
    index.change(m.where("pos = 2").withColumn("content", F.lit("house")))
    index.delete(m.where("pos = 1 AND session_id % 2 = 0"))
    index.merge()
    index.change(m.where("pos = 3").withColumn("content", F.lit("nothing here")))
    return index.postings(H.words_of(spark, KEYWORD)).select("session_id", "pos", "token")


def segments(spark, d):
    """Every word of the messages, as if it were written without spaces, cut by the short words of the same messages that are usual."""
    words = C.messages(spark, d).select(F.explode(T.tokens(F.col("content"), 1)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("word", "n", F.array_join(Segmenter(words.where("n >= 20 AND length(word) <= 6")).path(F.col("word")), " ").alias("path"))


#: One position of all words in each step: the least cost up to there, of all words that end there, and the path that has it.
SEGMENTS = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS word FROM ({MSG})) GROUP BY 1),
  lexicon AS (SELECT word AS part, n FROM w WHERE n >= 20 AND length(word) <= 6), total AS (SELECT sum(n) AS t FROM lexicon),
  spots AS (SELECT word, s, unnest(range(s + 1, least(length(word), s + 6) + 1)) AS e FROM (SELECT word, unnest(range(length(word))) AS s FROM w)),
  edges AS MATERIALIZED (SELECT word, e, list({{'s': s, 'cost': CAST(floor(1000 * ln(t / coalesce(n, 1)) + 0.5) AS BIGINT), 'part': part}}) AS choices
    FROM (SELECT word, e, s, substr(word, s + 1, e - s) AS part FROM spots) LEFT JOIN lexicon USING (part), total WHERE n IS NOT NULL OR e - s = 1 GROUP BY 1, 2),
  walk AS (SELECT word, 0 AS e, [0::BIGINT] AS best, [''] AS paths FROM w UNION ALL
    SELECT word, e, list_append(best, (least // 1000)::BIGINT), list_append(paths, ltrim(paths[least % 1000 + 1] || ' ' || substr(word, (least % 1000 + 1)::BIGINT, (e - least % 1000)::BIGINT))) FROM (
      SELECT walk.word, walk.e + 1 AS e, best, paths, list_min(list_transform(choices, lambda x: (best[x.s + 1] + x.cost) * 1000 + x.s)) AS least
      FROM walk JOIN edges ON edges.word = walk.word AND edges.e = walk.e + 1))
  SELECT w.word, w.n, paths[length(w.word) + 1] AS path FROM w JOIN walk ON walk.word = w.word AND walk.e = length(w.word)"""


def timed(spark, d):
    rows = found(spark, d).withColumn("created_at", F.expr("timestampadd(MINUTE, cast(pos as int), timestamp_ntz'2024-01-01 00:00:00')"))
    return H.in_time_range(rows, "created_at", F.lit("2024-01-01T00:02:00"), F.lit("2024-01-01T00:05:00")).select("session_id", "pos")


def matched(spark, d):
    docs = C.table(spark, d, "documents").select("doc_id", "text")
    return K.match(docs, C.skills(spark), "doc_id", "text", 2)


def many_triggers(spark, d):
    """Every benchmark item is a skill; its triggers are the words of its text."""
    items = C.table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("skill_id"), F.lit(True).alias("enabled"), F.split("text", " ").alias("triggers"))
    return K.match(C.table(spark, d, "documents").select("doc_id", "text"), items, "doc_id", "text", 3)


SKILLS = ", ".join(f"('{i}', [{', '.join(repr(t) for t in ts)}])" for i, _, e, ts in C.SKILLS if e)


def visible(spark, d):
    tools = spark.sql("SELECT * FROM VALUES ('search', true), ('load', false), ('draw', true), ('count', true) AS t(tool, default_visible)")
    some = "filter(array('search', 'load', 'draw', 'count'), (x, i) -> shiftright({}, i) % 2 = 1)"
    scopes = C.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("scope_id"), F.expr(some.format("n_nationkey")).alias("expose"), F.expr("if(n_nationkey % 3 = 0, null, " + some.format("n_nationkey div 2") + ")").alias("allow"), F.expr(some.format("n_nationkey div 3")).alias("deny"))
    return K.visible_tools(tools, scopes)


def bit(n: str, i: int) -> str:
    return f"(({n}) >> {i}) % 2 = 1"


VISIBLE = " UNION ALL ".join(
    f"SELECT n_nationkey::BIGINT AS scope_id, '{t}' AS tool FROM nation WHERE CASE WHEN {str(v).lower()} THEN (n_nationkey % 3 = 0 OR {bit('n_nationkey // 2', i)}) AND NOT {bit('n_nationkey // 3', i)} ELSE {bit('n_nationkey', i)} END"
    for i, (t, v) in enumerate((("search", True), ("load", False), ("draw", True), ("count", True)))
)


def keys(spark, d):
    """Object keys made from page urls; some are damaged on purpose."""
    p = C.table(spark, d, "pages").select("page_id", "url")
    tail = F.expr("array('references/a.md', 'x/../b', 'notes', '/abs', 'templates/t/u.txt', 'scripts/s.py')[cast(page_id % 6 as int)]")
    return p.select("page_id", tail.alias("path"), F.concat(F.expr("if(page_id % 5 = 0, 'other/', 'skills/')"), F.concat(F.lit("s"), F.col("page_id").cast("string")), F.expr("if(page_id % 7 = 0, '/../', '/1.0/')"), tail).alias("key"))


PATHS = "(['references/a.md', 'x/../b', 'notes', '/abs', 'templates/t/u.txt', 'scripts/s.py'])[page_id % 6 + 1]"
KEYS = f"""SELECT page_id, {PATHS} AS path, CASE WHEN page_id % 5 = 0 THEN 'other/' ELSE 'skills/' END || 's' || page_id || CASE WHEN page_id % 7 = 0 THEN '/../' ELSE '/1.0/' END || {PATHS} AS key FROM pages"""
SAFE = "path <> '' AND NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..')"


def recalled(threshold):
    def run(spark, d):
        m = C.memories(spark, d)
        asked = m.where("id % 20 = 0").select(F.col("id").alias("query_id"), "user_id", F.col("embedding").alias("vector"))
        return V.recall(asked, m, 5, threshold)

    return run


def recall_sql(where: str) -> str:
    return f"""SELECT query_id, user_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
      SELECT q.vec_id AS query_id, q.label AS user_id, m.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], m.embedding::DOUBLE[]), 6) AS score
      FROM embeddings q JOIN embeddings m ON m.label = q.label WHERE q.vec_id % 20 = 0) {where}) WHERE rank <= 5"""


def calls(spark, d):
    """Tool-call fragments: each event's JSON arguments in two pieces, some of them damaged."""
    e = C.events(spark, d).select("event_id", "event_type", F.expr("if(event_id % 9 = 0, '[1]', if(event_id % 10 = 0, '{', props))").alias("json"))
    half = F.expr("cast(length(json) div 2 as int)")
    one = e.select(F.col("event_id").alias("message_id"), F.lit(0).alias("seq"), F.lit(0).alias("index"), F.lit("a").alias("id"), F.lit("get_").alias("name"), F.left("json", half).alias("arguments"))
    two = e.select(F.col("event_id").alias("message_id"), F.lit(1).alias("seq"), F.lit(0).alias("index"), F.when(F.col("event_id") % 2 == 0, F.lit("b")).alias("id"), F.col("event_type").alias("name"), F.expr("substr(json, cast(length(json) div 2 as int) + 1)").alias("arguments"))
    return X.parse_calls(one.union(two))


BROKEN = "event_id % 9 = 0 OR event_id % 10 = 0"


def checked(spark, d):
    e = C.events(spark, d).select("event_id", F.expr("""CASE event_id % 7 WHEN 0 THEN '{}' WHEN 1 THEN '{"k": true}' WHEN 2 THEN '{"k": 1, "x": 2}' WHEN 3 THEN '[]' WHEN 4 THEN 'oops' WHEN 5 THEN '{"k": "1"}' ELSE props END""").alias("json"))
    return X.check_arguments(e, "json", ["k"], {"k": "integer"}, True).select("event_id", "error")


CHUNK = """SELECT conv_id * 1000 + turn AS message_id, i, word, (i % 2 + 1)::INTEGER AS step, CASE WHEN i < 2 THEN word END AS reasoning, CASE WHEN i >= 2 THEN word END AS content
  FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i FROM conversations WHERE role = 'assistant')"""


def steps(spark, d):
    e = C.events(spark, d)
    return e.select((F.col("event_id").cast("long") - F.col("event_id") % 5).alias("message_id"), (F.col("event_id") % 5 + 1).alias("step"), F.expr("if(user_id % 3 = 0, 'stop', 'tool_calls')").alias("finish_reason"), (F.col("event_id") % 4).alias("n_tool_calls"))


Q: dict = {
    "token_estimate": (lambda s, d: C.table(s, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens")), "SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE length(text) // 4 END AS tokens FROM documents"),
    "search_tokens_index": (lambda s, d: H.token_index(C.messages(s, d)).groupBy("token").agg(F.count("*").alias("n_messages")), f"SELECT token, count(*) AS n_messages FROM ({TOK}) GROUP BY 1"),
    "search_keyword": (lambda s, d: found(s, d).select("session_id", "pos", "role"), f"SELECT session_id, pos, role FROM ({MSG}) JOIN ({HIT}) USING (session_id, pos)"),
    "word_segments": (segments, SEGMENTS),
    "search_grown_index": (
        grown,
        f"""SELECT session_id, pos, token FROM ({TOK}) WHERE token IN ('the', 'house', 'of', 'que') AND pos NOT IN (2, 3) AND NOT (pos = 1 AND session_id % 2 = 0)
          UNION ALL SELECT session_id, pos, 'house' FROM ({MSG}) WHERE pos = 2""",
    ),
    "search_in_session_timerange": (timed, f"SELECT session_id, pos FROM ({HIT}) WHERE pos BETWEEN 2 AND 5"),
    "search_render": (
        lambda s, d: H.render(found(s, d), "session_id", "pos", F.col("pos").cast("string"), 3, 200),
        f"""SELECT session_id, CASE WHEN length(r) > 200 THEN left(r, 200) || chr(10) || '...[truncated]' ELSE r END AS rendered FROM (
          SELECT session_id, string_agg('[' || role || '] (' || pos || '): ' || content, chr(10) ORDER BY pos) AS r
          FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS rn FROM ({MSG}) JOIN ({HIT}) USING (session_id, pos)) WHERE rn <= 3 GROUP BY 1)""",
    ),
    "skill_match_topk": (
        matched,
        f"""WITH s(skill_id, triggers) AS (VALUES {SKILLS})
          SELECT doc_id, skill_id, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, skill_id) AS rank FROM (
            SELECT doc_id, skill_id, len(list_filter(triggers, lambda t: t <> '' AND contains(lower(text), lower(t))))::BIGINT AS hits FROM documents, s) WHERE hits > 0) WHERE rank <= 2""",
    ),
    "skill_match_many": (
        many_triggers,
        """WITH t AS (SELECT 'b' || item_id AS skill_id, lower(unnest(string_split(text, ' '))) AS trigger FROM benchmark), w AS (SELECT skill_id, trigger, count(*) AS times FROM t WHERE trigger <> '' GROUP BY 1, 2),
          f AS (SELECT doc_id, trigger FROM documents, (SELECT DISTINCT trigger FROM w) WHERE contains(lower(text), trigger))
          SELECT doc_id, skill_id, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, skill_id) AS rank FROM (
            SELECT doc_id, skill_id, sum(times)::BIGINT AS hits FROM f JOIN w USING (trigger) GROUP BY 1, 2)) WHERE rank <= 3""",
    ),
    "tool_visibility": (visible, VISIBLE),
    "truncate_marker": (
        lambda s, d: C.table(s, d, "documents").select("doc_id", F.md5(T.truncate(F.col("text")).cast("binary")).alias("digest")),
        "SELECT doc_id, md5(CASE WHEN length(text) > 4000 THEN left(text, 4000) || chr(10) || '...[truncated]' ELSE text END) AS digest FROM documents",
    ),
    "object_key_parse": (
        lambda s, d: keys(s, d).select("page_id", *[T.object_key_part(F.col("key"), i + 1).alias(n) for i, n in enumerate(("skill", "version", "asset"))]),
        f"""SELECT page_id, CASE WHEN good THEN 's' || page_id END AS skill, CASE WHEN good THEN '1.0' END AS version, CASE WHEN good THEN path END AS asset FROM (SELECT *, page_id % 5 <> 0 AND page_id % 7 <> 0 AND {SAFE} AS good FROM ({KEYS}))""",
    ),
    "path_safety": (lambda s, d: keys(s, d).select("page_id", T.safe_path(F.col("path")).alias("safe")), f"SELECT page_id, {SAFE} AS safe FROM ({KEYS})"),
    "asset_kind": (
        lambda s, d: keys(s, d).select("page_id", T.asset_kind(F.col("path")).alias("kind")),
        f"SELECT page_id, CASE WHEN path LIKE 'references/%' THEN 'reference' WHEN path LIKE 'templates/%' THEN 'template' WHEN path LIKE 'scripts/%' THEN 'script' ELSE 'other' END AS kind FROM ({KEYS})",
    ),
    "sha1_key": (lambda s, d: keys(s, d).select("page_id", T.cache_key(F.col("key")).alias("digest")), f"SELECT page_id, sha1(key) AS digest FROM ({KEYS})"),
    "memory_topk": (recalled(None), recall_sql("")),
    "memory_threshold": (recalled(0.6), recall_sql("WHERE score >= 0.6")),
    "memory_erase_user": (lambda s, d: V.forget_user(C.memories(s, d), F.lit(3)).groupBy("user_id").agg(F.count("*").alias("n_left")), "SELECT label AS user_id, count(*) AS n_left FROM embeddings WHERE label <> 3 GROUP BY 1"),
    "memory_delete": (
        lambda s, d: V.forget(C.memories(s, d), C.memories(s, d).where("id % 2 = 0").select((F.col("id") * 3).alias("id"), "user_id"))[1],
        """SELECT e.vec_id * 3 AS id, e.label AS user_id, CASE WHEN m.vec_id IS NULL THEN 'ABSENT' WHEN m.label = e.label THEN 'DELETED' ELSE 'MEMORY_NOT_FOUND' END AS outcome
          FROM embeddings e LEFT JOIN embeddings m ON m.vec_id = e.vec_id * 3 WHERE e.vec_id % 2 = 0""",
    ),
    "tool_args_parse": (
        lambda s, d: calls(s, d).select("message_id", "id", "name", F.element_at("arguments", F.lit("k")).alias("k"), F.size("arguments").cast("long").alias("n_arguments")),
        f"""SELECT event_id AS message_id, CASE WHEN event_id % 2 = 0 THEN 'b' ELSE 'a' END AS id, 'get_' || event_type AS name, CASE WHEN NOT ({BROKEN}) THEN json_extract_string(props, '$.k') END AS k,
          CASE WHEN {BROKEN} THEN 0 ELSE 1 END::BIGINT AS n_arguments FROM events""",
    ),
    "tool_args_validate": (
        checked,
        """SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'MISSING:k' WHEN 1 THEN 'TYPE:k' WHEN 2 THEN 'UNKNOWN_ARGUMENT' WHEN 3 THEN 'NOT_AN_OBJECT' WHEN 4 THEN 'NOT_AN_OBJECT' WHEN 5 THEN 'TYPE:k' END AS error FROM events""",
    ),
    "delta_fold": (
        lambda s, d: E.fold(C.chunks(s, d)),
        f"""WITH c AS ({CHUNK}), l AS (SELECT *, max(step) OVER (PARTITION BY message_id) AS last FROM c)
          SELECT message_id, max(step)::BIGINT AS step, coalesce(string_agg(reasoning, '' ORDER BY i), '') AS reasoning, coalesce(string_agg(content, '' ORDER BY i), '') AS content FROM l WHERE step = last GROUP BY 1""",
    ),
    "lifecycle_events": (
        lambda s, d: E.lifecycle(C.chunks(s, d)).groupBy("message_id", "event").agg(F.count("*").alias("n")),
        f"""WITH c AS ({CHUNK}), st AS (SELECT message_id, step, count(reasoning) AS r, count(content) AS t FROM c GROUP BY 1, 2),
          e AS (SELECT message_id, unnest(['reasoning-start', 'reasoning-delta', 'reasoning-end', 'text-start', 'text-delta', 'text-end']) AS event, unnest([least(r, 1), r, least(r, 1), least(t, 1), t, least(t, 1)]) AS n FROM st)
          SELECT message_id, event, sum(n)::BIGINT AS n FROM e GROUP BY 1, 2 HAVING sum(n) > 0""",
    ),
    "lifecycle_check": (
        lambda s, d: E.unbalanced(E.lifecycle(C.chunks(s, d)).where("NOT (event = 'text-end' AND message_id % 3 = 0) AND NOT (event = 'reasoning-start' AND message_id % 5 = 0)")).select("message_id", "step"),
        f"""WITH c AS ({CHUNK}), st AS (SELECT message_id, step, count(reasoning) AS r, count(content) AS t FROM c GROUP BY 1, 2)
          SELECT message_id, step FROM st WHERE (message_id % 3 = 0 AND t > 0) OR (message_id % 5 = 0 AND r > 0)""",
    ),
    "exhausted_turns": (
        lambda s, d: E.exhausted(steps(s, d)),
        "SELECT event_id - event_id % 5 AS message_id FROM events WHERE event_id % 5 = 4 AND user_id % 3 <> 0 AND event_id % 4 > 0",
    ),
}
