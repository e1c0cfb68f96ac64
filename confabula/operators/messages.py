"""Turns, history pages, context windows, hot lists and transcripts over (session_id, pos, role, content, token_count).

pos orders a session and is unique in it, so ties of time never matter. Every operator works on all sessions at once and
shuffles on session_id at most once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..settings import DEFAULTS


def is_user() -> Column:
    return F.expr("cast(role = 'user' as bigint)")


def whole() -> WindowSpec:
    return Window.partitionBy("session_id")


def up_to(order: Column) -> WindowSpec:
    return whole().orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


#: A session of more than a share of 1 / OFTEN of all rows is cut into parts; there are at most so many.
OFTEN = 1000


def long_sessions(messages: DataFrame, least: int = 100_000, parts: int = 256) -> DataFrame:
    """(session_id, cuts): the sessions of more than least rows that also have more than a thousandth of all rows, with the
    positions at which they are cut into parts of about the same size. There are at most OFTEN of them, whatever the input's size.

    For turns() and context_window(): they then run over the parts of such a session in as many tasks.
    """
    counts = messages.groupBy("session_id").agg(F.count("*").alias("n"))
    bound = F.greatest(F.lit(least).cast("double"), counts.agg(F.sum("n")).scalar() / OFTEN)
    own = messages.join(F.broadcast(counts.where(F.col("n") > bound).select("session_id")), "session_id", "left_semi")
    return own.groupBy("session_id").agg(F.array_distinct(F.percentile_approx("pos", [i / parts for i in range(1, parts)], 20 * parts)).alias("cuts"))


def _running(messages: DataFrame, value: Column, name: str, newest_first: bool, cuts: DataFrame) -> DataFrame:
    """messages with the running sum of value by pos and its total by session (name, name_total), by a prefix sum in two passes.

    Each part of a long session adds up its own rows; the parts' totals, at most OFTEN sessions times their parts, give what
    comes before each part.
    """
    part = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("pos"))), F.lit(0))
    rows = messages.join(F.broadcast(cuts), "session_id", "left").withColumn("_part", part).withColumn("_value", value)
    order = F.desc if newest_first else F.asc
    own = Window.partitionBy("session_id", "_part")
    totals = rows.where("cuts IS NOT NULL").groupBy("session_id", "_part").agg(F.sum("_value").alias("_sum"))
    others = Window.partitionBy("session_id").orderBy(order("_part"))
    before = F.sum("_sum").over(others.rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("session_id", "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_sum").over(whole()).alias("_total"))
    local = rows.withColumn(name, F.sum("_value").over(own.orderBy(order("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_own", F.sum("_value").over(own))
    out = local.join(F.broadcast(offsets), ["session_id", "_part"], "left")
    return out.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).withColumn(f"{name}_total", F.coalesce("_total", "_own")).select(*messages.columns, name, f"{name}_total")


def turns(messages: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """turn_no: every user row starts a turn; what comes before the first one is turn 0. cuts: from long_sessions()."""
    if cuts is not None:
        return _running(messages, is_user(), "turn_no", False, cuts).drop("turn_no_total")
    return messages.withColumn("turn_no", F.sum(is_user()).over(up_to(F.asc("pos"))))


def turn_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("n_turns"))


def history_page(messages: DataFrame, page: int, size: int) -> DataFrame:
    """The rows of the page's turns, newest turns on page 1, with turn_rank (1: newest). System rows and turn 0 are never shown.

    User rows are the anchors: only the newest page * size of a session are ranked, of which Spark keeps no more before it
    shuffles them. The oldest anchor of the page and the anchor before its newest bound the page; rows outside these
    positions reach no window.
    """
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page is at least 1, size between 1 and 100")
    users = messages.where("role = 'user'").select("session_id", "pos")
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("pos")))
    anchors = users.withColumn("rank", rank).where(F.col("rank") <= page * size)
    inside = F.col("rank") > (page - 1) * size
    bounds = anchors.groupBy("session_id").agg(F.min(F.when(inside, F.col("pos"))).alias("_from"), F.min(F.when(~inside, F.col("pos"))).alias("_before"), F.max("rank").alias("_oldest"))
    counted = bounds.where("_from IS NOT NULL").join(users.groupBy("session_id").agg(F.count("*").alias("_turns")), "session_id")
    shown = messages.where(F.col("role").isin("user", "assistant", "tool"))
    rows = shown.join(counted, "session_id").where((F.col("pos") >= F.col("_from")) & (F.col("_before").isNull() | (F.col("pos") < F.col("_before"))))
    rows = rows.withColumn("turn_no", F.col("_turns") - F.col("_oldest") + F.sum(is_user()).over(up_to(F.asc("pos"))))
    return rows.withColumn("turn_rank", F.col("_turns") - F.col("turn_no") + 1).select(*messages.columns, "turn_no", "turn_rank")


def ui_groups(messages: DataFrame) -> DataFrame:
    """One row for each message shown: a user row by itself, or all rows that answer it."""
    shown = turns(messages.where("role <> 'system'"))
    return shown.groupBy("session_id", "turn_no", (F.col("role") == "user").alias("is_user")).agg(F.count("*").alias("n_parts"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


_PART = "array<struct<kind: string, text: string, state: string, call_id: string, input: string>>"


def _part(kind: Column, text: Column, state: str | None = None, call: Column | None = None, arguments: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(kind.alias("kind"), text.alias("text"), F.lit(state).cast("string").alias("state"), (none if call is None else call).alias("call_id"), (none if arguments is None else arguments).alias("input"))


def ui_messages(messages: DataFrame) -> DataFrame:
    """session_id, turn_no, role, first_pos, parts in order. Needs reasoning_content, tool_calls (id, name, arguments) and tool_call_id.

    A user row is a message of its own. The other rows between two user rows make one message: each assistant row gives a
    step-start part, then reasoning, tool calls and text, where it has them. A tool part is named by its tool; its text is the
    output of the last tool row of the group with that call id, or empty, its input the arguments, {} if they aren't JSON.
    Text and reasoning are in state done, tool parts in state output-available. Groups without an assistant row give no message.
    turn_no is taken from the rows if they have it. With a column id the message has one: the user row's, or that of the last
    assistant row that has one, else an empty string; with a column created_at, that of the group's first row.
    One session's group is sorted in one task.
    """
    spoken = messages.where("role <> 'system'")
    shown = (spoken if "turn_no" in messages.columns else turns(spoken)).withColumn("is_user", F.col("role") == "user")
    none = F.expr(f"cast(array() as {_PART})")

    def text(kind: str, value: str) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.array(_part(F.lit(kind), F.col(value), "done"))).otherwise(none)

    arguments = lambda c: F.when(F.try_parse_json(c).isNotNull(), c).otherwise("{}")
    calls = F.coalesce("tool_calls", F.expr("cast(array() as array<struct<id: string, name: string, arguments: string>>)"))
    tools = F.transform(calls, lambda c: _part(F.concat(F.lit("tool-"), c["name"]), F.lit(None).cast("string"), "output-available", F.coalesce(c["id"], F.lit("")), arguments(c["arguments"])))
    start = F.array(_part(F.lit("step-start"), F.lit(None).cast("string")))
    made = F.when(F.col("role") == "user", text("text", "content")).when(F.col("role") == "assistant", F.concat(start, text("reasoning", "reasoning_content"), tools, text("text", "content")))
    result = F.when((F.col("role") == "tool") & (F.coalesce("tool_call_id", F.lit("")) != ""), F.struct("pos", F.col("tool_call_id").alias("id"), F.coalesce("content", F.lit("")).alias("output")))
    named = []
    if "id" in messages.columns:
        speaker = F.col("role").isin("user", "assistant") & F.col("id").isNotNull()
        named.append(F.coalesce(F.max_by(F.col("id").cast("string"), F.when(speaker, F.col("pos"))), F.lit("")).alias("id"))
    if "created_at" in messages.columns:
        named.append(F.min_by("created_at", "pos").alias("created_at"))
    groups = shown.groupBy("session_id", "turn_no", "is_user").agg(
        F.min("pos").alias("first_pos"), F.array_sort(F.collect_list(F.when(made.isNotNull(), F.struct("pos", made.alias("parts"))))).alias("rows"), F.array_sort(F.collect_list(result)).alias("results"), *named
    )
    output = lambda c: F.coalesce(F.try_element_at(F.filter("results", lambda r: r["id"] == c), F.lit(-1))["output"], F.lit(""))
    parts = F.transform(F.flatten(F.transform("rows", lambda r: r["parts"])), lambda p: F.when(p["kind"].startswith("tool-"), p.withField("text", output(p["call_id"]))).otherwise(p))
    kept = [c for c in ("id", "created_at") if c in groups.columns]
    return groups.where(F.size("rows") > 0).select("session_id", "turn_no", F.when(F.col("is_user"), "user").otherwise("assistant").alias("role"), "first_pos", *kept, parts.alias("parts"))


def context_window(messages: DataFrame, budget: Column | int, low: float = DEFAULTS.low_ratio, high: float = DEFAULTS.high_ratio, cuts: DataFrame | None = None) -> DataFrame:
    """run_tokens from the newest row back; keep while it is within the low mark, else compress; and whether to compress at all.

    cuts: from long_sessions().
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    tokens = F.coalesce("token_count", F.lit(0))
    if cuts is None:
        rows = messages.withColumn("run_tokens", F.sum(tokens).over(up_to(F.desc("pos")))).withColumn("total_tokens", F.sum(tokens).over(whole()))
    else:
        rows = _running(messages, tokens, "run_tokens", True, cuts).withColumnRenamed("run_tokens_total", "total_tokens")
    mark = lambda ratio: (budget * F.lit(ratio)).cast("int")
    return rows.withColumn("bucket", F.when(F.col("run_tokens") <= mark(low), "keep").otherwise("compress")).withColumn("needs_compress", F.col("total_tokens") >= mark(high))


def newest(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """At most n rows for each key, first by order; the planner limits each group before and after the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def hot_list(rows: DataFrame, key: str, order: list[Column], now: Column, length: int = DEFAULTS.hot_list_length, ttl: str = DEFAULTS.hot_list_ttl, time: str = "ts") -> DataFrame:
    """The newest rows of each key, none for keys whose last write is older than the time to live."""
    last = F.max(time).over(Window.partitionBy(key))
    return newest(rows.withColumn("_last", last).where(F.col("_last") >= now - F.expr(ttl)).drop("_last"), key, order, length)


def replace_hot_list(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that come with rows are replaced whole and untrimmed; a key without new rows stays as it is."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def backfill(messages: DataFrame, summaries: DataFrame, n: int = DEFAULTS.backfill_rows, newest_rows: bool = True) -> DataFrame:
    """The oldest or newest n rows after each session's summary (session_id, summary_pos; null: none yet), in their order."""
    after = messages.join(summaries, "session_id", "left").where("summary_pos IS NULL OR pos > summary_pos")
    return newest(after, "session_id", [F.desc("pos") if newest_rows else F.asc("pos")], n)


def transcript(messages: DataFrame) -> DataFrame:
    """session_id, transcript: a line 'role: content' for each row in order; a null content prints None."""
    line = F.concat_ws(": ", F.col("role"), F.coalesce("content", F.lit("None")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
    return messages.groupBy("session_id").agg(F.array_join(lines, "\n").alias("transcript"))


def redacted(messages: DataFrame) -> DataFrame:
    """content is the placeholder where there is one, even an empty one."""
    return messages.withColumn("content", F.coalesce("persisted_output_placeholder", "content"))


def prompt_sections(messages: DataFrame, summaries: DataFrame, facts: DataFrame, system: str, chronological: bool = True) -> DataFrame:
    """Ordered sections of a prompt for each session: system with facts, summary, history by bucket. messages: from context_window()."""
    base = messages.select("session_id").distinct().join(facts.select("session_id", "fact").groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("fact")), "\n").alias("facts")), "session_id", "left")
    head = base.select("session_id", F.lit(1).cast("long").alias("section"), F.lit(0).cast("long").alias("pos"), F.lit("system").alias("role"), F.concat_ws("\n", F.lit(system), "facts").alias("content"))
    summary = summaries.where("coalesce(summary, '') <> ''").select("session_id", F.lit(2).cast("long"), F.lit(0).cast("long"), F.lit("system"), "summary")
    bucket = F.lit(0) if chronological else F.when(F.col("bucket") == "keep", 0).otherwise(1)
    history = messages.select("session_id", (F.lit(3) + bucket).cast("long"), "pos", "role", "content")
    return head.union(summary).union(history)


def full_prompt(sections: DataFrame, skills: DataFrame, frontend: DataFrame, queries: DataFrame) -> DataFrame:
    """prompt_sections() with the skills on offer after the summary, and what the frontend shows and the user's query at the end.

    skills: (session_id, skill_id, description); frontend, queries: (session_id, text). Sections without text are left out.
    """
    line = F.concat(F.lit("- "), F.col("skill_id"), F.lit(": "), F.coalesce("description", F.lit("")))
    offered = skills.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content"))

    def section(rows: DataFrame, number: int, role: str) -> DataFrame:
        return rows.where("coalesce(content, '') <> ''").select("session_id", F.lit(number).cast("long").alias("section"), F.lit(0).cast("long").alias("pos"), F.lit(role).alias("role"), "content")

    later = sections.withColumn("section", F.when(F.col("section") > 2, F.col("section") + 1).otherwise(F.col("section")))
    out = later.unionByName(section(offered, 3, "system"))
    return out.unionByName(section(frontend.withColumnRenamed("text", "content"), 6, "system")).unionByName(section(queries.withColumnRenamed("text", "content"), 7, "user"))


def llm_row() -> Column:
    """A message as JSON for a model: role and content, and tool_calls, tool_call_id and name only where they have a value."""
    keep = lambda c: F.nullif(F.col(c), F.lit(""))
    calls = F.when(F.size("tool_calls") > 0, F.col("tool_calls"))
    return F.to_json(F.struct("role", F.coalesce("content", F.lit("")).alias("content"), calls.alias("tool_calls"), keep("tool_call_id").alias("tool_call_id"), keep("name").alias("name")))


def after_summary(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages newer than their session's summary (id, summary_updated_at); all where there is no summary yet."""
    at = sessions.select(F.col("id").alias("session_id"), "summary_updated_at")
    return messages.join(at, "session_id").where("summary_updated_at IS NULL OR created_at > summary_updated_at").drop("summary_updated_at")


def summary_input(window: DataFrame, summaries: DataFrame) -> DataFrame:
    """(session_id, prompt) of sessions that need compressing: the old summary, if any, and the transcript of what is to be compressed."""
    old = summaries.select("session_id", F.nullif("summary", F.lit("")).alias("summary"))
    due = transcript(window.where("needs_compress AND bucket = 'compress'")).join(old, "session_id", "left")
    return due.select("session_id", F.concat_ws("\n\n", F.concat(F.lit("Summary so far:\n"), "summary"), F.concat(F.lit("New messages:\n"), "transcript")).alias("prompt"))


def summarised(window: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results: (session_id, summary) from a model. The summaries to store, without blank ones, and what stays in those sessions' hot lists."""
    new = results.where("trim(coalesce(summary, '')) <> ''").select("session_id", "summary")
    return new, window.where("bucket = 'keep'").join(new.select("session_id"), "session_id", "left_semi")


def turn_rows(user: DataFrame, steps: DataFrame, answer: DataFrame) -> DataFrame:
    """The rows of a turn in their order: the user's, those of its steps, the answer. All: (session_id, turn, pos, content)."""
    named = [x.withColumn("part", F.lit(i)) for i, x in enumerate((user, steps, answer))]
    order = F.row_number().over(Window.partitionBy("session_id", "turn").orderBy("part", "pos")).cast("long")
    return named[0].unionByName(named[1]).unionByName(named[2]).withColumn("place", order).drop("part")


def added(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a loop appended: the rows of a session behind as many as it had. after: (session_id, pos, …)."""
    had = before.groupBy("session_id").agg(F.count("*").alias("_had"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("pos"))
    return after.withColumn("_place", place).join(had, "session_id", "left").where(F.col("_place") > F.coalesce("_had", F.lit(0))).drop("_place", "_had")


def active_facts(states: Column) -> Column:
    """The values of an array of (value, disabled) that aren't disabled and not empty."""
    return F.transform(F.filter(states, lambda x: ~F.coalesce(x["disabled"], F.lit(False)) & (F.coalesce(x["value"], F.lit("")) != "")), lambda x: x["value"])
