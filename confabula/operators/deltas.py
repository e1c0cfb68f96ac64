"""Streamed deltas: folding chunks into messages, event logs and frames.

Chunks are (message_id, step, seq, reasoning, content) with optional finish_reason and tool fragments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS

MAX_STEPS = DEFAULTS.max_steps


def joined(text: str) -> Column:
    """The non-null texts of a group in order of seq."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct("seq", F.col(text).alias("x"))))), lambda s: s["x"]), "")


def fold(chunks: DataFrame, sep: str = "") -> DataFrame:
    """Reasoning and text of the last step of each message, and how its stream ended; earlier steps are started over."""
    last = chunks.withColumn("_last", F.max("step").over(Window.partitionBy("message_id"))).where("step = _last")
    return last.groupBy("message_id").agg(F.max("step").cast("long").alias("step"), joined("reasoning").alias("reasoning"), joined("content").alias("content"))


def finish_reasons(chunks: DataFrame) -> DataFrame:
    """The last reason given in each step, 'stop' if none was."""
    last = F.max_by(F.col("finish_reason"), F.when(F.col("finish_reason").isNotNull(), F.col("seq")))
    return chunks.groupBy("message_id", "step").agg(F.coalesce(last, F.lit("stop")).alias("finish_reason"))


def lifecycle(chunks: DataFrame) -> DataFrame:
    """The event log: (message_id, step, seq, sub, event, delta).

    In a step the first reasoning opens reasoning; the first text closes reasoning that is open and opens text, which
    stays open; later reasoning opens reasoning again, and then stays open too. At the end open reasoning is closed, then text.
    Empty reasoning or text is none.
    """
    step = Window.partitionBy("message_id", "step")
    before = step.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    has_r, has_t = F.coalesce("reasoning", F.lit("")) != "", F.coalesce("content", F.lit("")) != ""
    rows = chunks.where(has_r | has_t).withColumn("t_open", F.coalesce(F.max(has_t).over(before), F.lit(False)))
    # the first text closes reasoning, so reasoning is open if it came since then, or at all while there is no text
    later = F.coalesce(F.max(has_r & F.col("t_open")).over(before), F.lit(False))
    rows = rows.withColumn("r_open", F.when(F.col("t_open"), later).otherwise(F.coalesce(F.max(has_r).over(before), F.lit(False))))
    none = F.lit(None).cast("string")
    event = lambda sub, name, delta, when: F.when(when, F.struct(F.lit(sub).alias("sub"), F.lit(name).alias("event"), delta.alias("delta")))
    log = F.array_compact(
        F.array(
            event(0, "reasoning-start", none, has_r & ~F.col("r_open")),
            event(1, "reasoning-delta", F.col("reasoning"), has_r),
            event(2, "reasoning-end", none, has_t & ~F.col("t_open") & (F.col("r_open") | has_r)),
            event(3, "text-start", none, has_t & ~F.col("t_open")),
            event(4, "text-delta", F.col("content"), has_t),
        )
    )
    steps = rows.select("message_id", "step", "seq", F.explode(log).alias("e")).select("message_id", "step", "seq", "e.*")
    ends = rows.groupBy("message_id", "step").agg(F.max("seq").alias("seq"), F.max(has_t).alias("text"), F.max(has_r).alias("some"), F.max(has_r & F.col("t_open")).alias("later"))
    close = F.array_compact(F.array(event(5, "reasoning-end", none, F.when(F.col("text"), F.col("later")).otherwise(F.col("some"))), event(6, "text-end", none, F.col("text"))))
    return steps.union(ends.select("message_id", "step", "seq", F.explode(close).alias("e")).select("message_id", "step", "seq", "e.*"))


def unbalanced(log: DataFrame) -> DataFrame:
    """Steps whose starts and ends of a kind differ in number."""
    ends = lambda kind: F.count_if(F.col("event") == f"{kind}-start") - F.count_if(F.col("event") == f"{kind}-end")
    return log.groupBy("message_id", "step").agg(ends("reasoning").alias("reasoning"), ends("text").alias("text")).where("reasoning <> 0 OR text <> 0")


EVENTS = ("start-step", "reasoning-start", "reasoning-delta", "reasoning-end", "text-start", "text-delta", "text-end", "tool-input-start", "tool-input-available", "tool-output-available", "finish-step")


def step_log(log: DataFrame, steps: DataFrame, calls: DataFrame) -> DataFrame:
    """The whole event log of messages: each step begins with start-step, then come its deltas, the two input events of every
    tool call, the outputs in the order of the calls, and finish-step.

    log: from lifecycle(); steps: (message_id, step); calls: (message_id, step, index, call_id, tool, input, output), input JSON.
    """
    none, far = F.lit(None).cast("string"), 1 << 40
    empty = {c: none.alias(c) for c in ("delta", "call_id", "tool", "input", "output")}

    def rows(df: DataFrame, seq: Column, sub: int, event: str, *filled: str) -> DataFrame:
        return df.select("message_id", "step", seq.cast("long").alias("seq"), F.lit(sub).alias("sub"), F.lit(event).alias("event"), *[F.col(c) if c in filled else x for c, x in empty.items()])

    at = F.col("index").cast("long")
    out = rows(steps, F.lit(-1), 0, "start-step").unionByName(rows(steps, F.lit(4 * far), 0, "finish-step"))
    out = out.unionByName(log.select("message_id", "step", "seq", "sub", "event", "delta", *[x for c, x in empty.items() if c != "delta"]))
    out = out.unionByName(rows(calls, at + far, 0, "tool-input-start", "call_id", "tool")).unionByName(rows(calls, at + far, 1, "tool-input-available", "call_id", "tool", "input"))
    return out.unionByName(rows(calls, at + 2 * far, 0, "tool-output-available", "call_id", "output"))


def frames(log: DataFrame, ends: DataFrame) -> DataFrame:
    """Each event as a 'data: <json>' line between the envelope's lines, ordered by (message_id, n); an unknown event is an error.

    log: from step_log(); ends: (message_id, status, error), one row a message, with or without events. status: finished;
    aborted (the user cancelled); failed (error is the reason); refused (a business error in mid-stream: the text goes out as
    a raw line, and the envelope finishes).
    """
    kind = F.col("event")
    id_of = F.when(kind.startswith("text-") | kind.startswith("reasoning-"), F.concat(F.substring("event", 1, 1), F.lit("_"), F.col("step").cast("string")))
    tool = F.when(kind.startswith("tool-input"), F.col("tool"))
    body = F.to_json(F.struct(kind.alias("type"), id_of.alias("id"), "delta", F.col("call_id").alias("toolCallId"), tool.alias("toolName"), F.try_parse_json("input").alias("input"), "output"))
    line = F.when(kind.isin(*EVENTS), F.concat(F.lit("data: "), body, F.lit("\n\n"))).otherwise(F.raise_error(F.concat(F.lit("unknown event "), "event")).cast("string"))
    data = lambda *c: F.concat(F.lit("data: "), F.to_json(F.struct(*c)), F.lit("\n\n"))
    closing = (
        F.when(F.col("status") == "aborted", data(F.lit("abort").alias("type"), F.lit("user_cancelled").alias("reason")))
        .when(F.col("status") == "failed", data(F.lit("error").alias("type"), F.coalesce("error", F.lit("")).alias("errorText")))
        .otherwise(data(F.lit("finish").alias("type")))
    )
    head = data(F.lit("start").alias("type"), F.concat(F.lit("msg_"), F.col("message_id").cast("string")).alias("messageId"))
    raw = F.when(F.col("status") == "refused", F.concat(F.lit("\n[System Error]: "), F.coalesce("error", F.lit(""))))
    # the end of a message is a row behind its events, whose number is then one more than theirs
    rows = log.withColumn("_end", F.lit(False)).unionByName(ends.select("message_id", "status", "error", F.lit(True).alias("_end")), allowMissingColumns=True)
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy("message_id").orderBy("_end", "step", "seq", "sub")).cast("long"))
    one = lambda n, frame: F.struct(n.cast("long").alias("n"), frame.alias("frame"))
    at = F.col("_n")
    around = F.filter(F.array(one(F.lit(0), head), one(at, raw), one(at + 1, closing), one(at + 2, F.lit("data: [DONE]\n\n"))), lambda x: x["frame"].isNotNull())
    return numbered.select("message_id", F.explode(F.when(F.col("_end"), around).otherwise(F.array(one(at, line)))).alias("x")).select("message_id", "x.n", "x.frame")


def exhausted(steps: DataFrame, most: int = MAX_STEPS) -> DataFrame:
    """steps: (message_id, step, finish_reason, n_tool_calls). Messages that still asked for tools at the last step allowed."""
    return steps.where((F.col("step") == most) & (F.col("finish_reason") == "tool_calls") & (F.col("n_tool_calls") > 0)).select("message_id")
