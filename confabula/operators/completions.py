"""What a loop of model steps and tool calls leaves behind: the messages it appends to the session, and its warning at the limit.

chunks: (message_id, step, seq, reasoning, content, finish_reason), steps from 1; calls: (message_id, step, index, call_id, tool,
input, output) with an optional placeholder, input JSON. A step goes on to the next one if its last finish reason is tool_calls
and it has calls; the first step that doesn't gives the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .deltas import MAX_STEPS, exhausted, finish_reasons, joined

WARNING = "No answer after {} steps."
_CALLS = "array<struct<id: string, name: string, arguments: string>>"


def with_warnings(chunks: DataFrame, calls: DataFrame, most: int = MAX_STEPS, warning: str = WARNING) -> DataFrame:
    """chunks of the steps allowed; a message that asks for tools at the last of them gets one step more, whose text is the warning."""
    n = calls.groupBy("message_id", "step").agg(F.count("*").alias("n_tool_calls"))
    steps = finish_reasons(chunks.where(F.col("step") == most)).join(n, ["message_id", "step"], "left")
    late = exhausted(steps, most).select("message_id", F.lit(most + 1).cast("int").alias("step"), F.lit(0).cast("long").alias("seq"), F.lit(warning.format(most)).alias("content"))
    own = chunks.where(F.col("step") <= most).select("message_id", "step", "seq", "reasoning", "content", "finish_reason")
    return own.unionByName(late, allowMissingColumns=True)


def loop_messages(chunks: DataFrame, calls: DataFrame) -> DataFrame:
    """(message_id, step, place, role, content, reasoning_content, tool_calls, tool_call_id, name, placeholder), in order of step and place.

    chunks: from with_warnings(). A step that goes on gives an assistant row with its calls (arguments that aren't a JSON object
    are {}), then a tool row for each call by index. The step that ends the loop gives the answer, of its own text and reasoning
    only; steps behind it don't count. Empty text and reasoning are null beside calls; an answer without text is empty.
    """
    none = lambda kind="string": F.lit(None).cast(kind)
    placeholder = F.col("placeholder") if "placeholder" in calls.columns else none()
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("input")).startswith("OBJECT"), F.lit(False))
    call = F.struct("index", F.col("call_id").alias("id"), F.col("tool").alias("name"), F.when(is_object, F.col("input")).otherwise("{}").alias("arguments"), "output", placeholder.alias("placeholder"))
    by_step = calls.groupBy("message_id", "step").agg(F.array_sort(F.collect_list(call)).alias("calls"))
    reason = F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("seq")))
    steps = chunks.groupBy("message_id", "step").agg(joined("content").alias("content"), joined("reasoning").alias("reasoning"), reason.alias("reason")).join(by_step, ["message_id", "step"], "left")
    goes_on = (F.coalesce("reason", F.lit("stop")) == "tool_calls") & F.col("calls").isNotNull()
    last = F.min(F.when(~F.col("_on"), F.col("step"))).over(Window.partitionBy("message_id"))
    kept = steps.withColumn("_on", goes_on).withColumn("_last", last).where(F.col("_last").isNull() | (F.col("step") <= F.col("_last")))

    def row(place: Column, role: str, content: Column, reasoning: Column | None = None, made: Column | None = None, to: Column | None = None, name: Column | None = None, kept_as: Column | None = None) -> Column:
        values = {"place": place.cast("long"), "role": F.lit(role), "content": content, "reasoning_content": reasoning, "tool_calls": made, "tool_call_id": to, "name": name, "placeholder": kept_as}
        return F.struct(*[(none(_CALLS if k == "tool_calls" else "string") if v is None else v).alias(k) for k, v in values.items()])

    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    asked = row(F.lit(0), "assistant", filled("content"), filled("reasoning"), F.transform("calls", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), c["arguments"].alias("arguments"))))
    answered = F.transform("calls", lambda c, i: row(i + 1, "tool", c["output"], None, None, c["id"], c["name"], c["placeholder"]))
    rows = F.when(F.col("_on"), F.concat(F.array(asked), answered)).otherwise(F.array(row(F.lit(0), "assistant", F.col("content"), filled("reasoning"))))
    return kept.select("message_id", "step", F.explode(rows).alias("r")).select("message_id", "step", "r.*")
