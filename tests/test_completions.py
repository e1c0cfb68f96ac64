"""The messages that a loop of steps appends, and the frames of its warning."""

from __future__ import annotations

from confabula.operators import deltas
from confabula.operators.completions import loop_messages, with_warnings

CHUNKS = "message_id long, step int, seq long, reasoning string, content string, finish_reason string"
CALLS = "message_id long, step int, index int, call_id string, tool string, input string, output string"


def test_a_loop_with_a_tool_and_an_answer(spark):
    chunks = spark.createDataFrame([(1, 1, 2, None, "lo", None), (1, 1, 1, "why", "hel", "length"), (1, 1, 3, None, None, "tool_calls"), (1, 2, 1, None, "done", None), (1, 3, 1, None, "never", "stop")], CHUNKS)
    calls = spark.createDataFrame([(1, 1, 1, "b", "load", "oops", "B"), (1, 1, 0, "a", "find", '{"q": 1}', "A"), (1, 2, 0, "c", "find", "{}", "unused")], CALLS)
    got = [tuple(r) for r in loop_messages(with_warnings(chunks, calls), calls).orderBy("message_id", "step", "place").collect()]
    assert got == [
        (1, 1, 0, "assistant", "hello", "why", [("a", "find", '{"q": 1}'), ("b", "load", "{}")], None, None, None),
        (1, 1, 1, "tool", "A", None, None, "a", "find", None),
        (1, 1, 2, "tool", "B", None, None, "b", "load", None),
        (1, 2, 0, "assistant", "done", None, None, None, None, None),
    ]


def test_reason_without_calls_and_calls_without_reason_end_the_loop(spark):
    chunks = spark.createDataFrame([(1, 1, 1, None, "x", "tool_calls"), (2, 1, 1, None, None, "stop")], CHUNKS)
    calls = spark.createDataFrame([(2, 1, 0, "a", "find", "{}", "A")], CALLS)
    got = loop_messages(with_warnings(chunks, calls), calls).orderBy("message_id").collect()
    assert [(r.message_id, r.role, r.content, r.tool_calls) for r in got] == [(1, "assistant", "x", None), (2, "assistant", "", None)]


def test_the_limit_gives_a_step_of_its_own_in_messages_and_frames(spark):
    chunks = spark.createDataFrame([(1, s, 1, None, f"t{s}", "tool_calls") for s in (1, 2, 3)] + [(2, 1, 1, None, "x", "tool_calls")], CHUNKS)
    calls = spark.createDataFrame([(1, s, 0, f"c{s}", "find", "{}", "A") for s in (1, 2, 3)] + [(2, 1, 0, "d", "find", "{}", "A")], CALLS)
    warned = with_warnings(chunks, calls, 2, "only {}")
    got = [(r.message_id, r.step, r.role, r.content) for r in loop_messages(warned, calls).orderBy("message_id", "step", "place").collect()]
    assert got == [(1, 1, "assistant", "t1"), (1, 1, "tool", "A"), (1, 2, "assistant", "t2"), (1, 2, "tool", "A"), (1, 3, "assistant", "only 2"), (2, 1, "assistant", "x"), (2, 1, "tool", "A")]
    log = deltas.step_log(deltas.lifecycle(warned), warned.select("message_id", "step").distinct(), calls.where("step <= 2"))
    last = [r.event for r in log.where("message_id = 1 AND step = 3").orderBy("seq", "sub").collect()]
    assert last == ["start-step", "text-start", "text-delta", "text-end", "finish-step"]


def test_no_rows_give_no_messages(spark):
    chunks, calls = spark.createDataFrame([], CHUNKS), spark.createDataFrame([], CALLS)
    assert loop_messages(with_warnings(chunks, calls), calls).count() == 0
