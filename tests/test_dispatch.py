"""Tools run on the executors: time limits, declared and other errors, order."""

from __future__ import annotations

import time

import pytest

from confabula.functions.registry import Definition, Registry, ToolError
from confabula.operators.dispatch import broken_rule, dispatch

CALLS = "message_id long, index int, id string, name string, arguments string, context map<string,string>"


def scope():
    own = Registry()

    def slow(context, seconds):
        time.sleep(seconds)
        return "slept"

    def failing(context):
        raise ToolError("NO_LUCK", "today", True)

    number = {"type": "object", "properties": {"seconds": {"type": "number"}}, "required": ["seconds"]}
    own.register(Definition("slow", slow, "string", number, timeout_seconds=0.6))
    own.register(Definition("failing", failing, "string"))
    own.register(Definition("good", lambda context, **more: {"user": context["user"], **more}, "string", required_context=("user",), persist=False))
    own.register(Definition("broken", lambda context: 1 // 0, "string"))
    return own


def rows(*calls):
    return [(1, i, f"c{i}", name, arguments, context) for i, (name, arguments, context) in enumerate(calls)]


def test_slow_failing_and_good_tools_in_one_batch(spark):
    u = {"user": "é"}
    calls = rows(("slow", '{"seconds": 20}', u), ("failing", "{}", u), ("good", '{"a": 1}', u), ("slow", '{"seconds": 0}', u), ("none", "{}", u), ("good", "{}", {}), ("good", "[]", u), ("slow", "{}", None), ("slow", '{"seconds": 30}', u), ("good", "{}", u))
    began = time.monotonic()
    got = dispatch(spark.createDataFrame(calls, CALLS).coalesce(1), scope(), 2).collect()
    assert time.monotonic() - began < 15
    assert [r["index"] for r in got] == list(range(10))
    assert [(r.output, r.error, r.detail) for r in got] == [
        (None, "Timeout", "slow"), (None, "NO_LUCK", "today"), ('{"user": "é", "a": 1}', None, None), ("slept", None, None), (None, "Tool unavailable", "none"), (None, "Tool preflight failed", "CONTEXT:user"),
        (None, "Tool preflight failed", "NOT_AN_OBJECT"), (None, "Tool preflight failed", "MISSING:seconds"), (None, "Timeout", "slow"), ('{"user": "é"}', None, None),
    ]
    assert [r.retryable for r in got][:3] == [False, True, None] and got[2].placeholder and got[3].placeholder is None
    assert 0.5 < (got[0].finished_at - got[0].started_at).total_seconds() < 5


def test_an_undeclared_error_aborts(spark):
    with pytest.raises(Exception, match="ZeroDivisionError"):
        dispatch(spark.createDataFrame(rows(("broken", "{}", {})), CALLS), scope()).collect()


@pytest.mark.parametrize(("arguments", "rule"), [({"a": True}, "TYPE:a"), ({"a": 1.5}, "TYPE:a"), ({"a": 1, "z": 0}, "UNKNOWN_ARGUMENT"), ({}, "MISSING:a"), ({"a": 2, "b": "x"}, None), ("a", "NOT_AN_OBJECT")])
def test_parameter_schema(arguments, rule):
    assert broken_rule(arguments, {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "odd"}}, "required": ["a"], "additionalProperties": False}) == rule
