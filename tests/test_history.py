"""A page of a session's history as its owner sees it."""

from __future__ import annotations

import datetime

import pytest

from confabula.operators.history import history
from confabula.operators.messages import ui_messages

AT = datetime.datetime(2024, 1, 1, 12)
SCHEMA = "session_id long, pos long, id string, role string, content string, reasoning_content string, tool_calls array<struct<id: string, name: string, arguments: string>>, tool_call_id string, created_at timestamp_ntz"


def row(session, pos, role, content=None, id="", calls=None, call=None, reasoning=None):
    return (session, pos, id or None, role, content, reasoning, calls, call, AT + datetime.timedelta(minutes=pos))


ROWS = [
    row(1, 0, "assistant", "before any turn", "m0"),
    row(1, 1, "user", "one", "m1"),
    row(1, 2, "assistant", "", "m2", [("c", "find", '{"q": 1}'), ("d", "find", "{")]),
    row(1, 3, "tool", "found", "m3", call="c"),
    row(1, 4, "assistant", "done", None, reasoning="why"),
    row(1, 5, "user", "", "m5"),
    row(1, 6, "tool", "no assistant here", "m6"),
    row(2, 1, "system", "rules", "s1"),
    row(3, 1, "user", "not yours", "x1"),
]


@pytest.fixture(scope="module")
def tables(spark):
    sessions = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, user_id string")
    return spark.createDataFrame(ROWS, SCHEMA), sessions


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "request_id long, session_id long, user_id string")


def test_parts_with_their_states_ids_and_times(spark, tables):
    got = history(*tables, asked(spark, (1, 1, "a")), 2, 1).orderBy("first_pos").collect()
    assert [(r.outcome, r.total, r.total_page, r.role, r.id, r.created_at) for r in got] == [("OK", 2, 2, "user", "m1", "2024-01-01T12:01:00"), ("OK", 2, 2, "assistant", "m2", "2024-01-01T12:02:00")]
    assert [tuple(p) for p in got[0].parts] == [("text", "one", "done", None, None)]
    assert [tuple(p) for p in got[1].parts] == [
        ("step-start", None, None, None, None), ("tool-find", "found", "output-available", "c", '{"q": 1}'), ("tool-find", "", "output-available", "d", "{}"),
        ("step-start", None, None, None, None), ("reasoning", "why", "done", None, None), ("text", "done", "done", None, None),
    ]


def test_an_empty_question_is_shown_and_a_group_without_an_answer_is_not(spark, tables):
    got = history(*tables, asked(spark, (1, 1, "a")), 1, 1).collect()
    assert [(r.id, r.role, r.parts) for r in got] == [("m5", "user", [])]


def test_every_request_has_an_answer(spark, tables):
    got = history(*tables, asked(spark, (1, 2, "a"), (2, 3, "a"), (3, 9, "a"), (4, 1, None), (5, 1, "a"), (6, 1, "a")), 7, 2).orderBy("request_id").collect()
    none = "SESSION_NOT_FOUND"
    assert [(r.request_id, r.session_id, r.outcome, r.total, r.total_page, r.parts) for r in got] == [(1, 2, "OK", 0, 0, None), (2, 3, none, None, None, None), (3, 9, none, None, None, None), (4, 1, none, None, None, None), (5, 1, "OK", 2, 1, None), (6, 1, "OK", 2, 1, None)]


def test_ids_and_times_are_optional(spark, tables):
    got = ui_messages(tables[0].drop("id", "created_at"))
    assert got.columns == ["session_id", "turn_no", "role", "first_pos", "parts"] and got.count() == 5
