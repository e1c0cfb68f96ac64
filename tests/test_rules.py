"""Rules of the chat domain on hand-made rows."""

from __future__ import annotations

from collections import Counter

from confabula.functions.registry import Definition, Registry
from confabula.operators import deltas, memory, skills, tools, usage


def visible(shown: bool, name: str, expose, allow, deny) -> bool:
    if not shown:
        return name in expose
    return (allow is None or name in allow) and name not in deny


CASES = [(set(), None, set()), ({"load"}, set(), {"load"}), ({"draw"}, {"search"}, set()), ({"draw"}, None, {"draw"}), (set(), {"load", "draw"}, {"search"}), ({"late"}, None, {"early"})]
TOOLS = [("search", True), ("load", False), ("draw", True), ("early", False)]
EXTRA = [("late", False), ("early", True)]


def test_which_tools_a_scope_sees(spark):
    rows = [(i, sorted(e), None if a is None else sorted(a), sorted(d)) for i, (e, a, d) in enumerate(CASES)]
    scopes = spark.createDataFrame(rows, "scope_id long, expose array<string>, allow array<string>, deny array<string>")
    schema = "tool string, default_visible boolean"
    got = skills.visible_tools(spark.createDataFrame(TOOLS, schema), scopes, spark.createDataFrame(EXTRA, schema))
    known = dict(TOOLS) | dict(EXTRA)
    want = sorted((i, t) for i, (e, a, d) in enumerate(CASES) for t, shown in known.items() if visible(shown, t, e, a, d))
    assert sorted((r.scope_id, r.tool) for r in got.collect()) == want
    own = Registry()
    for name, shown in TOOLS:
        own.register(Definition(name, str, "string", visible=shown))
    for i, (e, a, d) in enumerate(CASES):
        scope = own.derive(e, a, d, [Definition(n, str, "string", visible=v) for n, v in EXTRA])
        assert sorted(t for t in known if scope.get(t)) == [t for k, t in want if k == i]


def test_amounts_of_unknown_providers_and_foreign_owners_are_refused(spark):
    counters = spark.createDataFrame([(1, None, 5, 5), (2, "u", 0, 0)], "provider_id long, owner_user_id string, usage_tokens long, billable_usage_tokens long")
    rows = [(1, None, 3, 1), (1, None, -4, 2), (1, "u", 7, 0), (2, "u", 1, 0), (9, None, 1, 1), (2, "u", 0, 0)]
    delta = usage.ledger(spark.createDataFrame(rows, "provider_id long, owner_user_id string, usage_tokens long, billable_tokens long"), ["provider_id", "owner_user_id"])
    added, refused = usage.add_to_ledger(counters, delta)
    assert sorted(map(tuple, added.collect())) == [(1, None, 8, 8), (2, "u", 1, 0)]
    assert sorted((r.provider_id, r.owner_user_id, r.usage_tokens, r.error) for r in refused.collect()) == [(1, "u", 7, "PROVIDER_NOT_FOUND"), (9, None, 1, "PROVIDER_NOT_FOUND")]


def test_instances_are_picked_in_proportion_to_their_weights(spark):
    weights = {"a": 1.0, "b": 3.0, "c": 0.0, "d": -2.0, "e": 4.0}
    pool = spark.range(8000).selectExpr("id AS request_id").crossJoin(spark.createDataFrame(list(weights.items()), "instance string, weight double"))
    n = Counter(r.instance for r in tools.weighted_pick(pool, 3).collect())
    assert set(n) == {"a", "b", "e"}
    for name, share in (("a", 1 / 8), ("b", 3 / 8), ("e", 4 / 8)):
        assert abs(n[name] / 8000 - share) < 0.025
    none = tools.weighted_pick(pool.withColumn("weight", pool["weight"] * 0), 3)
    assert all(abs(x / 8000 - 0.2) < 0.025 for x in Counter(r.instance for r in none.collect()).values())


def test_memories_of_no_user_stay(spark):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id long, user_id string")
    from pyspark.sql import functions as F

    assert [r.id for r in memory.forget_user(rows, F.lit("a")).orderBy("id").collect()] == [1, 3]


def test_no_context_at_all_is_missing_context(spark):
    calls = spark.createDataFrame([(1, 0, "i", "t", None), (1, 1, "j", "t", ["user"])], "message_id long, index int, id string, name string, context array<string>")
    known = spark.createDataFrame([("t", ["user"], True, 5)], "name string, required_context array<string>, persist boolean, timeout_seconds int")
    outputs = spark.createDataFrame([("i", "x", None, 1), ("j", "y", None, 1)], "id string, output string, error string, seconds int")
    got = {r.id: (r.output, r.error) for r in tools.run_results(calls, known, outputs).collect()}
    assert got == {"i": (None, "Missing context"), "j": ("y", None)}


def told(chunks):
    """The event log of one step, chunk by chunk: (seq, event, delta)."""
    reasoning = text = False
    out = []
    for seq, r, t in chunks:
        if r:
            if not reasoning:
                out.append((seq, "reasoning-start", None))
            reasoning = True
            out.append((seq, "reasoning-delta", r))
        if t:
            if not text:
                if reasoning:
                    out.append((seq, "reasoning-end", None))
                    reasoning = False
                out.append((seq, "text-start", None))
            text = True
            out.append((seq, "text-delta", t))
    last = max((seq for seq, r, t in chunks if r or t), default=None)
    return out + [(last, f"{kind}-end", None) for kind, is_open in (("reasoning", reasoning), ("text", text)) if is_open]


STEPS = [
    [(0, "a", None), (1, None, "b"), (2, "c", None), (3, None, "d"), (4, "e", "f")],
    [(0, "a", "b"), (1, "", "c"), (2, None, "")],
    [(0, None, None), (1, "a", ""), (2, "b", None)],
    [(0, None, "x"), (1, "y", None)],
    [(0, "", None)],
    [(0, "a", None), (1, "b", "c"), (2, None, "d"), (3, None, None)],
]


def test_events_of_a_step_follow_the_rule(spark):
    rows = [(1, k, *c) for k, chunks in enumerate(STEPS) for c in chunks]
    log = deltas.lifecycle(spark.createDataFrame(rows, "message_id long, step int, seq long, reasoning string, content string"))
    for k, chunks in enumerate(STEPS):
        got = [(r.seq, r.event, r.delta) for r in log.where(f"step = {k}").orderBy("seq", "sub").collect()]
        assert got == told(chunks), k


def test_no_events_are_unbalanced(spark):
    rows = [(1, k, *c) for k, chunks in enumerate(STEPS) for c in chunks]
    assert deltas.unbalanced(deltas.lifecycle(spark.createDataFrame(rows, "message_id long, step int, seq long, reasoning string, content string"))).count() == 0


def test_frames_of_messages_with_and_without_events(spark):
    empty = "cast(null as string)"
    log = spark.sql(f"SELECT * FROM VALUES (1L, 1, 5L, 0, 'text-start', {empty}), (1L, 1, 5L, 1, 'text-delta', 'hi'), (1L, 2, 0L, 0, 'start-step', {empty}), (3L, 1, 0L, 0, 'start-step', {empty}) AS t(message_id, step, seq, sub, event, delta)")
    log = log.selectExpr("*", *[f"{empty} AS {c}" for c in ("call_id", "tool", "input", "output")])
    ends = spark.createDataFrame([(1, "refused", "no money"), (2, "failed", None)], "message_id long, status string, error string")
    got = {}
    for r in deltas.frames(log, ends).orderBy("message_id", "n").collect():
        got.setdefault(r.message_id, []).append((r.n, r.frame))
    data = lambda x: f"data: {x}\n\n"
    assert got[1] == [
        (0, data('{"type":"start","messageId":"msg_1"}')), (1, data('{"type":"text-start","id":"t_1"}')), (2, data('{"type":"text-delta","id":"t_1","delta":"hi"}')), (3, data('{"type":"start-step"}')),
        (4, "\n[System Error]: no money"), (5, data('{"type":"finish"}')), (6, data("[DONE]")),
    ]
    assert got[2] == [(0, data('{"type":"start","messageId":"msg_2"}')), (2, data('{"type":"error","errorText":""}')), (3, data("[DONE]"))]
    assert got[3] == [(1, data('{"type":"start-step"}'))]
