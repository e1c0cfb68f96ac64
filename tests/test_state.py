"""Flows with keyed state over several files: restarts, repeated and late rows, batches run again, state that is dropped."""

from __future__ import annotations

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from confabula.operators import deltas, messages
from confabula.streaming import flows, state

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def chunk(message, step, seq, reasoning=None, content=None, finish=None, calls=None, minute=None):
    return (message, step, seq, START + dt.timedelta(minutes=seq if minute is None else minute), reasoning, content, finish, calls)


def put(spark, path, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in{number:03}")


def conversation(seed, n_messages=7):
    rng, out = random.Random(seed), []
    for m in range(n_messages):
        for step in range(1, rng.randint(1, 3) + 1):
            n = rng.randint(1, 9)
            for seq in range(n):
                last = seq == n - 1
                out.append(chunk(m, step, seq, rng.choice([None, "", "r" + str(seq)]), rng.choice([None, "", "t" + str(seq)]), "stop" if last else None, minute=1))
    rng.shuffle(out)
    return sorted(out, key=lambda r: r[2])  # steps of all messages in turn, each in order


def run(spark, source, path):
    stream = flows.file_stream(spark, f"file://{source}", "*.parquet", state.CHUNKS, 1)
    query = state.start(state.interpreted(stream), path)
    query.awaitTermination()
    return query


def log(spark, path):
    return sorted(map(tuple, spark.read.schema(state.LOG).parquet(path).collect()), key=str)


def test_log_is_that_of_the_batch_operator_over_files_split_anywhere(spark, tmp_path):
    rows, source, path = conversation(3), f"{tmp_path}/source", f"file://{tmp_path}/log"
    want = deltas.lifecycle(spark.createDataFrame(rows, state.CHUNKS)).select("message_id", "step", "seq", "sub", "event", "delta")
    cuts = sorted(random.Random(1).sample(range(1, len(rows)), 3))
    for number, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        put(spark, source, number, rows[a:b] + (rows[a - 3 : a] if number == 2 else []), state.CHUNKS)  # some come again
        if number == 1:
            run(spark, source, path)  # later files go to a query that is started anew
    run(spark, source, path)
    assert log(spark, path) == sorted(map(tuple, want.collect()), key=str)


def test_calls_are_joined_over_files_and_silent_messages_are_ended(spark, tmp_path):
    source, path = f"{tmp_path}/source", f"file://{tmp_path}/log"
    put(spark, source, 0, [chunk(1, 1, 0, "r"), chunk(2, 1, 0, None, "t"), chunk(1, 1, 1, calls=[(1, "b", "find", None), (0, "a", "lo", "{\"k\"")])], state.CHUNKS)
    put(spark, source, 1, [chunk(1, 1, 2, calls=[(0, None, "ad", ": 1}")], finish="tool_calls")], state.CHUNKS)
    run(spark, source, path)
    calls = [json.loads(r[5]) for r in log(spark, path) if r[4] == "tool-input-available"]
    assert calls == [{"index": 0, "id": "a", "name": "load", "arguments": '{"k": 1}'}, {"index": 1, "id": "b", "name": "find", "arguments": ""}]
    assert [r[4] for r in log(spark, path) if r[0] == 2] == ["text-start", "text-delta"]
    put(spark, source, 2, [chunk(3, 1, 0, None, "x", minute=60)], state.CHUNKS)  # an hour later
    put(spark, source, 3, [chunk(3, 1, 1, None, "y", minute=61)], state.CHUNKS)
    query = run(spark, source, path)
    assert [r[4] for r in log(spark, path) if r[0] == 2] == ["text-start", "text-delta", "text-end"]
    with state.keyed_state(spark):
        left = spark.read.format("statestore").option("stateVarName", "steps").load(path + "-progress")
    assert {r.m for r in left.select(F.col("key.message_id").alias("m")).collect()} == {3}
    assert query.exception() is None


EVENTS = "event_id long, ts timestamp, user_id long"


def test_rolling_lists_touch_only_the_users_of_a_batch_and_expire(spark, tmp_path):
    rng, source, path = random.Random(2), f"{tmp_path}/source", f"file://{tmp_path}/hot"
    batches = [[(i, START + dt.timedelta(minutes=rng.randrange(300)), i % 40) for i in range(400)]]
    batches.append([(1000 + u, START + dt.timedelta(hours=20), u) for u in range(10)])
    batches.append([(2000, START + dt.timedelta(hours=40), 3)])
    seen = []
    for number, rows in enumerate(batches):
        put(spark, source, number, rows, EVENTS)
        stream = flows.file_stream(spark, f"file://{source}", "*.parquet", EVENTS, 1)
        query = state.start(state.rolling(stream, 6), path, "update", lambda batch, _: seen.append(sorted((r.user_id, r.dropped) for r in batch.collect())))
        query.awaitTermination()
        every = spark.createDataFrame([r for b in batches[: number + 1] for r in b], EVENTS)
        now = max(r[1] for b in batches[: number + 1] for r in b)
        want = messages.hot_list(every, "user_id", [F.desc("ts"), F.desc("event_id")], F.lit(now), 6).select("user_id", "event_id", "rank")
        got = state.rolling_lists(spark, path + "-progress").select("user_id", "event_id", "rank")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), number
    assert [(u, False) for u in range(10)] in seen  # ten rows of ten users
    assert any(all(dropped for _, dropped in x) and len(x) == 30 for x in seen)


def test_a_batch_that_runs_twice_counts_once(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    own = state.Ledger(spark, path)
    own.create(spark.createDataFrame([(1, None, 10, 0), (2, "u", 0, 0)], state.Ledger.INCREMENTS))
    schema = "provider_id long, owner_user_id string, usage_tokens long, billable_tokens long"
    batches = [[(1, None, 5, 5), (9, None, 3, 0)], [(1, None, 1, 0), (2, "u", 2, 0), (2, None, 7, 7)], [(2, "u", 4, 0)]]
    for number, rows in enumerate(batches):
        for _ in range(2):
            own.step(spark.createDataFrame(rows, schema), number)
        if number == 1:
            own.compact(1)
            own.step(spark.createDataFrame(rows, schema), 1)  # again, when it is in the base already
    assert sorted(map(tuple, own.counters().collect())) == [(1, None, 16, 5), (2, "u", 6, 0)]
    assert sorted((r.provider_id, r.usage_tokens, r.error) for r in own.refused().collect()) == [(2, 7, "PROVIDER_NOT_FOUND"), (9, 3, "PROVIDER_NOT_FOUND")]


def test_hours_are_written_once_when_they_are_closed_and_late_rows_left_out(spark, tmp_path):
    source, path = f"{tmp_path}/source", f"file://{tmp_path}/hours"

    def hours(*rows):
        number = len(list((tmp_path / "source").glob("*"))) if (tmp_path / "source").exists() else 0
        put(spark, source, number, [(i, START + dt.timedelta(hours=h), 1, "view", 1.0, "{}") for i, h in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
        stream = flows.file_stream(spark, f"file://{source}", "*.parquet", "event_id long, ts timestamp, user_id long, event_type string, value double, props string", 1)
        flows.start(flows.usage_by_hour(stream.withWatermark("ts", "1 hour")), "append", path).awaitTermination()
        return sorted((r.hour.hour, r.n_events) for r in spark.read.parquet(path).collect())

    assert hours((1, 0.1), (2, 0.2), (3, 1.5)) == []
    assert hours((4, 0.6), (5, 3.2)) == [(0, 3), (1, 1)]  # 4 is late, but its hour is open
    assert hours((6, 0.9), (7, 6.5)) == [(0, 3), (1, 1), (3, 1)]  # 6 is later than allowed


def test_updated_results_are_merged_by_key(spark, tmp_path):
    source, path = f"{tmp_path}/source", f"file://{tmp_path}/users"
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    for number in range(2):
        put(spark, source, number, [(i, START, (i % 10) + 5 * number, "view", 2.0, "{}") for i in range(20)], schema)
        flow = flows.usage_by_user(flows.file_stream(spark, f"file://{source}", "*.parquet", schema, 1))
        flows.start(flow, "update", path, keys=["user_id"]).awaitTermination()
    got = flows.KeyedTable(spark, path, flows.columns(flow), ["user_id"]).read()
    assert sorted(map(tuple, got.collect())) == [(u, 4 if 5 <= u < 10 else 2, 8 if 5 <= u < 10 else 4) for u in range(15)]
