"""Flows over several files: late rows, eviction, batches run again, restarts, ordered steps, refreshed dimensions."""

from __future__ import annotations

import datetime as dt

import pytest

from confabula.streaming import flows

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
START = dt.datetime(2024, 1, 1)


def event(i, hours, user):
    return (i, START + dt.timedelta(hours=hours), user, "view", float(i), "{}")


def put(spark, path, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in{number}/events.parquet")


def expected(batches, length, ttl):
    """What the hot lists hold after every batch."""
    held, clock, out = {}, START, []
    for rows in batches:
        for r in rows:
            held.setdefault(r[2], []).append((r[1], r[0]))
            clock = max(clock, r[1])
        held = {u: sorted(x, reverse=True)[:length] for u, x in held.items() if max(x)[0] >= clock - dt.timedelta(hours=ttl)}
        out.append(sorted((u, e) for u, x in held.items() for _, e in x))
    return out


def test_hot_lists_over_batches(spark, tmp_path):
    batches = [[event(i, i, i % 3) for i in range(9)], [event(20 + i, 9 + i, 1) for i in range(5)], [event(40, 40, 2), event(41, 12, 0)], [event(50, 41, 2)]]
    want, path = expected(batches, 4, 24), f"file://{tmp_path}/hot"
    step = flows.hot_list_step(path, 4)
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, SCHEMA).withColumn("ts", flows.F.col("ts").cast("timestamp"))
        for _ in range(2):  # a batch that is run again writes the same
            step(frame, number)
            assert sorted((r.user_id, r.event_id) for r in flows.hot_lists(spark, path, number).collect()) == want[number]
    assert {p.name for p in (tmp_path / "hot").iterdir()} == {"2", "3"}


def test_late_and_repeated_rows_and_a_restart(spark, tmp_path):
    source, path = f"{tmp_path}/source", f"file://{tmp_path}/once"

    def run():
        stream = flows.file_stream(spark, f"file://{source}", "*.parquet", flows.EVENTS, 1).withColumn("ts", flows.F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
        query = flows.start(flows.once_each(stream).select("event_id"), "append", path)
        query.awaitTermination()
        return sorted(r.event_id for r in spark.read.parquet(path).collect())

    put(spark, source, 1, [event(1, 0, 1), event(1, 0, 1), event(2, 0, 1)])
    assert run() == [1, 2]
    put(spark, source, 2, [event(2, 0, 1), event(3, 10, 1)])  # the query goes on where it stopped, and knows 2
    assert run() == [1, 2, 3]
    put(spark, source, 3, [event(4, 0, 1), event(5, 11, 1)])  # 4 is later than the watermark allows
    assert run() == [1, 2, 3, 5]


def test_steps_run_in_order_and_some_may_fail(spark):
    seen, failed = [], []

    def bad(batch, number):
        raise RuntimeError("no")

    steps = [("count", lambda b, n: seen.append((n, b.count())), False), ("bad", bad, True), ("last", lambda b, n: seen.append("last"), False)]
    flows.finaliser(steps, lambda name, e: failed.append(name))(spark.range(3), 5)
    assert seen == [(5, 3), "last"] and failed == ["bad"]
    with pytest.raises(RuntimeError):
        flows.finaliser([("bad", bad, False)], failed.append)(spark.range(1), 0)


def test_dimension_is_read_again_and_the_last_good_one_stays(spark):
    clock, reads = [0.0], []

    def load(s):
        reads.append(clock[0])
        if clock[0] == 30:
            raise OSError("gone")
        return s.range(len(reads))

    get = flows.refreshed(load, 30, lambda: clock[0])
    for now, count, n in ((0, 1, 1), (29, 1, 1), (30, 1, 2), (59, 1, 2), (60, 3, 3)):
        clock[0] = now
        assert get(spark).count() == count and len(reads) == n
