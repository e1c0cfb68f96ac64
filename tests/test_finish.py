"""The steps after a turn: a stop between any two of them changes nothing."""

from __future__ import annotations

import datetime as dt

from confabula.streaming import finish

AT = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def message(s, pos, role, content, placeholder=None):
    return (s, pos, role, content, placeholder, None, AT, "u", f"{s}-{pos // 2}", 1, None, "SYSTEM", 2, "m", 1)


BATCHES = [
    [message(1, 0, "user", "a question"), message(1, 1, "tool", "long output " * 9, "short"), message(2, 0, "user", "other")],
    [message(1, 2, "user", "more of it"), message(1, 3, "assistant", None), message(3, 0, "user", "x")],
]


def outcome(own):
    tables = [own.hot.read(), own.archived(), own.memories(), own.ledger.counters(), own.ledger.refused().drop("batch"), own.published()]
    return [sorted(map(str, t.collect())) for t in tables]


def finisher(spark, path):
    own = finish.Finisher(spark, path, lambda name, e: None, 3)
    return own


def test_a_stop_between_steps_changes_nothing(spark, tmp_path):
    frames = [spark.createDataFrame(b, finish.TURNS) for b in BATCHES]
    want = None
    for stop in (None, 0, 2, 4, 5):
        path = f"file://{tmp_path}/{stop}"
        own = finisher(spark, path)
        own.ledger.create(spark.createDataFrame([(1, None, 10, 0)], finish.Ledger.INCREMENTS))
        for number, batch in enumerate(frames):
            if stop is not None:
                name, step = own.steps[stop]

                def killed(b, n, step=step):
                    step(b, n)  # done, but no marker is left
                    raise KeyboardInterrupt

                own.steps[stop] = (name, killed)
                try:
                    own.run(batch, number)
                except KeyboardInterrupt:
                    own = finisher(spark, path)
            own.run(batch, number)
        got = outcome(own)
        want = want or got
        assert got == want, stop
    assert any("short" in x for x in want[1]) and not any("long output" in x for x in want[1])
    assert len(want[0]) == 5 and "usage_tokens=16" in want[3][0]


def test_steps_that_may_fail_are_reported_and_billing_stops_the_batch(spark, tmp_path):
    failed = []
    own = finish.Finisher(spark, f"file://{tmp_path}/f", lambda name, e: failed.append(name))
    own.steps[2] = ("archive", lambda b, n: 1 // 0)
    try:
        own.run(spark.createDataFrame(BATCHES[0], finish.TURNS), 0)  # there is no ledger
        raise AssertionError
    except Exception as e:
        assert not isinstance(e, AssertionError)
    assert failed == ["archive"]
    own.ledger.create(spark.createDataFrame([(1, None, 0, 0)], finish.Ledger.INCREMENTS))
    own.run(spark.createDataFrame(BATCHES[0], finish.TURNS), 0)
    assert failed == ["archive"] and own.published().count() == 2
