"""Batches of bind and unbind requests against the same requests made one after the other."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from confabula.operators.bindings import bind_owned, unbind_owned

OLD, NEW = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 6, 1)
MAPPINGS = "model_id long, provider_id long, owner_user_id string, provider_model_name string, priority long, is_preferred boolean, is_active boolean, created_at timestamp_ntz, updated_at timestamp_ntz"
OWNERS = {1: None, 2: "a", 3: "a", 4: "b"}
PROVIDERS = {p: (("a", "b", None)[p % 3], "OTHER" if p == 9 else "OPENAI_COMPATIBLE_LLM") for p in range(1, 13)}


def tables(spark):
    models = spark.createDataFrame(list(OWNERS.items()), "id long, owner_user_id string")
    return models, spark.createDataFrame([(p, *x) for p, x in PROVIDERS.items()], "id long, owner_user_id string, type string")


def start(rng):
    out = {}
    for m, owner in OWNERS.items():
        mine = [p for p, (o, _) in PROVIDERS.items() if o == owner]
        chosen = rng.sample(mine, rng.randint(0, len(mine)))
        for i, p in enumerate(chosen):
            out[m, p] = [owner, f"old{p}", rng.randint(0, 1), i == 0 and rng.random() < 0.7, i == 0 or rng.random() < 0.6, OLD + datetime.timedelta(days=rng.randint(0, 2)), OLD]
    return out


def rows(state):
    return sorted((m, p, *x) for (m, p), x in state.items())


def bind_one(state, m, p, user, name, preferred, active):
    if m not in OWNERS or OWNERS[m] != user:
        return "MODEL_NOT_FOUND"
    if p not in PROVIDERS or PROVIDERS[p][0] != user:
        return "PROVIDER_NOT_FOUND"
    if PROVIDERS[p][1] == "OTHER":
        return "TYPE_UNSUPPORTED"
    preferred = preferred and active
    if preferred and not ((m, p) in state and state[m, p][3]):
        for (other, _), x in state.items():
            if other == m and x[3]:
                x[3], x[6] = False, NEW
    if (m, p) in state:
        x = state[m, p]
        x[1], x[3], x[4], x[6] = name, preferred, active, NEW
    else:
        state[m, p] = [user, name, 0, preferred, active, NEW, NEW]
    return "OK"


def unbind_one(state, m, p, user):
    if m not in OWNERS or OWNERS[m] != user:
        return "MODEL_NOT_FOUND"
    if (m, p) not in state:
        return "MAPPING_NOT_FOUND"
    if state.pop((m, p))[3]:
        left = sorted((x[2], x[5], q) for (other, q), x in state.items() if other == m and x[4])
        if left:
            heir = state[m, left[0][2]]
            heir[3], heir[6] = True, NEW
    return "OK"


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("seed", range(4))
def test_binding_in_a_batch_is_binding_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    state = start(rng)
    before = spark.createDataFrame(rows(state), MAPPINGS)
    asked = []
    for i in range(25):
        m = rng.choice([1, 2, 3, 4, 5])
        user = OWNERS.get(m, "a") if rng.random() < 0.9 else "b"
        mine = [p for p, (o, _) in PROVIDERS.items() if o == user]
        asked.append((i, m, rng.choice(mine) if rng.random() < 0.9 else rng.randint(1, 14), user, f"new{i}", rng.random() < 0.6, rng.random() < 0.8))
    outcomes = [(a[0], bind_one(state, *a[1:])) for a in asked]
    rng.shuffle(asked)
    requests = spark.createDataFrame(asked, "request_id long, model_id long, provider_id long, user_id string, provider_model_name string, is_preferred boolean, is_active boolean")
    got, answers = bind_owned(before, requests, *tables(spark), F.lit(NEW).cast("timestamp_ntz"))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(rows(state), key=key)
    assert sorted((r.request_id, r.outcome) for r in answers.collect()) == outcomes


@pytest.mark.parametrize("seed", range(4))
def test_unbinding_in_a_batch_is_unbinding_one_after_the_other(spark, seed):
    rng = random.Random(10 + seed)
    state = start(rng)
    before = spark.createDataFrame(rows(state), MAPPINGS)
    asked = []
    for i in range(8):
        m, p = rng.choice([*state, (1, 1), (5, 2)])
        asked.append((i, m, p, OWNERS.get(m, "a") if rng.random() < 0.9 else "b"))
    outcomes = [(a[0], unbind_one(state, *a[1:])) for a in asked]
    requests = spark.createDataFrame(asked, "request_id long, model_id long, provider_id long, user_id string")
    got, answers = unbind_owned(before, requests, tables(spark)[0], F.lit(NEW).cast("timestamp_ntz"))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(rows(state), key=key)
    assert sorted((r.request_id, r.outcome) for r in answers.collect()) == outcomes


def test_nothing_asked_changes_nothing(spark):
    state = start(random.Random(3))
    before = spark.createDataFrame(rows(state), MAPPINGS)
    requests = spark.createDataFrame([], "request_id long, model_id long, provider_id long, user_id string, provider_model_name string, is_preferred boolean, is_active boolean")
    assert bind_owned(before, requests, *tables(spark), F.lit(NEW).cast("timestamp_ntz"))[0].count() == len(state)
