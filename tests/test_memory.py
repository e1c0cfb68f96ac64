"""Nearest memories against plain loops over all pairs, on odd vectors, with blocks of any size."""

from __future__ import annotations

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest

from confabula.operators import memory

QUERIES, MEMORIES = "query_id long, user_id string, vector array<float>", "id long, user_id string, embedding array<float>"
_random = random.Random(5)
SOME = [[float(np.float32(_random.gauss(0, 1))) for _ in range(5)] for _ in range(40)]
ODD = [None, [], [0.0] * 5, [1.0, None, 0.0, 0.0, 0.0], [1.0, 2.0], [float("nan")] * 5, [1e30] * 5, [1.0, 0.0, 0.0, 0.0, 0.0]]
#: Many copies for user a, one memory for b, none for c, no user for some.
KNOWN = [(900 - i, "a", v) for i, v in enumerate(SOME * 3 + ODD * 2)] + [(1, "b", SOME[0]), (2, None, SOME[0])] + [(2000 + i, f"u{i % 9}", SOME[i]) for i in range(36)]
ASKED = [(i, "a", v) for i, v in enumerate(SOME[:12] + ODD)] + [(100, "b", SOME[3]), (101, "c", SOME[3]), (102, None, SOME[0])] + [(200 + i, f"u{i % 9}", SOME[i]) for i in range(12)]


def product(a, b):
    out = 0.0
    for x, y in zip(a, b, strict=True):
        out += float(np.float32(x)) * float(np.float32(y))
    return out


def score(a, b, scorer):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    if scorer == "dot":
        x = product(a, b)
    else:
        if not any(a) or not any(b):
            return None
        x = product(a, b) / math.sqrt(product(a, a) * product(b, b))
    return x if math.isnan(x) or abs(x) > 1e15 else float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def key(x):
    at, s = x
    return (s is None, 0 if s is None else -math.inf if math.isnan(s) else -s, not (s is not None and math.isnan(s)), at)


@pytest.mark.parametrize(("scorer", "threshold", "block", "limit"), [("cosine", None, 4096, 5), ("cosine", None, 6, 5), ("cosine", 0.3, 6, 4), ("dot", None, 4096, 3), ("dot", 0.5, 10, 50), ("dot", None, 7, 200)])
def test_nearest_of_all_pairs(spark, scorer, threshold, block, limit):
    got = memory.recall(spark.createDataFrame(ASKED, QUERIES), spark.createDataFrame(KNOWN, MEMORIES), limit, threshold, scorer, block).collect()
    want = []
    for query, user, vector in ASKED:
        all_of = [(i, score(vector, v, scorer)) for i, u, v in KNOWN if user is not None and u == user]
        kept = sorted((x for x in all_of if threshold is None or (x[1] is not None and (math.isnan(x[1]) or x[1] >= threshold))), key=key)[:limit]
        want += [(query, user, i, str(s), n + 1) for n, (i, s) in enumerate(kept)]
    assert sorted((r.query_id, r.user_id, r.id, str(r.score), r["rank"]) for r in got) == sorted(want)


def test_blocks_of_pairs_are_products(spark, monkeypatch):
    """Pairs are multiplied as matrices; scores are summed only for those that may be among the nearest."""
    rng = np.random.default_rng(3)
    asked, known, summed = rng.normal(size=(50, 16)), rng.normal(size=(4000, 16)), []
    plain = memory._summed
    monkeypatch.setattr(memory, "_summed", lambda a, b: summed.append(len(a)) or plain(a, b))
    q, m, _ = memory._nearest(asked, known, np.arange(4000), 5, None, True)
    assert len(q) == 250 and sum(summed) < 5000


def test_other_scorers_are_refused(spark):
    with pytest.raises(ValueError, match="scorer"):
        memory.recall(spark.createDataFrame(ASKED, QUERIES), spark.createDataFrame(KNOWN, MEMORIES), scorer="l2")
