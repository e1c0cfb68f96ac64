import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from confabula.llm.vector_codes import BallTree, op12_sql, op12_vector_codes, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=256, rounds=4):
    """Plain lists and integers. rows: (vec_id, vector, label); gives (vec_id, label, code, error) and the codebooks."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], l) for i, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    w = len(kept[0][1]) // 4 if kept else 0
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(4)]

    def find(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        after = []
        for p in range(4):
            own = {}
            for _, v, _ in kept:
                own.setdefault(find(p, v)[1], []).append(part(v, p))
            after.append([[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])])
        books = after
    out = []
    for i, v, l in kept:
        found = [find(p, v) for p in range(4)]
        out.append((i, l, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return sorted(out, key=str), books


def rows_of(n, seed=0, size=8):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    out = [(i, [round(x + rng.choice([0, 0, 0.01, -0.02]), 2) for x in rng.choice(middles)], rng.choice([None, 1, 2])) for i in range(n)]
    return out + [(n, None, 1), (n + 1, [1.0, None] * 4, 1), (n + 2, [math.inf] + [0.0] * 7, 2), (n + 3, [math.nan] * 8, 1), (n + 4, [], 1)]


@pytest.mark.parametrize("entries", [3, 40, 256])
def test_codes_are_those_of_plain_integers(spark, entries):
    rows = rows_of(120)
    random.Random(1).shuffle(rows)
    got, books = vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=entries)
    want, expected = brute(rows, entries)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert books.tolist() == expected


@pytest.mark.parametrize("seed", range(6))
def test_ball_tree_finds_the_nearest_and_of_ties_the_lowest(seed):
    rng = np.random.default_rng(seed)
    n, high = int(rng.integers(1, 257)), int(rng.choice([2, 5, 3000, 1 << 27]))
    entries, x = rng.integers(-high, high, (n, 6)), rng.integers(-high, high, (400, 6))
    x[:50] = entries[rng.integers(0, n, 50)]
    exact = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    at, best = BallTree(entries).nearest(x)
    assert (at == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()


def test_query_and_sql_on_test_data(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = op12_vector_codes(spark, sf_dir)
    names = sorted(got.columns)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(con.execute(op12_sql()).df()[names].itertuples(index=False, name=None))
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, books = brute(data)
    assert sorted((r.vec_id, r.code, r.error) for r in got.collect()) == sorted((i, code, e) for i, _, code, e in want)
    assert got.first().codebooks_sha256 == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_defined_cases(spark):
    empty, books = vector_codes(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and books.size == 0
    # no id, a repeated one, another length, five components, huge components, other columns
    rows = [(None, [9.0] * 5, 1, "a"), (1, [0.5] * 5, None, "b"), (1, [0.25] * 5, None, "b"), (2, [1.0] * 4, 1, "c"), (3, [3e38] * 5, 2, "d")]
    got, books = vector_codes(spark.createDataFrame(rows, SCHEMA + ", parts string"), rounds=0)
    assert sorted((r.vec_id or 0, r.code, r.error) for r in got.collect()) == [(0, "03030300", 0), (1, "00000000", 0), (1, "01010100", 0), (3, "02020200", 0)]  # the last part is filled up, so all tie
    assert books.shape == (4, 4, 2) and books.max() == 1 << 27
