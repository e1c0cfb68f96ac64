import random

import pytest
from pyspark.sql import functions as F

from confabula.llm.near_dedup import components, near_duplicates, op9_near_dedup, signatures

from .helpers import SCHEMA, frame, texts


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size=2):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    rows = texts(seed, 150)
    assert sorted(map(tuple, near_duplicates(frame(spark, rows), size=2).collect())) == brute(rows)
    assert sorted(map(tuple, near_duplicates(frame(spark, rows)).collect())) == brute(rows, 5)


def test_every_pair_that_shares_a_key_can_be_confirmed(spark):
    """Similarities just below and above the bound, without the filter by equal minhashes."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(k, " ".join(words[: 120 - k] + [f"o{k}x{i}" for i in range(k)])) for k in range(0, 24, 2)] + [(100 + k, x) for k, x in texts(4, 30)]
    assert sorted(map(tuple, near_duplicates(frame(spark, rows), size=2, least_equal=0).collect())) == brute(rows)


def test_chain_of_links_in_one_bucket(spark):
    """Neighbours are similar, distant ones aren't: no single node meets all others."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join(words[k * 5 : k * 5 + 100])))
    order = list(range(40))
    rng.shuffle(order)
    rows = [(order[i], t) for i, t in rows]
    assert sorted(map(tuple, near_duplicates(frame(spark, rows), size=2).collect())) == brute(rows)


def test_buckets_and_nodes_spread_over_tasks(spark, monkeypatch):
    from confabula.llm import near_dedup

    monkeypatch.setattr(near_dedup, "A_TASK", 3)
    rows = texts(5, 120)
    assert sorted(map(tuple, near_duplicates(frame(spark, rows), size=2).collect())) == brute(rows)


def test_rounds_with_one_node_of_each_bucket(spark, monkeypatch):
    from confabula.llm import near_dedup

    monkeypatch.setattr(near_dedup, "AT_ONCE", 0)
    monkeypatch.setattr(near_dedup, "AT_ONCE_A_ROW", 0)
    rows = texts(4, 100)
    assert sorted(map(tuple, near_duplicates(frame(spark, rows), size=2).collect())) == brute(rows)


def test_nulls_repeated_rows_and_empty_table(spark):
    text = "a b c d e f g h i j"
    rows = [(5, text), (5, text), (None, text), (9, text), (10, None), (11, "")]
    got = sorted(map(tuple, near_duplicates(frame(spark, rows), size=2).collect()), key=str)
    assert got == sorted([(5, 9, 5, True)] * 2 + [(None, 9, None, True), (9, 9, 5, False), (10, 0, 10, True), (11, 0, 11, True)], key=str)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_columns_with_names_of_its_own_do_no_harm(spark):
    rows = texts(4, 40)
    more = frame(spark, rows)
    for name in ("key", "node", "n", "size", "n_shingles", "component_id", "kept", "a", "b", "sets"):
        more = more.withColumn(name, F.lit(-1))
    assert sorted(map(tuple, near_duplicates(more, size=2).collect())) == brute(rows)


def test_components_of_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_signature_of_equal_sets_is_equal(spark):
    rows = signatures(frame(spark, [(1, "A b c a b"), (2, "a  B\nc A b")]).select("doc_id", "text"), 2).collect()
    assert rows[0][1:] == rows[1][1:] and rows[0].n_shingles == 3


def test_query_on_test_data(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, op9_near_dedup(spark, sf_dir).collect())) == brute(docs)
