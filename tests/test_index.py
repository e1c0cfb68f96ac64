"""The index on disk: it follows its table, and merging changes no result; pages and long sessions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from confabula.functions.text import tokens
from confabula.operators import messages, search
from confabula.sources.postings import BLOCK, TokenIndex, coded, decoded

SCHEMA = "session_id long, pos long, content string"


def sets(df):
    return sorted(map(tuple, df.select("session_id", "pos").collect()))


def test_search_follows_the_files_of_the_table(spark, tmp_path):
    table, index = f"file://{tmp_path}/t", TokenIndex(spark, f"file://{tmp_path}/i", tokens)

    def ask(word):
        index.follow(table, lambda x: x)
        rows = spark.read.schema(SCHEMA).parquet(table)
        got = sets(search.search(rows, index, word))
        assert got == sets(search.search(rows, search.token_index(rows), word))
        return got

    spark.createDataFrame([(1, i, f"alpha w{i % 3}") for i in range(50)], SCHEMA).write.parquet(table)
    assert len(ask("W1")) == 17
    segments = index.manifest().segments
    assert len(ask("w1")) == 17 and index.manifest().segments == segments  # nothing new, nothing written
    spark.createDataFrame([(2, i, "w1 beta") for i in range(5)], SCHEMA).write.mode("append").parquet(table)
    assert len(ask("w1")) == 22 and len(index.manifest().segments) == 2
    index.merge()
    assert len(ask("w1 beta")) == 22 and len(index.manifest().segments) == 1
    spark.createDataFrame([(3, i, "w1") for i in range(415)], SCHEMA).write.mode("overwrite").parquet(table)
    assert len(ask("w1")) == 415


def test_postings_are_coded_without_loss(spark):
    rng = random.Random(1)
    rows = sorted({("a", s, p) for s in (1, 2) for p in rng.sample(range(3 * BLOCK), 300)} | {("b", 1, -5), ("b", 1, 0)})
    assert sorted(map(tuple, decoded(coded(spark.createDataFrame(rows, "token string, session_id long, pos long"))).collect())) == rows


def test_deleted_and_changed_messages(spark, tmp_path):
    index = TokenIndex(spark, f"file://{tmp_path}/i", tokens)
    index.add(spark.createDataFrame([(1, 1, "red sea"), (1, 2, "red hat"), (2, 1, "sea")], SCHEMA))
    index.delete(spark.createDataFrame([(1, 1, None)], SCHEMA))
    index.change(spark.createDataFrame([(2, 1, "red")], SCHEMA))
    for _ in range(2):
        assert sets(index.postings(["red"])) == [(1, 2), (2, 1)] and sets(index.postings(["sea"])) == []
        index.merge()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def conversation(n, seed=3):
    rng = random.Random(seed)
    return [(s, p * 2, rng.choice(["user", "assistant", "tool", "system"]), "x", rng.choice([None, 1, 5])) for s, m in ((1, n), (2, 3), (3, 1)) for p in range(m)]


MESSAGES = "session_id long, pos long, role string, content string, token_count long"


def test_one_long_session_runs_in_many_tasks(spark):
    rows = spark.createDataFrame(conversation(3000), MESSAGES)
    cuts = messages.long_sessions(rows, 100, 8)
    assert [(r.session_id, len(r.cuts)) for r in cuts.collect()] == [(1, 7)]
    for a, b in ((messages.turns(rows, cuts), messages.turns(rows)), (messages.context_window(rows, 3000, cuts=cuts), messages.context_window(rows, 3000))):
        assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))
    assert messages.long_sessions(rows, 100_000).count() == 0


def test_pages_are_bounded_by_their_anchors(spark):
    rows = spark.createDataFrame(conversation(200), MESSAGES)
    own = messages.turns(rows).withColumn("turn_rank", F.sum(messages.is_user()).over(messages.whole()) - F.col("turn_no") + 1)
    for page, size in ((1, 5), (2, 7), (9, 5), (40, 100)):
        want = own.where((F.col("turn_no") > 0) & F.col("turn_rank").between((page - 1) * size + 1, page * size) & F.col("role").isin("user", "assistant", "tool"))
        got = messages.history_page(rows, page, size)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert "WindowGroupLimit" in plan(messages.history_page(rows, 1, 5))
