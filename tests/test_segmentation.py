"""Words of scripts without spaces: the most probable path against all cuts, and what a search finds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from confabula.functions.segmentation import Lexicon, Segmenter, discovered
from confabula.functions.text import tokens
from confabula.operators import search
from confabula.sources.postings import TokenIndex

WORDS = [("软件", 50), ("工程", 60), ("软件工程", 30), ("架构", 40), ("工程师", 9), ("东京", 20), ("京都", 20), ("大学", 30)]


def cuts(run):
    for n in range(1, len(run)):
        for rest in cuts(run[n:]):
            yield [run[:n], *rest]
    yield [run]


@pytest.mark.parametrize("seed", range(6))
def test_path_is_the_least_of_all_cuts(seed):
    rng = random.Random(seed)
    lexicon = Lexicon({"".join(rng.choices("abc", k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(12)})
    for _ in range(40):
        run = "".join(rng.choices("abcd", k=rng.randint(1, 9)))
        allowed = [c for c in cuts(run) if all(len(w) == 1 or w in lexicon.costs for w in c)]
        cost = lambda c: sum(lexicon.costs.get(w, lexicon.unknown) for w in c)
        least = min(map(cost, allowed))
        assert lexicon.path(run) == min((c for c in allowed if cost(c) == least), key=lambda c: [-len(w) for w in reversed(c)])


def test_tokens_of_an_index_and_of_a_query(spark):
    cut = Segmenter(spark.createDataFrame(WORDS, "word string, n long"))
    rows = [(0, "软件工程架构"), (1, "Spark 3 的软件, ok"), (2, "甲乙丙大学"), (3, ""), (4, None), (5, "plain text"), (6, "京"), (7, "软件工程" * 3000)]
    got = {r.i: (r.a, r.b) for r in spark.createDataFrame(rows, "i int, t string").select("i", cut.tokens(F.col("t")).alias("a"), cut.query_tokens(F.col("t")).alias("b")).collect()}
    assert got[0] == (["软件", "工程", "软件工程", "架构"], ["软件工程", "架构"])
    assert got[1][0] == ["spark", "ok", "软件"] and got[2][0] == ["甲乙", "乙丙", "大学"]
    assert got[3] == ([], []) and got[4] == (None, None) and got[5][0] == ["plain", "text"] and got[6][0] == []
    assert got[7][1] == ["软件工程"] * 3000
    none = Segmenter(spark.createDataFrame([], "word string, n long"))
    assert spark.range(1).select(none.tokens(F.lit("软件工程")).alias("x")).first().x == ["软件", "件工", "工程"]


def test_search_by_words_has_no_false_pairs(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "东京都大学"), (1, 2, "我在京都"), (1, 3, "软件工程师"), (2, 1, "工程"), (2, 2, "nothing")], "session_id long, pos long, content string")
    lexicon = spark.createDataFrame([*WORDS, ("东京都", 90)], "word string, n long")
    cut = Segmenter(lexicon)
    index = TokenIndex(spark, f"file://{tmp_path}/i", cut.tokens)
    index.add(rows)
    found = lambda word: sorted((r.session_id, r.pos) for r in search.search(rows, index, word, cut.query_tokens).collect())
    assert found("工程") == [(1, 3), (2, 1)] and found("东京") == [(1, 1)] and found("大学") == [(1, 1)]
    pairs = lambda word: sorted((r.session_id, r.pos) for r in search.search(rows, search.token_index(rows), word).collect())
    assert (1, 1) in pairs("都大学") and found("都大") == []  # a pair across two words
    assert found("软件工程师") == [(1, 3)] and set(pairs("软件工程师")) == {(1, 3), (2, 1)}  # of the pairs one is in another message
    assert sorted(map(tuple, search.token_index(rows, tokens).collect())) == sorted(map(tuple, search.token_index(rows).collect()))


def test_words_are_found_in_a_corpus_without_spaces(spark):
    rng = random.Random(4)
    words = ["软件", "工程师", "东京", "大学"]
    filler = [chr(0x5000 + i) for i in range(60)]
    lines = [("".join(rng.choice(words) if rng.random() < 0.3 else rng.choice(filler) for _ in range(30)),) for _ in range(300)]
    found = {r.word: r.n for r in discovered(spark.createDataFrame([*lines, (None,), ("",), ("latin",)], "t string"), "t", cohesion=5).collect()}
    assert set(words) <= set(found)
    assert found["软件"] == sum(x.count("软件") for (x,) in lines)
    assert not {"工程", "程师", "件工"} & set(found)  # parts of a word, and a chance pair
    assert discovered(spark.createDataFrame([], "t string"), "t").count() == 0
