"""Sharding, quality rules, language identification."""

import pytest

from confabula.llm import language_id, quality_rules, sharding

from .helpers import SCHEMA, frame, texts


def test_shards_share_the_slots_and_few_move():
    names = sharding.shard_names(20)
    owner = sharding.lookup_table(names, 4099)
    sizes = [owner.count(i) for i in range(20)]
    assert max(sizes) - min(sizes) <= 1
    fewer = sharding.lookup_table(names[:-1], 4099)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 19)
    assert moved < 0.25 * 4099
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 4098)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"], 7)


def test_placement_handles_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "x", 1), (5, "y", 2), (5, "z", 3)], "doc_id long, slot string, v int")
    out = sharding.place(df, "doc_id", ["a", "b", "c"], 101).orderBy("v").collect()
    assert [r.v for r in out] == [1, 2, 3] and out[1].slot == out[2].slot and out[1].shard == out[2].shard
    owner = sharding.lookup_table(["a", "b", "c"], 101)
    assert all(owner[r.slot] == r.shard for r in out)
    assert sharding.place(spark.createDataFrame([], "doc_id long"), "doc_id", ["a"], 101).count() == 0


def test_sharding_runs_no_python_on_executors(spark, sf_dir):
    plan = sharding.op2_sharding(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan and "Broadcast" in plan


RULES = quality_rules.Rules()


@pytest.mark.parametrize(
    "line,fails",
    [
        (b"Home", True),
        (b"Short but ended.", False),
        (b"this line has more than five words", False),
        (b"a | b | c | d.", True),
        (b"Licensed under the Some Licence, version 2.", True),
        (b"### $$$ a b.", True),
        ("Alle Rechte vorbehalten, auch die der Übersetzung und Vervielfältigung.".encode(), True),
        (b"stop!! it!! now!!", True),
        ("Ein Satz mit „Worten“ und … Ende.".encode(), False),
    ],
)
def test_line_rules(line, fails):
    assert quality_rules.line_fails(line, len(line.split()), RULES) is fails


def test_repeated_words_counts_words_in_repeated_windows():
    f = quality_rules.repeated_words
    assert f([]) == 0 and f([b"a", b"b"]) == 0 and f([b"a"] * 3) == 0 and f([b"a"] * 4) == 4
    assert f(b"a b c x a b c y".split()) == 6


def test_rules_over_rows(spark):
    good = " ".join(f"word{i} runs{i} on{i} and{i} on." for i in range(40))
    rows = [(6, good + ("\n" + good) * 400), (1, good), (1, good), (2, good + "\nHome\nAll rights reserved."), (3, None), (4, ""), (None, "a b c " * 100), (5, "\n".join(["x | y | z"] * 30) + "\n" + good)]
    out = {r.doc_id: r for r in quality_rules.apply_rules(frame(spark, rows).selectExpr("*", "'?' AS kept"), clean=True).collect()}
    assert [out[i].kept for i in (1, 2, 3, 4, None, 5)] == [True, True, False, False, False, False]
    assert out[6].n_words == 401 * 200 and out[6].base_failed and out[6].n_dup_lines == 400
    assert out[1].clean_text is None and out[2].clean_text == good and out[2].n_removed_lines == 2
    assert out[5].n_dup_lines == 29 and out[None].base_failed and out[3].n_words == 0
    assert quality_rules.apply_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_language_of_held_out_documents(spark, sf_dir):
    found = language_id.op8_language_id(spark, sf_dir)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r for r in found.collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    rows = [(1, "the house and the garden"), (2, "das haus und der garten"), (3, None), (4, "123 !!"), (5, "x"), (None, "der garten"), (6, "你好世界")]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "CASE doc_id WHEN 1 THEN 'en' WHEN 2 THEN 'de' END AS lang", "1 AS score")
    names, prototypes = language_id.learn(docs, "lang")
    assert names == ["de", "en"]
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, names, prototypes).collect()}
    assert out[1][0] == "en" and out[2][0] == "de" and out[None][0] == "de" and out[3] == ("und", 0) and out[4] == ("und", 0)
    names, prototypes = language_id.learn(docs.where("false"), "lang")
    assert {r.lang_pred for r in language_id.identify(docs, names, prototypes).collect()} == {"und"}
    assert language_id.identify(docs.where("false"), ["a"], prototypes).count() == 0


def bundled(text):
    """The sum of a text's bound trigrams, letter by letter."""
    import numpy as np

    text = " " + (text or "") + " "
    low = [ord(c.lower()[0]) if c.isalpha() else 0 for c in text]
    v = language_id.letter_vector
    return sum((np.roll(v(a), 2).astype(int) * np.roll(v(b), 1) * v(c) for a, b, c in zip(low, low[1:], low[2:], strict=False) if b), np.zeros(language_id.DIMENSIONS, int))


def test_bundles_are_sums_of_bound_trigrams(monkeypatch):
    import numpy as np

    texts_ = ["Straße, Äpfel", None, "你好世界 Привет", "", "123", "".join(chr(c) for c in range(0x4E00, 0x4F00)), "ab"]
    monkeypatch.setattr(language_id, "KEPT", 300)
    own = language_id.Bundler()
    for _ in range(2):
        assert np.array_equal(own.bundle(texts_), np.array([bundled(x) for x in texts_]))
        assert own.seen.tolist() == [True, False, True, False, False, True, True]
    assert np.array_equal(own.bundle(texts_[:3], np.array([0, 1, 0]), 2)[0], bundled(texts_[0]) + bundled(texts_[2]))
    assert (language_id.letter_vector(ord("你")) != language_id.letter_vector(ord("好"))).any()


def test_query_against_brute_force(spark, sf_dir):
    """Prototypes and cosines computed text by text."""
    import zlib

    import numpy as np

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    own = {r.doc_id: bundled(r.text) for r in docs}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs}
    names = sorted({r.lang for r in docs if r.lang is not None and not held[r.doc_id]})
    sums = np.array([sum((own[r.doc_id] for r in docs if r.lang == x and not held[r.doc_id] and r.text is not None), np.zeros(language_id.DIMENSIONS, int)) for x in names])
    unit = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    for r in language_id.op8_language_id(spark, sf_dir).collect():
        assert r.held_out == held[r.doc_id]
        if not own[r.doc_id].any():
            continue
        cosines = unit @ own[r.doc_id] / np.linalg.norm(own[r.doc_id])
        assert r.score == pytest.approx(max(0, cosines.max()), abs=1e-5) and cosines[names.index(r.lang_pred)] > cosines.max() - 1e-5


def test_language_of_long_repeated_and_equal_texts(spark):
    long = "the house and the garden " * 20_000
    rows = [(1, long), (1, long), (2, "the house"), (3, "the house"), (4, "das haus")]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "CASE doc_id WHEN 1 THEN 'en' WHEN 4 THEN 'de' WHEN 2 THEN 'aa' WHEN 3 THEN 'bb' END AS lang")
    names, prototypes = language_id.learn(docs, "lang")
    out = sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs, names, prototypes).collect())
    assert out[0] == out[1] and out[0][1] == "en" and out[0][2] == pytest.approx(1, abs=1e-6)
    assert out[2][1] == out[3][1] == "aa" and out[4][1] == "de"  # of equal similarities the first language


def test_rules_agree_with_their_sql(spark, sf_dir):
    import duckdb

    db = duckdb.connect()
    rows = texts(8)
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = sorted(tuple(r) for r in quality_rules.apply_rules(frame(spark, rows).select("doc_id", "text")).drop("text").collect())
    names = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines, n_kept_words, kept"
    assert got == sorted(db.execute(f"SELECT {names} FROM ({quality_rules.op7_sql()})").fetchall())
