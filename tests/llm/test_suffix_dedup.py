import hashlib
import random

import pytest

from confabula.llm import suffix_dedup
from confabula.llm.suffix_dedup import PASSAGE, PIECE, SPAN, Chunk, LoserTree, decoded, op5_suffix_dedup, remove_repeats, shared_prefix

from .helpers import SCHEMA, frame, texts


def marks(rows, span):
    """For each row its bytes, and which of them a string of span bytes covers that also starts elsewhere."""
    data = [(t or "").encode() for _, t in rows]
    count = {}
    for x in data:
        for p in range(len(x) - span + 1):
            h = hash(x[p : p + span])
            count[h] = count.get(h, 0) + 1
    for x in data:
        hit = bytearray(len(x) + 1)
        for p in range(len(x) - span + 1):
            if count[hash(x[p : p + span])] > 1:
                hit[p : p + span] = b"\1" * span
        yield x, hit


def brute(rows, span=SPAN, also=None):
    """(doc_id, n_bytes, n_removed, n_spans, kept sha256, ...) from all strings of span bytes."""
    runs = lambda hit, n: sum(1 for p in range(n) if hit[p] and (p == 0 or not hit[p - 1]))
    out = []
    for (i, _), (x, hit) in zip(rows, marks(rows, span), strict=True):
        kept = bytes(b for b, h in zip(x, hit, strict=False) if not h)
        out.append((i, len(x), len(x) - len(kept), runs(hit, len(x)), hashlib.sha256(kept).hexdigest()))
    if also:
        out = [(*r, sum(hit), runs(hit, len(x))) for r, (x, hit) in zip(out, marks(rows, also), strict=True)]
    return sorted(out, key=str)


def found(df, *more):
    from pyspark.sql import functions as F

    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256), *more).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_strings(spark, seed):
    rows = texts(seed)
    assert found(remove_repeats(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("hot_at", [1, 3, 20_000])
def test_two_lengths_and_hot_prefixes(spark, hot_at):
    """hot_at 1 counts the strings of every repeated prefix by Spark, 3 those of some."""
    rows = texts(3)
    docs = frame(spark, rows).repartition(6)
    assert found(remove_repeats(docs, also=PASSAGE, hot_at=hot_at), "n_repeated", "n_passages") == brute(rows, SPAN, PASSAGE)
    assert found(remove_repeats(docs, span=PASSAGE, hot_at=hot_at)) == brute(rows, PASSAGE)
    with pytest.raises(ValueError):
        remove_repeats(docs, span=100, also=100)


@pytest.mark.parametrize("often", [1, 1_000_000])
def test_no_prefix_or_every_prefix_is_spread(spark, monkeypatch, often):
    monkeypatch.setattr(suffix_dedup, "OFTEN", often)
    rows = texts(3)
    assert found(remove_repeats(frame(spark, rows).repartition(6), also=PASSAGE), "n_repeated", "n_passages") == brute(rows, SPAN, PASSAGE)


def test_hot_passage_before_different_texts(spark):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = noise(420)
    rows = [(k, noise(rng.randint(0, 90)) + passage + noise(rng.randint(0, 500))) for k in range(80)]
    rows += [(100 + k, rows[k][1][: 300 + 20 * k]) for k in range(10)]
    assert found(remove_repeats(frame(spark, rows).repartition(5), also=PASSAGE, hot_at=4), "n_repeated", "n_passages") == brute(rows, SPAN, PASSAGE)


def test_texts_longer_than_a_piece(spark):
    """Repeats within a text of over two pieces, across the border of a piece, and with a short text."""
    rng = random.Random(2)
    letters = rng.choices(b"abcdefghijklmnopqrstuvwxyz    ", k=2 * PIECE + 5000)
    long = bytes(letters).decode()
    shared = long[PIECE - 600 : PIECE + 200]
    long = long[:1000] + shared[:450] + long[1000:] + long[50_000:50_700]
    rows = [(1, long), (2, "x" + shared + "y"), (3, long[70_000:70_300]), (4, long[90_000:90_401])]
    got = {r[0]: r for r in found(remove_repeats(frame(spark, rows)))}
    whole = brute([(1, long[:2200]), (5, long[49_000:52_000]), (6, long[89_000:92_000]), (7, long[PIECE - 3000 : PIECE + 3000]), (8, long[-3000:]), *rows[1:]])
    removed = {r[0]: r[2] for r in whole}
    assert got[1][2] == sum(removed[k] for k in (1, 5, 6, 7, 8)) and [got[k][2] for k in (2, 3, 4)] == [removed[k] for k in (2, 3, 4)] == [800, 0, 401]


def test_edges_meet_at_every_distance(spark):
    """Shared strings of just 400 bytes or a few more, with other text on both sides."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = []
    for k in range(40):
        shared = noise(SPAN + rng.choice([-1, 0, 0, 1, 5, 150, 230]))
        for _ in range(rng.randint(2, 3)):
            rows.append((len(rows), noise(rng.randint(0, 300)) + shared + noise(rng.randint(0, 300))))
    assert found(remove_repeats(frame(spark, rows).repartition(5))) == brute(rows)


def test_nulls_repeated_rows_clashing_columns_and_empty_table(spark):
    long = "".join(random.Random(3).choice("abc de") for _ in range(900))
    rows = [(None, long), (7, long), (7, long), (8, None), (None, None), (9, "")]
    docs = frame(spark, rows).selectExpr("*", "'x' AS spans", "1 AS _rid", "2 AS n_bytes")
    got = found(remove_repeats(docs))
    assert got == brute(rows)
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_test_data(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op5_suffix_dedup(spark, sf_dir).collect()), key=str) == brute(docs, SPAN, PASSAGE)


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(1)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 30))) for _ in range(7)]
    coded = []
    for run in runs:
        chunk = Chunk()
        for i, x in enumerate(run):
            chunk.add(x, len(x), 1, 1, i)
        coded.append(decoded(*chunk.coded()))
    out = [(same, head[1]) for same, _, head in LoserTree(coded)]
    assert [x for _, x in out] == sorted(x for run in runs for x in run)
    assert all(same == shared_prefix(a, b) for (_, a), (same, b) in zip(out, out[1:], strict=False))
