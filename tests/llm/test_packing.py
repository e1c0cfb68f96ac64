import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from confabula.llm.packing import LENGTH, best_fit, op10_packing, pack
from confabula.llm.tokenization import vocabulary

from .helpers import SCHEMA, frame, texts

PATH = vocabulary("word_bpe_49k.json")


def expected(rows):
    t = Tokenizer.from_file(PATH)
    out = []
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), LENGTH)):
            own = ids[at : at + LENGTH]
            out.append((i, k, at, len(own), zlib.crc32(own.tobytes())))
    return sorted(out, key=str)


def valid(rows):
    """Sequences are filled without gaps from 0 up to at most LENGTH; gives their number."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= LENGTH
    return len(by)


def test_pieces_and_places(spark):
    rows = texts(1) + [(1000, "word " * 5000), (1001, "x <|endoftext|> y"), (1002, "İ.")]
    got = pack(frame(spark, rows).repartition(5), PATH).collect()
    assert sorted((tuple(r[:5]) for r in got), key=str) == expected(rows)
    used = valid(got)
    assert used <= 1.05 * sum(r.length for r in got) / LENGTH + 1


def test_query_on_test_data(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op10_packing(spark, sf_dir).collect()
    assert sorted((tuple(r[:5]) for r in got), key=str) == expected(docs)
    assert valid(got) <= 1.03 * sum(r.length for r in got) / LENGTH + 1


def test_nulls_repeated_rows_and_empty_table(spark):
    got = pack(frame(spark, [(None, None), (1, ""), (1, "a b"), (1, "a b")]), PATH).collect()
    assert len(got) == 4 and valid(got) == 1
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_columns_with_names_of_its_own_do_no_harm(spark):
    rows = texts(5, 30)
    more = frame(spark, rows)
    for name in ("piece", "start", "length", "ids_crc32", "part", "rank", "before", "sequence_id", "offset"):
        more = more.withColumn(name, F.lit(-1))
    got = pack(more, PATH).collect()
    assert sorted((tuple(r[:5]) for r in got), key=str) == expected(rows) and valid(got)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 50) for n in rng.sample(range(1, LENGTH + 1), rng.randint(1, 600))}
    runs, opened = best_fit(counts)
    seen = {}
    fill = {}
    for n, first, many, seq, offset in runs:
        seen.setdefault(n, []).append((first, many))
        for s in range(seq, seq + many):
            fill.setdefault(s, []).append((offset, n))
    for n, own in seen.items():
        at = 0
        for first, many in sorted(own):
            assert first == at
            at += many
        assert at == counts[n]
    assert len(fill) == opened
    for own in fill.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= LENGTH
    assert opened <= best_fit_decreasing(counts)


def best_fit_decreasing(counts):
    """The sequential method, piece by piece."""
    gaps, opened = [], 0
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        k = bisect_left(gaps, n)
        if k < len(gaps):
            insort(gaps, gaps.pop(k) - n)
        else:
            opened += 1
            insort(gaps, LENGTH - n)
    return opened
