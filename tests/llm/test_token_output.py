import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from confabula.llm.common import new_path
from confabula.llm.token_output import EliasFano, op1_token_output, read_tokens, write_tokens
from confabula.llm.tokenization import pieces, vocabulary

from .helpers import SCHEMA, frame, texts

PATH = vocabulary("byte_bpe_50k.json")
ODD = ["", " ", "a  b", "a\n\nb", "x,,y", "x.,y .z", "it's we'll. 'tis", "3.14, 2,5", "é. É, ñ.b", "<|endoftext|> a", "a\xa0b", "a\x1cb", "Σας ΣΑΣ.", "_._ a_,b", "—“x”.", "你好，世界. 日本", "²x½", "é. é,", "a\0b"]


def whole(name):
    t = Tokenizer.from_file(vocabulary(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def expected(rows):
    encode, start, out = whole("byte_bpe_50k.json"), 0, []
    for i, x in sorted(rows):
        ids = np.array([*encode(x), 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", NAMES)
def test_pieces_give_the_ids_of_the_whole_text(name):
    encode, own = whole(name), pieces(vocabulary(name))
    rows = ODD + [t for _, t in texts(2)]
    ids, counts = own.encode(pa.array(rows, pa.string()))
    assert ids.tolist() == [i for x in rows for i in [*encode(x), 0]]
    assert counts.tolist() == [len(encode(x)) + 1 for x in rows]
    assert own.encode(pa.array([], pa.string()))[0].tolist() == []


@pytest.mark.parametrize("name", NAMES)
def test_pieces_of_random_strings(name):
    """Letters that change their length in lower case, marks, unusual blanks, special tokens and punctuation in any order."""
    rng = random.Random(11)
    letters = [*"abXYZ  \n\n.,.,'!-_12é", *"\u0301İßſKÅ½²٣中あ가ᅡक़ \t ’“ẞΣςͅ😀ǅ\x00\x85", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "'S"]
    rows = ["".join(rng.choice(letters if i % 2 else letters[:20]) for _ in range(rng.randint(0, 14))) for i in range(8000)]
    encode = whole(name)
    ids, counts = pieces(vocabulary(name)).encode(pa.array(rows), None)
    ends = np.cumsum(counts)
    for x, a, b in zip(rows, ends - counts, ends, strict=True):
        assert ids[a:b].tolist() == encode(x), ascii(x)


def test_remembered_pieces_change_no_ids(monkeypatch):
    from confabula.llm import tokenization

    monkeypatch.setattr(tokenization, "REMEMBERED", 5)
    own, rows = tokenization.Pieces(PATH), [t for _, t in texts(5)]
    ids, _ = own.encode(pa.array(rows, pa.string()))
    encode = whole("byte_bpe_50k.json")
    assert ids.tolist() == [i for x in rows for i in [*encode(x), 0]]


@pytest.mark.parametrize("segment_ids", [1, 500, 1 << 20])
def test_round_trip(spark, segment_ids):
    rows = texts(3)
    path = new_path(spark, "tokens")
    write_tokens(frame(spark, rows).repartition(3), path, PATH, segment_ids=segment_ids)
    got = read_tokens(spark, path, ids=True).orderBy("doc_id").collect()
    assert [tuple(r[:4]) for r in got] == expected(rows)
    encode = whole("byte_bpe_50k.json")
    assert all(np.frombuffer(r.ids, "<u4").tolist() == [*encode(dict(rows)[r.doc_id]), 0] for r in got)


def test_nulls_repeated_rows_and_empty_table(spark):
    path = new_path(spark, "tokens")
    write_tokens(frame(spark, [(None, "a"), (2, None), (1, "b b"), (1, "b b")]), path, PATH)
    got = sorted((tuple(r) for r in read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 1, 2] and [r[1] for r in got] == [0, 2, 5, 8]
    path = new_path(spark, "tokens")
    write_tokens(spark.createDataFrame([], SCHEMA), path, PATH)
    assert read_tokens(spark, path).count() == 0


def test_columns_with_names_of_its_own_do_no_harm(spark):
    path, rows = new_path(spark, "tokens"), [(3, "one two"), (1, "three"), (2, "")]
    more = frame(spark, rows)
    for name in ("start", "n_tokens", "ids_crc32", "ids", "segment"):
        more = more.withColumn(name, F.lit(-1))
    write_tokens(more, path, PATH)
    assert sorted(tuple(r) for r in read_tokens(spark, path).collect()) == expected(rows)


def test_query_on_test_data(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert [tuple(r) for r in op1_token_output(spark, sf_dir).orderBy("doc_id").collect()] == expected(docs)


@pytest.mark.parametrize("n,universe", [(1, 0), (1, 10**9), (5, 5), (1000, 1000), (3000, 10**6), (200, 2**33)])
def test_elias_fano_selects(n, universe):
    values = np.sort(np.random.default_rng(n).integers(0, universe + 1, n))
    coded = EliasFano.of(values, universe)
    assert [coded.select(i) for i in range(n)] == values.tolist()
    assert len(coded.low) + len(coded.high) <= n * (3 + np.log2(max(1, universe) / n + 1)) / 8 + 8
    with pytest.raises(IndexError):
        coded.select(n)
