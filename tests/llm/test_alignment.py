import hashlib
import random
from collections import Counter
from functools import cache

import pytest
import sentencepiece
from tokenizers import Tokenizer

from confabula.llm.alignment import WordPieces, alignments, op11_token_alignment
from confabula.llm.tokenization import byte_letters, vocabulary

from .helpers import SCHEMA, frame, texts

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@cache
def models():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text):
    """(id, bytes) of both tokenizations, or two empty lists."""
    if not text:
        return [], []
    t, sp = models()
    value = {c: b for b, c in byte_letters().items()}
    a = [(i, bytes(value[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        x = sp.id_to_piece(i)
        b.append((i, bytes([int(x[3:5], 16)]) if sp.is_byte(i) else x.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def expected(rows):
    docs, counts = [], Counter()
    for name, text in rows:
        a, b = tokens(text)
        ends = []
        for own in (a, b):
            at, found = 0, {}
            for i, x in own:
                at += len(x)
                found[at] = i
            ends.append(found)
        links = [(ends[0][k], ends[1][k]) for k in sorted(ends[0]) if k in ends[1]]
        counts.update(links)
        lists, group, at_a, at_b, k = [], ([], []), 0, 0, 0
        for i, x in a:
            at_a += len(x)
            group[0].append(str(i))
            while k < len(b) and at_b + len(b[k][1]) <= at_a:
                at_b += len(b[k][1])
                group[1].append(str(b[k][0]))
                k += 1
            if at_a == at_b:
                lists.append(",".join(group[0]) + "|" + ",".join(group[1]))
                group = ([], [])
        docs.append((name, len(a), len(b), len(lists), links, ";".join(lists)))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(((i, n_a, n_b, n_g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(told.encode()).hexdigest() if n_a else "", told) for i, n_a, n_b, n_g, links, told in docs), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df, *more):
    return sorted(map(tuple, df.select(*COLUMNS, *more).collect()), key=str)


ODD = ["<|endoftext|> <s></s>", "a▁b", "▁", " ", "  ", "\n", " \n ", "\n\n x", "x \n\n", "<0x41>", "\t tab\r\nline", "\x00 null", "ﬁ ① é é", "漢字かな 한국어", "👩‍👩‍👧 emoji", "　wide space", "word" * 600, "a" * 3000 + " b", "end. "]


def test_documents_are_those_of_the_plain_tokenizers(spark):
    rng = random.Random(4)
    letters = "ab \n\t.,é漢▁'12<>s|"
    strings = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    rows = texts(2, 30) + list(enumerate(ODD + strings, 1000)) + [(None, "no id"), (5, "again"), (5, "again")]
    df = alignments(frame(spark, rows).repartition(5), A, B, groups=True)
    assert got(df, "groups") == expected(rows)


def test_query_on_test_data(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(op11_token_alignment(spark, sf_dir)) == [x[:-1] for x in expected(rows)]


@pytest.mark.parametrize("cuttable", [True, False])
def test_units_give_the_ids_of_whole_texts(cuttable):
    own = WordPieces(B)
    assert own.cuttable
    own.cuttable = cuttable
    for x in ODD:
        assert own.ids(x).tolist() == models()[1].encode(x)


def test_empty_table_nulls_and_clashing_names(spark):
    assert got(alignments(spark.createDataFrame([], SCHEMA), A, B)) == []
    docs = frame(spark, [(1, None), (2, ""), (3, "▁")]).toDF("doc_id", "text", "n_a", "links", "n")
    assert got(alignments(docs, A, B)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]
