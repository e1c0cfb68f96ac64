import hashlib
import re

import pytest

from confabula.llm import decontamination
from confabula.llm.decontamination import decontaminate, op6_decontamination

from .helpers import SCHEMA, frame, texts


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def digest(df):
    out = []
    for r in df.collect():
        out.append((r.doc_id, r.n_words, r.n_hit, len(r.item_ids), hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(), r.contaminated))
        assert sum(s.end - s.first for s in r.hit_spans) == r.n_hit
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [100_000, 0])
def test_against_all_windows(spark, few, monkeypatch):
    """few 0: windows aren't broadcast; then every word of more than one document counts as frequent."""
    if not few:
        monkeypatch.setattr(decontamination, "OFTEN", 1)
    rows = texts(1)
    long = [t for _, t in rows if t and len(t.split()) > 60]
    items = [(k, " ".join(t.split()[3 : 3 + n]).title()) for k, (t, n) in enumerate(zip(long, [1, 4, 9, 10, 11, 12, 25, 40, 40, 40], strict=False))]
    items += [(50, None), (51, ""), (52, "..."), (53, "two, WORDS!"), (54, "one"), (55, "ab ab ab ab ab ab ab ab ab ab ab ab")]
    found = decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), few=few)
    assert digest(found) == brute(rows, items)


def test_query_on_test_data(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in op6_decontamination(spark, sf_dir).collect()), key=str) == brute(docs, items)


def test_nulls_clashing_columns_and_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [(None, "a b"), (1, None), (1, None), (2, "")]
    docs = frame(spark, rows).selectExpr("*", "1 AS n_hit", "'x' AS item_ids")
    assert digest(decontaminate(docs, none)) == brute(rows, [])
    items = spark.createDataFrame([(None, "A, b")], "item_id long, text string")
    assert [r.item_ids for r in decontaminate(docs, items).collect() if r.contaminated] == [["null"]]
    assert decontaminate(spark.createDataFrame([], SCHEMA), items).count() == 0


def test_long_text_repeated_rows_and_odd_letters(spark):
    filler = " ".join(f"w{k % 977}" for k in range(150_000))
    item = "Ångström ÜBER 12 straße-bahn élan vital x1 y2 z3 q4 r5 s6"
    rows = [(1, filler + " " + item + ". " + filler), (1, item), (1, item), (2, item.replace("x1", "X1!")), (3, item.replace("ÜBER", "über"))]
    items = [(7, item), (8, "q4 r5 s6"), (7, item)]
    assert digest(decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))) == brute(rows, items)
