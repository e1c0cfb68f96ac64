import random

import numpy as np
import pytest
import xxhash

from confabula.llm import simhash
from confabula.llm.simhash import fingerprint, near_duplicates, op13_simhash

from .helpers import SCHEMA, frame, texts


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def expected(rows):
    """All pairs of rows with a doc_id."""
    fps = [plain_fingerprint(x) for _, x in rows]
    own = [i for i, (name, _) in enumerate(rows) if name is not None]
    root = {i: i for i in own}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(own):
        for j in own[:k]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[top(i)] = top(j)
    least = {}
    for i in own:
        least[top(i)] = min(least.get(top(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], f"{fps[i]:016x}", least[top(i)] if i in root else None) for i in range(len(rows))), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def near_copies(n=150):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    out = []
    for _ in range(n):
        own = list(words)
        own[rng.randrange(900)] = f"other{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_all_pairs(spark):
    rows = texts(3, 80) + [(i, x) for i, x in enumerate(near_copies(), 500)] + [(3, "one more text"), (None, "one"), (700, "ONEÉ"), (701, "oneé")]
    assert got(near_duplicates(frame(spark, rows).repartition(5))) == expected(rows)


@pytest.mark.parametrize("most", [2, 5])
def test_long_lists_are_read_deeper_and_then_cut_into_blocks(spark, most):
    rows = list(enumerate(near_copies(90)))
    assert got(near_duplicates(frame(spark, rows), most=most)) == expected(rows)


def test_query_on_test_data(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(op13_simhash(spark, sf_dir)) == expected(rows)


def test_index_loses_no_pair():
    """Fingerprints of exactly four different bits share a list at every depth."""
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), 4):
            b ^= 1 << k
        same = [p for p in range(8) if (a ^ b) >> 8 * p & 0xFF == 0]
        for depth in (2, 3, 4):
            assert tuple(same[:depth]) in simhash.position_sets(depth)


def test_links_within_lists_are_all_found():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 12, np.uint64)
    sizes = [1, 2, 40, 300, 3]
    fps = np.concatenate([base[rng.integers(0, 3, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) for n in sizes])
    ends = np.repeat(np.cumsum(sizes), sizes)
    a, b = simhash.near(fps, ends)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, int(ends[i])) if int(fps[i] ^ fps[j]).bit_count() <= 4}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
    member, root = simhash.forest(a, b, len(fps))
    assert set(member.tolist()) == {j for i, j in want} | set(member.tolist())
    assert all(root[k] < member[k] for k in range(len(member)))


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"Word{i % 977}  \n" for i in range(3000)) + " end"
    whole = plain_fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 50)
    assert fingerprint(text.encode()) == whole
    assert fingerprint(b"a" * 500 + b" b") == plain_fingerprint("a" * 500 + " b")


def test_empty_table_and_clashing_names(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = frame(spark, [(1, "a b"), (2, None), (3, "")]).toDF("doc_id", "text", "fp", "component_id", "n")
    assert got(near_duplicates(docs)) == expected([(1, "a b"), (2, None), (3, "")])
