"""Toxicity and quality: the index against brute force, held-out accuracy, and odd rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from confabula.llm import quality_pu, toxicity

SCHEMA = "doc_id long, text string, label int"


def vectors(n: int, terms: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        t = np.sort(rng.choice(terms, rng.integers(1, 9), replace=False))
        w = rng.random(len(t)) + 0.01
        out.append((i, int(rng.integers(0, 2)), 1.0, t, w / np.sqrt(w @ w)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_block_max_search_finds_what_comparing_with_all_finds(seed, monkeypatch):
    """Over terms with dense and with sparse lists."""
    monkeypatch.setattr(toxicity, "DENSE", 0.1125)
    examples = [(i, y, w, np.where(t < 12, t, t * 7), v) for i, y, w, t, v in vectors(500, 40, seed)]
    index = toxicity.BlockMaxIndex.of(examples, 300)
    assert 0 < index.dense.shape[1] < 40
    dense = np.zeros((len(index.dense) * toxicity.BLOCK, 300))
    by_id = {x[0]: x for x in examples}
    for place, name in enumerate(index.ids):
        dense[place, by_id[name][3]] = by_id[name][4]
    queries = [(np.where(t < 12, t, t * 7), v) for _, _, _, t, v in vectors(60, 40, seed + 100)] + [(np.zeros(0, np.int64), np.zeros(0))]
    without = np.arange(61)
    flat = [np.concatenate(x) for x in zip(*queries, strict=True)]
    places, cosines = index.nearest(np.repeat(np.arange(61), [len(t) for t, _ in queries]), flat[0].astype(np.int64), flat[1], 61, 16, (without, without))
    for (terms, weights), p, c, left_out in zip(queries, places, cosines, without, strict=True):
        query = np.zeros(300)
        query[terms] = weights
        all_ = dense @ query
        all_[left_out] = 0
        assert np.allclose(c, np.sort(all_)[::-1][:16], atol=2e-6)
        assert np.allclose(all_[p[p >= 0]], c[p >= 0], atol=2e-6) and len(set(p[p >= 0])) == min(16, (all_ > 1e-6).sum())


def test_toxicity_query_against_brute_force(spark, sf_dir):
    """The same scores from plain dictionaries: every term, every example, every document."""
    import math
    import zlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    text = {r.doc_id: r.text for r in docs}
    learn = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in text}
    counts = dict(zip(text, toxicity.term_counts(pa.array(list(text.values()), pa.string())), strict=True))
    examples = [i for i in learn if counts[i]]
    terms = sorted({t for i in examples for t in counts[i]})
    factor = dict(zip(terms, toxicity.factors(np.array([learn[i] for i in examples]), [np.array([k for k, t in enumerate(terms) if t in counts[i]]) for i in examples], len(terms)), strict=True))
    importance = {t: (math.log((1 + len(docs)) / (1 + sum(t in x for x in counts.values()))) + 1) * factor[t] for t in terms}

    def unit(i):
        w = {t: (1 + math.log(n)) * importance[t] for t, n in counts[i].items() if t in importance}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    vector = {i: unit(i) for i in text}

    def vote(i, without=None):
        near = sorted(((round(sum(x * vector[e].get(t, 0) for t, x in vector[i].items()), 6), e) for e in examples if e != without), key=lambda x: -x[0])[: toxicity.NEIGHBOURS]
        near = [(c, e) for c, e in near if c > 0]
        w = [1 / (0.05 + max(0, 1 - c)) for c, _ in near]
        return sum(a * learn[e] for a, (_, e) in zip(w, near, strict=True)) / sum(w) if near else None

    raw = [(vote(i, i), learn[i]) for i in examples]
    raw = [(a, b) for a, b in raw if a is not None]
    steps, values = toxicity.rising_fit(np.array([a for a, _ in raw]), np.array([float(b) for _, b in raw]), np.ones(len(raw)))
    rate = sum(learn.values()) / len(learn)
    ties = 0
    for r in toxicity.op3_toxicity(spark, sf_dir).collect():
        own = vote(r.doc_id, r.doc_id)
        want = rate if own is None else float(np.interp(own, steps, values))
        assert all(e.doc_id != r.doc_id and learn[e.doc_id] == e.label for e in r.evidence)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7)
        ties += abs(r.score - want) > 1e-3
    assert ties <= 2  # of examples with the same cosine, other ones may be within the nearest


def test_no_row_votes_on_itself(spark):
    """A label that goes against its text's neighbours changes nothing for the row itself; repeated labelled rows too."""
    docs = rows(spark, "vile")
    labels = docs.select("doc_id", F.when(F.col("doc_id") == 0, 0).otherwise(F.col("label")).alias("label"))
    model, found = toxicity.fit(docs, labels.union(labels.where("doc_id = 0")), label="label")
    out = {r.doc_id: r for r in toxicity.score(found, model).collect()}
    assert out[0].score > 0.5 and all(e.doc_id != i for i, r in out.items() for e in r.evidence)
    assert any(e.doc_id == 0 for r in out.values() for e in r.evidence)


def test_rising_fit_rises_and_keeps_the_mean():
    rng = np.random.default_rng(5)
    x, w = rng.random(200), rng.random(200) + 0.1
    y = (rng.random(200) < x).astype(float)
    centres, values = toxicity.rising_fit(x, y, w)
    assert (np.diff(centres) > 0).all() and (np.diff(values) > 0).all()
    assert 0 <= values[0] and values[-1] <= 1


def rows(spark, bad: str, n: int = 60):
    texts = [(i, f"some {'calm' if i % 2 else bad} words about topic{i % 7} and more", 0 if i % 2 else 1) for i in range(n)]
    return spark.createDataFrame([*texts, (n, None, None), (n + 1, "", None), (None, f"a {bad} text", None), (n + 2, f"{bad} again " * 5000, None)], SCHEMA)


def test_toxicity_over_odd_rows(spark):
    docs = rows(spark, "vile").selectExpr("*", "'x' AS score", "1 AS evidence")
    model, found = toxicity.fit(docs, docs.select("doc_id", "label"), label="label")
    out = {r.doc_id: r for r in toxicity.score(found, model).collect()}
    assert len(out) == 64
    assert out[0].score > 0.7 > out[1].score and out[62].score > 0.7 and out[None].score == pytest.approx(out[0].score, abs=0.3)
    assert out[60].score == out[61].score == 0.5  # no term: the label's rate
    assert out[0].evidence and all(e.label == 1 for e in out[0].evidence)
    assert out[0].score == pytest.approx(out[14].score, abs=1e-4) and out[1].score == pytest.approx(out[15].score, abs=1e-4)  # equal texts
    none, found = toxicity.fit(docs, docs.select("doc_id", "label").where("false"), label="label")
    assert {r.score for r in toxicity.score(found, none).collect()} == {0.0}
    twice = docs.union(docs)
    again, found = toxicity.fit(twice, twice.select("doc_id", "label"), label="label")
    assert toxicity.score(found, again).count() == 128
    assert toxicity.score(toxicity.term_vectors(docs, again.terms), again).count() == 64
    empty = docs.where("false")
    model, found = toxicity.fit(empty, docs.select("doc_id", "label"), label="label")
    assert toxicity.score(found, model).count() == 0


def test_quality_needs_positives_and_scores_empty_texts_zero(spark):
    good = [(i, " ".join(f"Word{j * i % 31} runs well, over there." for j in range(40)), 1) for i in range(40)]
    junk = [(100 + i, "$ # ! buy now now now | x" * (5 + i), None) for i in range(80)]
    docs = spark.createDataFrame([*good, *junk, (500, None, None), (501, " \n ", None), (None, "a b", None)], SCHEMA)
    positives = docs.where("label = 1").select("doc_id")
    model = quality_pu.fit(docs, positives, positives)
    out = {r.doc_id: r.score for r in quality_pu.score(docs.selectExpr("*", "'x' AS score"), model).collect()}
    assert out[500] == out[501] == 0 and all(0 <= x <= 1 for x in out.values())
    assert np.mean([out[i] for i in range(40)]) > 0.7 > 0.3 > np.mean([out[100 + i] for i in range(80)])
    assert {r.score for r in quality_pu.score(docs, quality_pu.fit(docs, positives.where("false"), positives)).collect()} == {0.0}


@pytest.mark.parametrize("low", [False, True])
def test_steps_follow_the_risk(low):
    """Against differences of the risk: down where its second part is positive, and else up that part alone."""
    rng = np.random.default_rng(3)
    z_p, z_u, prior = rng.normal(2 if low else 0, 1, 9), rng.normal(-5 if low else 1, 1, 7), 0.6
    value = lambda a, b: (lambda r: -r[1] if low else r[0] + r[1])(quality_pu.risk(quality_pu.sigmoid(a), quality_pu.sigmoid(b), prior))
    assert (quality_pu.risk(quality_pu.sigmoid(z_p), quality_pu.sigmoid(z_u), prior)[1] < 0) is low
    on_p, on_u = quality_pu.slopes(quality_pu.sigmoid(z_p), quality_pu.sigmoid(z_u), prior)
    step = 1e-6
    for i in range(9):
        assert on_p[i] == pytest.approx((value(z_p + step * np.eye(9)[i], z_u) - value(z_p, z_u)) / step, abs=1e-4)
    for i in range(7):
        assert on_u[i] == pytest.approx((value(z_p, z_u + step * np.eye(7)[i]) - value(z_p, z_u)) / step, abs=1e-4)


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(4)
    positive, negative = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    cuts = quality_pu.cuts_of(positive[:2000])
    for share in (0.2, 0.7):
        n = int(4000 * share)
        mixed = np.concatenate([positive[4000 - n :] if n <= 2000 else rng.normal(2, 1, n), negative[: 4000 - n]])
        counts = np.bincount(np.searchsorted(cuts, mixed, "right"), minlength=len(cuts) + 1)
        assert quality_pu.estimated_prior(positive[:2000], cuts, counts) == pytest.approx(share, abs=0.06)


def test_sampled_rows_stand_for_all(spark, monkeypatch):
    """The shares of weighted rows are those of all rows; and with a small sample the risk that is minimised is about the same."""
    rng = np.random.default_rng(5)
    bins, counts = rng.integers(2, 7, 50), np.array([3, 0, 40, 10, 0, 25, 90, 7])
    weights = quality_pu.standing_for(bins, counts)
    got = np.bincount(bins, weights, minlength=8) / 50
    want = np.array([0, 0, 43, 10, 0, 25, 97, 0]) / counts.sum()
    assert got[[2, 3, 5, 6]].sum() + got[4] == pytest.approx(1) and weights.mean() == pytest.approx(1)
    assert got[2] == pytest.approx(want[2]) and got[6] == pytest.approx(want[6])
    assert quality_pu.standing_for(bins, np.bincount(bins, minlength=8)) == pytest.approx(np.ones(50))
    good = [(i, " ".join(f"Word{j * i % 31} runs well, over there." for j in range(40)), 1) for i in range(40)]
    junk = [(100 + i, "$ # ! buy now now now | x" * (5 + i), None) for i in range(300)]
    docs = spark.createDataFrame(good + junk, SCHEMA)
    positives = docs.where("label = 1").select("doc_id")
    monkeypatch.setattr(quality_pu, "SAMPLE", 30)
    out = {r.doc_id: r.score for r in quality_pu.score(docs, quality_pu.fit(docs, positives, positives)).collect()}
    assert np.mean([out[i] for i in range(40)]) > 0.7 > 0.3 > np.mean([out[100 + i] for i in range(300)])


def test_quality_query_against_plain_python(spark, sf_dir):
    """The same model and scores, without Spark but for the order of the sample."""
    import zlib

    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    about = {r.doc_id: quality_pu.describe(r.text.encode() if r.text else None) for r in rows}
    learnt = {i for i in labels if i in held and not held[i]}
    p = np.array([about[r.doc_id] for r in rows if r.doc_id in learnt and labels[r.doc_id] == 1 and about[r.doc_id]])
    u = np.array([about[r.doc_id] for r in rows if r.doc_id not in learnt and about[r.doc_id]])
    first = quality_pu.train(p[::2], u[::2], None)
    unseen = first.margin(p[1::2])
    cuts = quality_pu.cuts_of(unseen)
    prior = quality_pu.estimated_prior(unseen, cuts, np.bincount(np.searchsorted(cuts, first.margin(u), "right"), minlength=len(cuts) + 1))
    net = quality_pu.train(p, u, prior)
    for r in quality_pu.op4_quality_classifier(spark, sf_dir).collect():
        want = float(net.probability(np.array([about[r.doc_id]]))[0]) if about[r.doc_id] else 0.0
        assert r.score == pytest.approx(want, abs=1e-6) and r.held_out == held[r.doc_id] and r.predicted == (r.score >= 0.7)


def test_quality_of_repeated_rows_ties_and_an_empty_table(spark):
    good = [(i % 20, " ".join(f"Word{j * i % 31} runs well, over there." for j in range(40)), 1) for i in range(40)]
    junk = [(100 + i % 40, "$ # ! buy now now now | x" * (5 + i % 40), None) for i in range(80)]
    docs = spark.createDataFrame([*good, *junk], SCHEMA)
    model = quality_pu.fit(docs, docs.where("label = 1").select("doc_id"), docs.where("label = 1").select("doc_id"))
    rows = quality_pu.score(docs, model).collect()
    assert len(rows) == 120 and len({r.score for r in rows if r.doc_id == 101}) == 1
    assert quality_pu.score(docs.where("false"), model).count() == 0
    none = quality_pu.fit(docs.where("false"), docs.select("doc_id"), docs.select("doc_id"))
    assert {r.score for r in quality_pu.score(docs, none).collect()} == {0.0}


def test_quality_of_a_long_text_and_of_columns_with_names_of_its_own(spark):
    good = [(i, " ".join(f"Word{j * i % 31} runs well, over there." for j in range(40)), 1) for i in range(40)]
    junk = [(100 + i, "$ # ! buy now now now | x" * (5 + i % 40), None) for i in range(80)]
    long = good[7][1]
    docs = spark.createDataFrame([*good, *junk], SCHEMA)
    model = quality_pu.fit(docs, docs.where("label = 1").select("doc_id"), docs.where("label = 1").select("doc_id"))
    more = spark.createDataFrame([(1, " ".join([long] * 2000), 1), (2, " ".join([junk[7][1]] * 5000), None)], SCHEMA)
    for name in ("score", "held_out", "predicted", "margin", "features"):
        more = more.withColumn(name, F.lit(-1))
    got = {r.doc_id: r for r in quality_pu.score(more, model).collect()}
    assert got[1].score > got[2].score and all(0 <= r.score <= 1 and r.margin == -1 for r in got.values())


@pytest.mark.parametrize(("query", "label", "least"), [(toxicity.op3_toxicity, "toxic", 0.85), (quality_pu.op4_quality_classifier, "quality", 0.7)])
def test_held_out_labels_are_told_apart(query, label, least, spark):
    """Share of pairs of a held-out 1 and a held-out 0 that the scores put in order."""
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = query(spark, sf_dir).where("held_out").join(labels, "doc_id").toPandas()
    rank, one = found["score"].rank(), found[label] == 1
    n1, n0 = one.sum(), (~one).sum()
    assert (rank[one].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) >= least
