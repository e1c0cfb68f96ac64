import corpus_pipeline
from confabula.llm.quality_rules import Rules, judge
from confabula.llm.suffix_dedup import PASSAGE

from . import test_decontamination, test_near_dedup, test_packing, test_suffix_dedup
from .helpers import frame, texts


def kept_text(rows):
    """Brute force of the third stage: the bytes outside all strings of PASSAGE bytes that start twice."""
    marked = test_suffix_dedup.marks(rows, PASSAGE)
    return [(i, bytes(b for b, h in zip(x, hit, strict=False) if not h).decode(errors="ignore")) for (i, _), (x, hit) in zip(rows, marked, strict=True)]


def brute(rows, items):
    step = []
    for i, t in rows:
        found = judge((t or "").encode(), Rules())
        if found["kept"]:
            step.append((i, t if found["clean_text"] is None else found["clean_text"]))
    yield step
    kept = {r[0] for r in test_near_dedup.brute(step, 5) if r[3]}
    step = [(i, t) for i, t in step if i in kept]
    yield step
    step = kept_text(step)
    yield step
    hit = {r[0] for r in test_decontamination.brute(step, items) if r[5]}
    yield [(i, t) for i, t in step if i not in hit]


def check(spark, docs, items, sf_dir):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    names = docs.columns
    for (name, stage), expected in zip(corpus_pipeline.STAGES, brute(rows, items), strict=False):
        out = stage(spark, docs, sf_dir)
        assert out.columns == names
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(expected), name
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted((tuple(r[:5]) for r in got), key=str) == test_packing.expected([(r.doc_id, r.text) for r in docs.collect()])
    test_packing.valid(got)
    return got


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    rows = [(i, t) for i, t in texts(6, 80) if t]
    items = [(1, " ".join(rows[-1][1].split()[5:30])), (2, "nothing of this is there")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    check(spark, frame(spark, rows), items, str(tmp_path))


def test_run_is_the_stages_one_after_the_other(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), items, sf_dir)
    out = corpus_pipeline.run(spark, sf_dir)
    assert sorted(tuple(r[:5]) for r in out.collect()) == sorted(tuple(r[:5]) for r in got)
    assert test_packing.valid(out.collect()) == test_packing.valid(got)


def test_near_dedup_decides_by_row(spark, sf_dir):
    """Repeated rows leave one, and a doc_id with several texts loses only those that another row stands for."""
    words = [f"w{k}" for k in range(300)]
    one, other, third = " ".join(words[:120]), " ".join(words[100:220]), " ".join(words[200:])
    near = one.replace("w60 ", "v60 ")
    rows = [(7, one), (7, one), (7, one), (3, other), (9, other), (9, third), (12, near), (12, third), (12, ""), (12, ""), (None, one)]
    docs = frame(spark, rows)
    out = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(7, one), (3, other), (9, third), (12, ""), (12, ""), (None, one)], key=str)


def test_text_repeated_under_its_own_id_stays_in_the_corpus(spark, sf_dir):
    text = " ".join(f"w{k}" for k in range(200))
    docs = frame(spark, [(7, text), (7, text)])
    for _, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert [(r.doc_id, r.text) for r in docs.collect()] == [(7, text)]


def test_texts_of_one_id_are_classes_of_their_own(spark, sf_dir):
    one, other = (" ".join(f"{c}{k}" for k in range(100)) for c in "ab")
    out = corpus_pipeline.near_dedup(spark, frame(spark, [(5, one), (5, other), (6, other)]), sf_dir)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(5, one), (5, other)]


def test_passages_of_fifty_words_go_and_nulls_and_other_columns_do_no_harm(spark, sf_dir):
    passage = " ".join(f"passage{k}" for k in range(51))
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(80)) + " " + passage + f" end{k}") for k in range(4)]
    docs = frame(spark, [*rows, (None, rows[0][1] + " more"), (9, None), (10, "")]).selectExpr("*", "1 AS kept", "'x' AS spans", "2 AS _row")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(out.collect(), out.schema)
        left = docs.collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [0, 1, 2, 3]
    assert not any("passage25" in r.text for r in left) and all(f"w{r.doc_id}x70" in r.text for r in left if r.doc_id)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name
