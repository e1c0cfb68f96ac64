"""A training-corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents.

1. quality rules: lines that fail are removed from the text, documents that fail go;
2. MinHash near-dedup over shingles of five words: one row of every class stays, decided by row, so that a doc_id with
   several texts loses only those that another row stands for (rows without a doc_id have no class and stay);
3. suffix-array dedup: passages of about fifty words (240 bytes) that repeat are removed from the texts wherever they are,
   so no copy stays (a text may become empty);
4. benchmark decontamination: documents with a benchmark window go;
5. best-fit packing: the pieces of the documents left, with their places in the sequences.

All but the last return the columns of documents, n_chars being the length of the text as it is then.

Defined cases: null and empty texts fail the quality rules; so do texts of under fifty words. Of equal rows one stays. Texts
of any length are worked through whole. doc_id must be an integer and may be null. An empty table gives an empty result.
Columns beside those of documents are left out, so that their names can't clash with an operator's result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confabula.llm.common import new_path, stored, table
from confabula.llm.decontamination import decontaminate
from confabula.llm.id_filter import drop_ids
from confabula.llm.near_dedup import near_duplicates
from confabula.llm.packing import pack
from confabula.llm.quality_rules import apply_rules
from confabula.llm.suffix_dedup import PASSAGE, remove_repeats
from confabula.llm.tokenization import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = "_row"


def _own(docs: DataFrame) -> DataFrame:
    return docs.select([c for c in COLUMNS if c in docs.columns])


def _with_text(docs: DataFrame, names: list[str], text) -> DataFrame:
    changed = docs.withColumn("text", text)
    return (changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else changed).select(names)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _own(docs)
    judged = apply_rules(docs, clean=True).where("kept")
    return _with_text(judged, docs.columns, F.coalesce("clean_text", "text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of a class stays, the first by doc_id and text. Rows are numbered if a doc_id comes more than once, with one text or several."""
    docs = _own(docs)
    ids = docs.where("doc_id is not null")
    if not ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return drop_ids(docs, "doc_id", near_duplicates(docs).where("not kept").select("doc_id"))
    rows = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    own = rows.where("doc_id is not null").select(ROW, "doc_id", "text")
    found = stored(near_duplicates(own, doc_id=ROW).select(F.col("doc_id").alias(ROW), "component_id"), "classes")
    place = own.select(ROW, F.struct("doc_id", F.xxhash64("text").alias("text"), ROW).alias("place"))
    first = found.join(place, ROW).groupBy("component_id").agg(F.min("place").alias("place")).select(f"place.{ROW}")
    return drop_ids(rows, ROW, found.select(ROW).join(first, ROW, "left_anti")).select(docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _own(docs)
    return _with_text(remove_repeats(docs, as_text=True, span=PASSAGE), docs.columns, F.col("kept_text"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _own(docs)
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Near-dedup, suffix dedup and packing aren't expressible in SQL; tests/llm/test_pipeline.py has a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
