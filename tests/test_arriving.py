"""Streams whose parts are many files."""

from __future__ import annotations

from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from confabula.plans import streams


def test_a_part_is_written_by_many_tasks_and_parts_keep_their_order(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(400).select((F.col("id") % 40).alias("k"), F.col("id").alias("seq"))
        stream = streams.arriving(spark, "parts", [rows.where("seq < 200"), rows.where("seq >= 200")], ["k"], "k long, seq long")
        seen = []
        stream.withColumn("file", F.input_file_name()).writeStream.foreachBatch(lambda batch, _: seen.append(batch.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [sorted(r.seq for r in batch) for batch in seen] == [list(range(200)), list(range(200, 400))]
    for batch in seen:
        files = defaultdict(set)
        for r in batch:
            files[r.k].add(r.file)
        assert all(len(x) == 1 for x in files.values()) and len(set.union(*files.values())) > 1


def test_lifecycle_of_parts_in_many_files(spark, sf_dir):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = streams.lifecycle(spark, sf_dir).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    as_text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert as_text(got) == as_text(db.execute(streams.LIFECYCLE).fetchall())
