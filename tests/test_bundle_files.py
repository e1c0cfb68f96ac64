"""Files of bundles are made by many tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from confabula.sources import bundles, catalog


def test_files_are_not_all_made_where_the_parts_are_read(spark, sf_dir):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        assert catalog.bundle_files(spark, sf_dir).select(F.spark_partition_id().alias("task")).distinct().count() > 1
    finally:
        spark.conf.set(name, before)


def test_whole_documents_are_not_compared_for_the_last_version(spark):
    rows = [("s", v, p, (v + p).encode()) for v in ("1.0", "1.1") for p in ("SKILL.md", "a.md")] + [("s", "1.2", "a.md", b"no document")]
    got = bundles.bundles_of(spark.createDataFrame(rows, "skill_id string, version string, path string, content binary"))
    assert "max_by" not in got._jdf.queryExecution().toString()
    (row,) = got.collect()
    assert (row.version, row.skill_md, [a.object_key for a in row.assets_manifest]) == ("1.1", "1.1SKILL.md", ["skills/s/1.1/a.md"])


def test_no_table_of_files_or_skills_is_broadcast(spark, sf_dir):
    """Few bytes of parts make many files: Spark takes them for small, whatever their number, and each task then holds them all."""
    from confabula.plans import queries

    for name in ("load_skill", "load_asset"):
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_requests_that_may_not_load_are_not_in_one_task(spark):
    from confabula.operators import assets

    skills = spark.createDataFrame([(" 7", "x", "text", [])], "skill_id string, display_name string, skill_md string, assets_manifest array<struct<path: string, object_key: string, kind: string, size_bytes: bigint>>")
    asked = spark.range(400).selectExpr("id AS request_id", "if(id % 2 = 0, ' ', 'a') AS skill_id", "array('b') AS allowed")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        rows = assets.load_skills(asked, skills).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(name, before)
    assert len({r.task for r in rows}) > 1 and len(rows) == 400
    assert all(r.outcome == ("DENIED" if r.request_id % 2 else "MISSING_SKILL_ID") and r.output is None for r in rows)
    assert {r.skill_id for r in rows} == {"", "a"}
