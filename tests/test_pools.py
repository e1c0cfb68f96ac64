"""Instance pools of requests: against plain loops, and how the work is spread."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from confabula.operators import tools

INSTANCES = "service long, instance long, developer string, healthy boolean, enabled boolean"
REQUESTS = "request_id long, service long, developer string"
#: Service 1 has instances of its own for dev, none that is usable for "", service 2 only tagged ones, 3 none; 4 is many.
ROWS = [(1, 10, None, None, None), (1, 11, None, True, True), (1, 11, None, True, True), (1, 12, None, False, None), (1, 13, "dev", True, None), (1, None, "", True, True), (2, 20, "dev", None, True), (2, 21, "", None, True), (3, 30, None, True, False), (None, 40, None, True, True)]
MANY = [(4, 100 + i, None, True, True) for i in range(60)]
ASKED = [(i, s, t) for i, (s, t) in enumerate((s, t) for s in (1, 2, 3, 4, None) for t in (None, "dev", "", "x"))] + [(0, 1, "dev"), (7, 4, None)]


def pool(service, developer):
    usable = {(t, i) for s, i, t, h, e in ROWS + MANY if s == service and s is not None and i is not None and h is not False and e is not False}
    return sorted(i for t, i in usable if t is not None and t == developer) or sorted(i for t, i in usable if t is None)


@pytest.mark.parametrize("side", [4096, 7, 1])
def test_each_request_has_its_whole_pool(spark, side):
    got = tools.gray_pool(spark.createDataFrame(ROWS + MANY, INSTANCES), spark.createDataFrame(ASKED, REQUESTS), side).collect()
    assert sorted(map(tuple, got)) == sorted((r, s, i) for r, s, t in ASKED for i in pool(s, t))


def test_one_service_is_work_for_many_tasks(spark):
    asked = spark.range(200).select(F.col("id").alias("request_id"), (F.col("id") % 1 + 4).alias("service"), F.expr("if(id < 0, 'x', null)").alias("developer"))
    got = tools.gray_pool(spark.createDataFrame(MANY, INSTANCES), asked, 20).withColumn("task", F.spark_partition_id())
    shares = [r["count"] for r in got.groupBy("task").count().collect()]
    assert sum(shares) == 200 * 60 and len(shares) > 5 and max(shares) < 200 * 60 / 2


@pytest.mark.parametrize("turn", [0, 1, 5, 1000, -1])
def test_a_request_in_turn_gets_what_it_has_not_tried(spark, turn):
    tried = [(0, 10), (0, 10), (1, 13), (2, 10), (2, 11), (12, 100), (12, 101), (12, 104), (12, 159), (12, 999), (13, 130)]
    known = tools.usable(spark.createDataFrame(ROWS + MANY, INSTANCES))
    asked = tools.pools(known, spark.createDataFrame(ASKED, REQUESTS))
    for seen in ([], tried):
        rest = tools.without_tried(asked, known, spark.createDataFrame(seen, "request_id long, instance long")) if seen else asked
        got = tools.round_robin(rest, known, F.col("request_id") + turn)
        left = [(r, s, [i for i in pool(s, t) if (r, i) not in seen]) for r, s, t in ASKED]
        assert sorted(map(tuple, got.collect())) == sorted((r, s, p[(r + turn) % len(p)]) for r, s, p in left if p)


def test_instances_are_not_copied_into_requests(spark):
    known = tools.usable(spark.createDataFrame(MANY, INSTANCES))
    asked = tools.pools(known, spark.createDataFrame(ASKED, REQUESTS))
    assert asked.columns == ["request_id", "service", "tag", "n"] and {r.n for r in asked.collect()} == {60}
