"""Appending, serialising and publishing rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, by: list[str]) -> None:
    """Add rows to a Parquet table partitioned by those columns; without rows nothing is written."""
    if not rows.isEmpty():
        rows.write.mode("append").partitionBy(*by).parquet(path)


def serialised(rows: DataFrame, without: list[str] = ("id",)) -> Column:
    """A row as JSON with its null fields, but for the columns named."""
    return F.to_json(F.struct(*[c for c in rows.columns if c not in without]), {"ignoreNullFields": "false"})


def publisher(path: str, topic: str, failed: Callable[[Exception], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds each row as (topic, value) to a table of messages; a failure is reported and passed over.

    A batch has a folder of its own, so running it again replaces what it wrote before.
    """

    def run(batch: DataFrame, number: int) -> None:
        try:
            batch.select(F.lit(topic).alias("topic"), serialised(batch, []).alias("value")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        except Exception as e:
            failed(e)

    return run
