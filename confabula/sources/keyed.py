"""Tables on disk with one row for each key, of which a change rewrites only the buckets it touches.

Parquet has no MERGE. A keyed table is partitioned by a hash of its key into buckets; upsert and delete find the buckets of the
changed keys, read those alone, and write them again by dynamic partition overwrite. Files of other buckets keep their
names. Changes of one table must not run at the same time. A change that failed half way can be run again: it replaces
whole buckets, and the same change gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import exists, remove

BUCKET = "_bucket"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64, by: list[str] | None = None):
        """buckets: choose it so that a bucket is some 100 MB; by: those of the keys that choose the bucket, so that rows which
        change together are together. Both are fixed for the life of the table."""
        self.spark, self.path, self.schema, self.keys, self.buckets, self.by = spark, path, schema, keys, buckets, by or keys

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self._files().drop(BUCKET)

    def _files(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """Write the table whole, whatever was there before."""
        self._write(rows, "static")

    def apply(self, changed: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the buckets of the keys in changed (the columns of by) by what the operator makes of their rows.

        The operator sees all rows of those buckets and must give rows of those buckets only, as operators do that add, change or
        remove rows of the keys in changed.
        """
        touched = sorted(r[0] for r in changed.select(self.bucket().alias("b")).distinct().collect())  # at most as many as there are buckets
        if not touched:
            return
        there = exists(self.spark, self.path)
        rows = operator(self._files().where(F.col(BUCKET).isin(touched)).drop(BUCKET) if there else self.read())
        if not there:
            return self._write(rows, "static")
        full = {r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()}
        if full:
            self._write(rows, "dynamic")
        for b in set(touched) - full:  # a bucket that loses its last row isn't among those that are overwritten
            remove(self.spark, f"{self.path}/{BUCKET}={b}")
        self.spark.catalog.refreshByPath(self.path)

    def upsert(self, rows: DataFrame, order: list[Column] | None = None) -> None:
        """Rows replace those of their key. Of several new rows of a key the first by order counts."""
        rank = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*(order or [F.lit(0)])))
        new = rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank") if order else rows.dropDuplicates(self.keys)
        self.apply(rows, lambda old: old.join(new.select(self.keys), self.keys, "left_anti").unionByName(new.select(old.columns)))

    def update(self, rows: DataFrame) -> None:
        """As upsert, for keys that are there; others are left out."""
        self.upsert(rows.join(self.read().select(self.keys), self.keys, "left_semi"))

    def delete(self, keys: DataFrame) -> None:
        self.apply(keys, lambda old: old.join(keys.select(self.keys), self.keys, "left_anti"))

    def _write(self, rows: DataFrame, mode: str) -> None:
        placed = rows.withColumn(BUCKET, self.bucket()).repartition(BUCKET)
        placed.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(BUCKET).parquet(self.path)
