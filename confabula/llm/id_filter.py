"""A bitmap of fixed size that keeps rows out of a shuffle when their id can't be among those wanted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidied

#: Bits of the bitmap (2 MB). With more ids than bits it lets all rows through and the join alone decides.
BITS = 1 << 24


def _place(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def id_bitmap(ids: DataFrame, key: str, hashed: bool = False) -> np.ndarray:
    """A bit for the hash of every id in the column; at most BITS / 64 rows reach the driver. hashed: ids are hashes already."""
    place = F.col(key).bitwiseAND(F.lit(BITS - 1)) if hashed else _place(key)
    places = ids.where(F.col(key).isNotNull()).select(place.alias("p")).groupBy((F.col("p") / 64).cast("int").alias("w"))
    found = places.agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b")).toArrow()
    bitmap = np.zeros(BITS // 64, np.int64)
    bitmap[found["w"].to_numpy()] = found["b"].to_numpy()
    return bitmap


def among(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be among those of a bitmap made with hashed=True."""
    p = hashes.astype(np.int64) & (BITS - 1)
    return (bitmap[p >> 6] >> (p & 63) & 1).astype(bool)


def keep_ids(rows: DataFrame, key: str, ids: DataFrame, bitmap: np.ndarray | None = None, exact: bool = True, wanted: bool = True, then=None, schema: str | None = None) -> DataFrame:
    """rows whose key may be among ids (a column of that name), by the bitmap; exact: then by a semi-join of what passes.

    wanted=False gives the other rows: those whose key is certainly not among ids. then: a function over the batches that
    are left, to be run in the same worker; schema: what it gives.
    """
    known = bounded_batches(rows).sparkSession.sparkContext.broadcast(id_bitmap(ids, key) if bitmap is None else bitmap)
    names = rows.columns

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("_place").to_numpy(zero_copy_only=False)
            yield batch.select(names).filter(pa.array((known.value[p >> 6] >> (p & 63) & 1).astype(bool) == wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then(passed(batches)) if then else passed(batches)

    types = schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    kept = rows.withColumn("_place", F.coalesce(_place(key), F.lit(0))).mapInArrow(tidied(run), types)
    return kept.join(ids.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_semi").select(names) if exact and wanted else kept


def drop_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows whose key isn't among ids: what the bitmap clears isn't shuffled, the rest goes through an anti-join."""
    bitmap = id_bitmap(ids, key)
    clear = keep_ids(rows, key, ids, bitmap, exact=False, wanted=False)
    return clear.union(keep_ids(rows, key, ids, bitmap, exact=False).join(ids.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti").select(rows.columns))
