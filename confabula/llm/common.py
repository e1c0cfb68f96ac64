"""Shared plumbing of the training-data operators: shared-folder tables and Arrow batches.

Every operator takes and returns DataFrames. Intermediate tables are written by Spark into the folder named by
``spark.checkpoint.dir``, so that a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets a temporary folder (tests,
    local runs); on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="confabula-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing lazy refers to any more."""
    for df in tables:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


#: A key of more than a share of 1 / OFTEN of the rows is frequent; there are at most so many.
OFTEN = 1000


def joined(rows: DataFrame, values: DataFrame, keys: list[str], n: str, inner: bool = False) -> DataFrame:
    """rows with the columns of values (a row for each key; a null key is one too). n: the column of values with how many of the rows have the key.

    Frequent keys are OFTEN at most, whatever the input's size: their values are broadcast and their rows stay where they are. All
    other keys are joined by a shuffle, in which no key is large. inner: rows without values are left out.
    """
    own = values.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in values.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    added = [c for c in values.columns if c not in keys]
    limit = (values.agg(F.sum(n)).first()[0] or 0) / OFTEN
    often = F.broadcast(own.where(F.col(n) > limit))
    hot = rows.join(often, same).select(*rows.columns, *added)
    rest = rows.join(F.broadcast(own.where(F.col(n) > limit).select([f"_{k}" for k in keys])), same, "left_anti")
    return hot.union(rest.join(own.where(F.col(n) <= limit), same, "inner" if inner else "left").select(*rows.columns, *added))


def remainder(column: str, n: int):
    """crc32 of the id as text, modulo n: the split between learning and held-out rows. A null id has no remainder."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after limiting what is sent to a Python worker at once (session settings, unless they are lower already)."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def tidy() -> None:
    """Give freed memory of this worker back to the system, as workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """A function over Arrow batches that gives memory back when its task ends."""

    def and_tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return and_tidy


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about limit bytes of the column (numpy work takes some hundred times that), at least one row each; rows are never cut."""
    import numpy as np

    n = batch.num_rows
    if not n:
        return
    data = batch.column(batch.schema.get_field_index(column))
    sizes = np.array([len(x) if x is not None else 0 for x in data.to_pylist()]) if data.type not in (pa.string(), pa.binary()) else np.diff(offsets(data))
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def offsets(data: pa.Array):
    """Byte offsets of a string or binary array (numpy, length + 1)."""
    import numpy as np

    if data.buffers()[1] is None:
        return np.zeros(len(data) + 1, np.int64)
    return np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4).astype(np.int64)


def packed(data: pa.Array):
    """A string column as one byte array and the offset of each row in it; nulls count as empty."""
    import numpy as np

    at = offsets(data)
    if data.null_count:
        rows = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in data]
        return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    if at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data.buffers()[2], np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def utf8(data: pa.Array) -> list[bytes | None]:
    return data.cast(pa.binary()).to_pylist()
