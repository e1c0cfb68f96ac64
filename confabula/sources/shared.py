"""Paths in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where the session has none, a local master gets a temporary folder (tests, local
    runs); on a cluster that is an error, as executors wouldn't share it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="confabula-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what is directly below a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [x.getPath().getName() for x in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]


def listed(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """The data files of a table by name, with length and time of the last change."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
    out = {}
    while found.hasNext():
        x = found.next()
        if not x.getPath().getName().startswith(("_", ".")):
            out[x.getPath().toString()] = (x.getLen(), x.getModificationTime())
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that is needed no more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
