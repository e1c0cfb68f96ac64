"""Structured Streaming forms: usage ledger, hot list, deduplication, windows, ordered finalising of a batch.

Sinks are files in the shared folder; each flow can run until what is there has been read (availableNow) or for good.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..settings import DEFAULTS
from ..sources.keyed import KeyedTable
from ..sources.shared import remove, shared_path


def file_stream(spark: SparkSession, directory: str, name: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files called name below the directory."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(directory)


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, delay: str = "1 hour") -> DataFrame:
    """The events with ts as a timestamp, which a watermark needs."""
    return file_stream(spark, sf_dir, "events.parquet", EVENTS).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def start(flow: DataFrame, mode: str, path: str, each: Callable[[DataFrame, int], None] | None = None, once: bool = True, keys: list[str] | None = None) -> StreamingQuery:
    """Write the flow to path: appended rows as files, a complete result as the whole table of the last batch, an updated one
    into a keyed table, of which a batch rewrites the buckets of its keys (keys: the flow's grouping columns)."""
    writer = flow.writeStream.outputMode(mode).option("checkpointLocation", path + "-progress")
    if once:
        writer = writer.trigger(availableNow=True)
    if mode == "append" and each is None:
        return writer.format("parquet").start(path)
    if mode == "update" and each is None:
        each = merged(path, flow, keys)
    return writer.foreachBatch(each or (lambda batch, _: batch.write.mode("overwrite").parquet(path))).start()


def columns(flow: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flow.schema)


def merged(path: str, flow: DataFrame, keys: list[str] | None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges a batch's rows into a keyed table."""
    if not keys:
        raise ValueError("an updated result needs the keys by which it is merged")
    schema = columns(flow)
    return lambda batch, _: KeyedTable(batch.sparkSession, path, schema, keys).upsert(batch)


def finished(flow: DataFrame, mode: str, name: str) -> DataFrame:
    """The result once all that is there has been read."""
    path = shared_path(flow.sparkSession, name)
    query = start(flow, mode, path)
    query.awaitTermination()
    return flow.sparkSession.read.schema(flow.schema).parquet(path)


def usage_by_user(events: DataFrame) -> DataFrame:
    """Event count and whole-number usage of each user; a streaming or batch frame."""
    return events.groupBy("user_id").agg(F.count("*").alias("n_events"), F.sum(F.floor("value")).cast("long").alias("usage_tokens"))


def usage_by_hour(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n_events")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n_events")


def usage_by_session(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """A session ends when a user does nothing for that long."""
    own = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events"))
    return own.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n_events")


def once_each(events: DataFrame) -> DataFrame:
    """Each event_id once within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


HOT = "user_id long, event_id long, ts timestamp, clock timestamp"


def hot_list_step(path: str, length: int = DEFAULTS.hot_list_length, ttl: str = DEFAULTS.hot_list_ttl) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the newest rows of each user, at most length, as one table for each batch number.

    What it reads and writes is bounded by users times length. Time is that of the rows: the clock stands at the newest row
    seen so far, and a user whose newest row is older than the time to live is dropped. So a batch that is run again writes
    the same table again. The table of the batch before stays for that; older ones are deleted.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("user_id", "event_id", "ts", F.col("ts").alias("clock"))
        if number:
            rows = rows.union(spark.read.schema(HOT).parquet(f"{path}/{number - 1}"))
        now = rows.agg(F.max("clock")).first()[0]
        own = Window.partitionBy("user_id")
        rows = rows.withColumn("clock", F.lit(now).cast("timestamp")).withColumn("_last", F.max("ts").over(own)).where(F.col("_last") >= F.col("clock") - F.expr(ttl)).drop("_last")
        rank = F.row_number().over(own.orderBy(F.desc("ts"), F.desc("event_id")))
        rows.withColumn("_rank", rank).where(F.col("_rank") <= length).drop("_rank").write.mode("overwrite").parquet(f"{path}/{number}")
        if number > 1:
            remove(spark, f"{path}/{number - 2}")

    return run


def hot_lists(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The hot lists after that batch, with rank (1: newest)."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return spark.read.schema(HOT).parquet(f"{path}/{number}").withColumn("rank", rank.cast("long"))


def finaliser(steps: list[tuple[str, Callable[[DataFrame, int], None], bool]], report: Callable[[str, Exception], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that runs the steps in order; a step that may fail is reported and passed over."""

    def run(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name, step, may_fail in steps:
                try:
                    step(kept, number)
                except Exception as e:
                    if not may_fail:
                        raise
                    report(name, e)
        finally:
            kept.unpersist()

    return run


def refreshed(load: Callable[[SparkSession], DataFrame], every: int, clock: Callable[[], float]) -> Callable[[SparkSession], DataFrame]:
    """A dimension for foreachBatch that is loaded again after every seconds (1 at least); on failure the last good one stays."""
    held: dict = {}

    def get(spark: SparkSession) -> DataFrame:
        now = clock()
        if "at" not in held or now - held["at"] >= max(1, every):
            try:
                held["df"] = load(spark)
            except Exception:
                if "df" not in held:
                    raise
            held["at"] = now
        return held["df"]

    return get
