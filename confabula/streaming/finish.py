"""What happens to the messages of finished turns: one micro-batch, its steps in order, each with a durable marker.

The batch is first made ready (placeholders in place of output that isn't kept, token counts) and written; all later steps read
that table, so they see the same rows whenever they run. A step that is done leaves a marker for its batch. A batch that failed
half way goes on at its first step without a marker, and each step writes by batch or by key, so a step that ran but left
no marker gives the same when it runs again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators import messages as M
from ..operators import usage as U
from ..sources.keyed import KeyedTable
from ..sources.shared import exists
from ..sources.written import serialised
from .state import Ledger

#: Messages of finished turns, with the turn's user, model and provider (owner null: the system's).
TURNS = """session_id long, pos long, role string, content string, persisted_output_placeholder string, token_count long, ts timestamp,
 user_id string, trace_id string, provider_id long, owner_user_id string, scope string, billing_ratio long, model_name string, model_type long"""
HOT = "session_id long, pos long, role string, content string, token_count long, ts timestamp"
MEMORY = "user_id string, memory string"


class Finisher:
    """report: is told of a step that may fail and did."""

    MAY_FAIL = ("hot_list", "archive", "memory")

    def __init__(self, spark: SparkSession, path: str, report: Callable[[str, Exception], None], length: int = 50):
        self.spark, self.path, self.report, self.length = spark, path, report, length
        self.hot = KeyedTable(spark, f"{path}/hot", HOT, ["session_id", "pos"], 64, ["session_id"])
        self.ledger = Ledger(spark, f"{path}/ledger")
        self.steps = [(s, getattr(self, f"_{s}")) for s in ("prepare", "hot_list", "archive", "memory", "count_usage", "billing")]

    def run(self, batch: DataFrame, number: int) -> None:
        """A foreachBatch function."""
        for name, step in self.steps:
            marker = f"{self.path}/markers/{number}-{name}"
            if exists(self.spark, marker):
                continue
            try:
                step(batch, number)
            except Exception as e:
                if name not in self.MAY_FAIL:
                    raise
                self.report(name, e)
            self._mark(marker)

    def _mark(self, marker: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(marker)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(place, True).close()

    def _prepare(self, batch: DataFrame, number: int) -> None:
        rows = M.redacted(batch)
        rows.withColumn("token_count", token_estimate(F.col("content"), F.col("token_count"))).write.mode("overwrite").parquet(f"{self.path}/prepared/{number}")

    def prepared(self, number: int) -> DataFrame:
        return self.spark.read.schema(TURNS).parquet(f"{self.path}/prepared/{number}")

    def _hot_list(self, batch: DataFrame, number: int) -> None:
        new = self.prepared(number).select("session_id", "pos", "role", "content", "token_count", "ts")

        def newest(old: DataFrame) -> DataFrame:
            rows = old.join(new, ["session_id", "pos"], "left_anti").unionByName(new)
            return M.newest(rows, "session_id", [F.desc("pos")], self.length).drop("rank")

        self.hot.apply(new, newest)

    def _archive(self, batch: DataFrame, number: int) -> None:
        self.prepared(number).write.mode("overwrite").parquet(f"{self.path}/archive/batch={number}")

    def archived(self) -> DataFrame:
        return self.spark.read.schema(TURNS + ", batch long").parquet(f"{self.path}/archive").drop("batch")

    def _memory(self, batch: DataFrame, number: int) -> None:
        own = self.prepared(number).where("role IN ('user', 'assistant') AND content IS NOT NULL")
        own.select("user_id", F.to_json(F.struct("role", "content")).alias("memory")).write.mode("overwrite").parquet(f"{self.path}/memory/batch={number}")

    def memories(self) -> DataFrame:
        return self.spark.read.schema(MEMORY + ", batch long").parquet(f"{self.path}/memory").drop("batch")

    def _usage(self, number: int) -> DataFrame:
        """A row for each turn of the batch."""
        turn = ["user_id", "trace_id", "provider_id", "owner_user_id", "scope", "billing_ratio", "model_name", "model_type"]
        own = U.turn_usage(self.prepared(number).withColumn("_ts", F.col("ts")), turn)
        at = self.prepared(number).groupBy("trace_id").agg(F.max("ts").alias("ts"))
        return U.billed(own).join(at, "trace_id")

    def _count_usage(self, batch: DataFrame, number: int) -> None:
        self.ledger.step(self._usage(number).select("provider_id", "owner_user_id", "usage_tokens", "billable_tokens"), number)

    def _billing(self, batch: DataFrame, number: int) -> None:
        events = U.billing_events(self._usage(number), F.col("ts"))
        events.select(F.lit("token-consumption").alias("topic"), serialised(events, []).alias("value")).write.mode("overwrite").parquet(f"{self.path}/published/batch={number}")

    def published(self) -> DataFrame:
        return self.spark.read.schema("topic string, value string, batch long").parquet(f"{self.path}/published").drop("batch")
