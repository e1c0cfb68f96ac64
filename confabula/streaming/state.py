"""Flows with state of their own for each key: the delta interpreter, hot lists, and a ledger that counts a batch once.

The state of a key is in the state store (RocksDB), so a batch reads and writes the keys that it has rows for, and nothing
else. Timers on event time clear the state of keys that have been silent for long enough.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.usage import add_to_ledger, ledger
from ..sources.shared import exists, folders
from . import flows

CHUNKS = "message_id long, step int, seq long, ts timestamp, reasoning string, content string, finish_reason string, tool_calls array<struct<index: int, id: string, name: string, arguments: string>>"
LOG = "message_id long, step int, seq long, sub int, event string, delta string"
_Event = Row("message_id", "step", "seq", "sub", "event", "delta")
_Touched = Row("user_id", "n_rows", "dropped")


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """A query that is started inside has its state in RocksDB, which state with timers needs; the session is as before afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def start(flow: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, once: bool = True) -> StreamingQuery:
    """As flows.start, for a flow with keyed state."""
    with keyed_state(flow.sparkSession):
        return flows.start(flow, mode, path, each, once)


def milliseconds(time) -> int:
    return int(time.timestamp() * 1000)


class _Silence:
    """A key's one timer, which each write moves on. The time allowed is the watermark's delay, so a key is due once the watermark
    has passed its newest row; rows that are later than that are left out by Spark."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle
        self.at = handle.getValueState("timer", "at long")

    def move(self, newest_ms: int) -> None:
        before = self.at.get()
        due = max(newest_ms + 1, before[0] if before else 0)
        if not before or due != before[0]:
            if before:
                self.handle.deleteTimer(before[0])
            self.handle.registerTimer(due)
            self.at.update((due,))

    def clear(self) -> None:
        self.at.clear()


def consumed(reasoning_open: bool, text_open: bool, reasoning: str | None, text: str | None) -> tuple[list[tuple[int, str, str | None]], bool, bool]:
    """The events (sub, event, delta) of one chunk, and which kinds are open after it. The first text closes reasoning."""
    out: list[tuple[int, str, str | None]] = []
    if reasoning:
        out += [(0, "reasoning-start", None)] * (not reasoning_open) + [(1, "reasoning-delta", reasoning)]
        reasoning_open = True
    if text:
        if not text_open:
            out += [(2, "reasoning-end", None)] * reasoning_open + [(3, "text-start", None)]
            reasoning_open, text_open = False, True
        out.append((4, "text-delta", text))
    return out, reasoning_open, text_open


class Interpreter(StatefulProcessor):
    """A state machine for each message: open kinds and last seq of each step, and the fragments of its tool calls by index.

    Chunks of a step come in order of seq over the batches, in any order within one; a chunk that comes again is passed
    over. A finish_reason ends the step: what is open is closed, and each call is told with its joined name and arguments and
    its last id. A message that has been silent for longer than the watermark's delay is ended too, and its state dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getMapState("steps", "step int", "reasoning boolean, text boolean, last long, event long, ended boolean")
        self.calls = handle.getMapState("calls", "step int, index int", "id string, name string, arguments string")
        self.silence = _Silence(handle)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest, known, calls = 0, {}, {}
        for r in sorted(rows, key=lambda r: (r.step, r.seq)):
            newest = max(newest, milliseconds(r.ts))
            if r.step not in known:
                known[r.step] = self.steps.getValue((r.step,)) or (False, False, -1, -1, False)
            reasoning, text, last, event, ended = known[r.step]
            if ended or r.seq <= last:
                continue
            events, reasoning, text = consumed(reasoning, text, r.reasoning, r.content)
            for sub, name, delta in events:
                yield _Event(key[0], r.step, r.seq, sub, name, delta)
            for c in r.tool_calls or []:
                at = (r.step, c["index"])
                had = calls.get(at) or self.calls.getValue(at) or ("", "", "")
                calls[at] = (c["id"] or had[0], had[1] + (c["name"] or ""), had[2] + (c["arguments"] or ""))
            known[r.step] = (reasoning, text, r.seq, r.seq if events else event, r.finish_reason is not None)
            if r.finish_reason is not None:
                yield from self.ended(key[0], r.step, known[r.step], calls)
        for step, value in known.items():
            self.steps.updateValue((step,), value)
        for at, value in calls.items():
            self.calls.updateValue(at, value)
        self.silence.move(newest)

    def ended(self, message: int, step: int, state: tuple, calls: dict) -> Iterator[Row]:
        """The events that end a step; its calls leave the state."""
        reasoning, text, last, event, _ = state
        at = event if event >= 0 else last
        if reasoning:
            yield _Event(message, step, at, 5, "reasoning-end", None)
        if text:
            yield _Event(message, step, at, 6, "text-end", None)
        own = {k[1]: v for k, v in self.calls.iterator() if k[0] == step} | {k[1]: v for k, v in calls.items() if k[0] == step}
        for n, index in enumerate(sorted(own)):
            name, value = own[index][1], own[index]
            yield _Event(message, step, at, 7 + n, "tool-input-available", json.dumps({"index": index, "id": value[0], "name": name, "arguments": value[2]}, ensure_ascii=False))
            self.calls.removeKey((step, index))
            calls.pop((step, index), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for step, state in sorted((k[0], tuple(v)) for k, v in self.steps.iterator()):
            if not state[4]:
                yield from self.ended(key[0], step, state, {})
        self.steps.clear()
        self.calls.clear()
        self.silence.clear()


def interpreted(chunks: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """The event log (LOG) of a stream of CHUNKS. idle: event time after which a silent message is ended."""
    return chunks.withWatermark("ts", idle).groupBy("message_id").transformWithState(Interpreter(), LOG, "Append", "EventTime")


class Rolling(StatefulProcessor):
    """The newest rows of each user, at most length, as a list in the state; a user without a row for longer than the watermark's delay is dropped."""

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "at long, event_id long")
        self.silence = _Silence(handle)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = {(int(r.ts.timestamp() * 1_000_000), r.event_id) for r in rows}
        kept = sorted(new | {tuple(x) for x in self.rows.get()}, reverse=True)[: self.length]
        self.rows.put(kept)
        self.silence.move(kept[0][0] // 1000)
        yield _Touched(key[0], len(kept), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.rows.clear()
        self.silence.clear()
        yield _Touched(key[0], 0, True)


def rolling(events: DataFrame, length: int = 50, ttl: str = "24 hours") -> DataFrame:
    """(user_id, n_rows, dropped): a row for each user whose list a batch changed. events: (user_id, event_id, ts)."""
    stream = events.select("user_id", "event_id", "ts").withWatermark("ts", ttl)
    return stream.groupBy("user_id").transformWithState(Rolling(length), "user_id long, n_rows int, dropped boolean", "Update", "EventTime")


def rolling_lists(spark: SparkSession, progress: str) -> DataFrame:
    """(user_id, event_id, ts, rank): the lists as they are in the state of the query with that progress folder."""
    with keyed_state(spark):
        state = spark.read.format("statestore").option("stateVarName", "rows").load(progress)
    rows = state.select(F.col("key.user_id").alias("user_id"), F.col("list_element.event_id").alias("event_id"), F.timestamp_micros("list_element.at").alias("ts"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return rows.withColumn("rank", rank.cast("long"))


class Ledger:
    """Counters by provider and owner as a base table and one table of increments for each batch.

    A batch writes the increments of its own number and its refused amounts, replacing what an earlier attempt wrote, so a batch
    that runs twice counts once. compact() folds increments into a new base; which base and which increments count is in
    the base's own name, so a failure on the way leaves the ledger as it was.
    """

    INCREMENTS = "provider_id long, owner_user_id string, usage_tokens long, billable_usage_tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def create(self, counters: DataFrame) -> None:
        counters.select("provider_id", "owner_user_id", "usage_tokens", "billable_usage_tokens").write.mode("overwrite").parquet(f"{self.path}/base/upto=-1")

    def step(self, batch: DataFrame, number: int) -> None:
        """A foreachBatch function; batch: (provider_id, owner_user_id, usage_tokens, billable_tokens)."""
        _, upto = self._base()
        if number <= upto:
            return  # it is in the base already
        delta = ledger(batch, ["provider_id", "owner_user_id"]).persist()
        try:
            _, refused = add_to_ledger(self._base()[0], delta)
            refused.write.mode("overwrite").parquet(f"{self.path}/refused/batch={number}")
            known = delta.join(refused.select("provider_id", F.col("owner_user_id").alias("_o")), (delta["provider_id"] == refused["provider_id"]) & delta["owner_user_id"].eqNullSafe(F.col("_o")), "left_anti")
            known.write.mode("overwrite").parquet(f"{self.path}/increments/batch={number}")
        finally:
            delta.unpersist()

    def _base(self) -> tuple[DataFrame, int]:
        numbers = [int(x.rpartition("=")[2]) for x in folders(self.spark, f"{self.path}/base")]
        last = max(n for n in numbers if exists(self.spark, f"{self.path}/base/upto={n}/_SUCCESS"))
        return self.spark.read.schema(self.INCREMENTS).parquet(f"{self.path}/base/upto={last}"), last

    def counters(self) -> DataFrame:
        """The base and the increments of later batches, added up."""
        base, upto = self._base()
        if exists(self.spark, f"{self.path}/increments"):
            more = self.spark.read.schema(self.INCREMENTS + ", batch long").parquet(f"{self.path}/increments").where(F.col("batch") > upto)
            base = base.unionByName(more.drop("batch"))
        return base.groupBy("provider_id", "owner_user_id").agg(F.sum("usage_tokens").alias("usage_tokens"), F.sum("billable_usage_tokens").alias("billable_usage_tokens"))

    def refused(self) -> DataFrame:
        return self.spark.read.schema(self.INCREMENTS + ", error string").parquet(f"{self.path}/refused")

    def compact(self, upto: int) -> None:
        """Fold all increments into a new base; upto: the number of the last batch that is done."""
        self.counters().write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")
