"""A token index on disk that follows the writes of its table.

A segment holds the postings of some messages: for a token, a session and a block of positions, the first position and the gaps
to the next ones, in folders by token and sorted by token, so that a search reads few row groups of few folders. Appending
messages adds a segment. Deleting or changing messages adds tombstones, which hide postings of earlier segments. merge() writes
the postings that count as one segment. What belongs to the index is said by its newest manifest, a small table that is
written last, so a change that fails half way changes nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists, folders, listed, remove

#: Folders of a segment, by a hash of the token, and positions in a block (the most postings in one row).
FOLDERS, BLOCK = 64, 256
SEGMENT = "token string, session_id long, block long, first long, gaps array<int>, folder int"
TOMBSTONES = "session_id long, pos long"
MANIFEST = "kind string, name string, number long, size long, time long"


def folder(token: Column) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(FOLDERS)).cast("int")


def coded(postings: DataFrame) -> DataFrame:
    """(token, session_id, pos) -> rows of a segment."""
    blocks = postings.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("token", "session_id", "block").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    gaps = F.transform(F.sequence(F.lit(2), F.size("p")), lambda i: (F.element_at("p", i) - F.element_at("p", i - 1)).cast("int"))
    return blocks.select("token", "session_id", "block", F.element_at("p", 1).alias("first"), F.when(F.size("p") > 1, gaps).otherwise(F.expr("cast(array() as array<int>)")).alias("gaps"), folder(F.col("token")).alias("folder"))


def decoded(segment: DataFrame) -> DataFrame:
    """Rows of a segment -> (token, session_id, pos), by adding up the gaps."""
    start = F.array(F.col("first"))
    positions = F.aggregate("gaps", start, lambda s, g: F.concat(s, F.array(F.element_at(s, -1) + g)))
    return segment.select("token", "session_id", F.explode(positions).alias("pos"))


@dataclass(frozen=True)
class Manifest:
    """number: of the manifest; segments and tombstones: name by the number of the change that made it; files: of the table."""

    number: int
    segments: dict[int, str]
    tombstones: dict[int, str]
    files: dict[str, tuple[int, int]]


class TokenIndex:
    def __init__(self, spark: SparkSession, path: str, tokens: Callable[[Column], Column]):
        self.spark, self.path, self.tokens = spark, path, tokens

    def manifest(self) -> Manifest:
        numbers = [int(x) for x in folders(self.spark, f"{self.path}/manifest")] if exists(self.spark, f"{self.path}/manifest") else []
        done = [n for n in numbers if exists(self.spark, f"{self.path}/manifest/{n}/_SUCCESS")]
        if not done:
            return Manifest(-1, {}, {}, {})
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{max(done)}").collect()
        named = lambda kind: {r.number: r.name for r in rows if r.kind == kind}
        return Manifest(max(done), named("segment"), named("tombstones"), {r.name: (r.size, r.time) for r in rows if r.kind == "file"})

    def _commit(self, at: Manifest) -> None:
        rows = [("segment", x, n, 0, 0) for n, x in at.segments.items()] + [("tombstones", x, n, 0, 0) for n, x in at.tombstones.items()] + [("file", x, 0, *v) for x, v in at.files.items()]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{at.number}")

    def _write(self, postings: DataFrame, name: str) -> None:
        placed = coded(postings).repartition("folder", F.pmod(F.xxhash64("session_id"), F.lit(4)))
        placed.sortWithinPartitions("folder", "token").write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/{name}")

    def _postings(self, messages: DataFrame) -> DataFrame:
        return messages.select(F.explode(F.array_distinct(self.tokens(F.col("content")))).alias("token"), "session_id", "pos")

    def add(self, messages: DataFrame, files: dict[str, tuple[int, int]] | None = None) -> None:
        """Messages that are new: one more segment."""
        old, name = self.manifest(), ""
        number = old.number + 1
        name = f"segment-{number}"
        self._write(self._postings(messages), name)
        self._commit(Manifest(number, old.segments | {number: name}, old.tombstones, old.files | (files or {})))

    def delete(self, ids: DataFrame) -> None:
        """ids: (session_id, pos) of messages that are gone."""
        old = self.manifest()
        number = old.number + 1
        ids.select("session_id", "pos").distinct().write.mode("overwrite").parquet(f"{self.path}/tombstones-{number}")
        self._commit(Manifest(number, old.segments, old.tombstones | {number: f"tombstones-{number}"}, old.files))

    def change(self, messages: DataFrame) -> None:
        """Messages whose content is another now."""
        self.delete(messages)
        self.add(messages)

    def postings(self, words: list[str] | None = None) -> DataFrame:
        """(token, session_id, pos) that count; words: only of these tokens, which choose the folders and reach the scan."""
        at, out = self.manifest(), self.spark.createDataFrame([], "token string, session_id long, pos long")
        for number, name in at.segments.items():
            own = self.spark.read.schema(SEGMENT).parquet(f"{self.path}/{name}")
            if words is not None:
                own = own.where(F.col("folder").isin(sorted({zlib.crc32(w.encode()) % FOLDERS for w in words})) & F.col("token").isin(words))
            own = decoded(own)
            for later in (x for n, x in at.tombstones.items() if n > number):
                own = own.join(self.spark.read.schema(TOMBSTONES).parquet(f"{self.path}/{later}"), ["session_id", "pos"], "left_anti").select("token", "session_id", "pos")
            out = out.union(own)
        return out

    def merge(self) -> None:
        """All postings that count as one segment; folders that belong to no manifest then are deleted."""
        old = self.manifest()
        number = old.number + 1
        self._write(self.postings(), f"segment-{number}")
        self._commit(Manifest(number, {number: f"segment-{number}"}, {}, old.files))
        for name in [*old.segments.values(), *old.tombstones.values()]:
            remove(self.spark, f"{self.path}/{name}")

    def follow(self, table: str, messages: Callable[[DataFrame], DataFrame], most: int = 16) -> None:
        """Bring the index up to the files of a Parquet table: new files become a segment; if a file that was read is gone or
        another now, the index is written anew. Beyond most segments they are merged. messages: makes messages of the table's rows."""
        now, old = listed(self.spark, table), self.manifest()
        new = {x: v for x, v in now.items() if old.files.get(x) != v}
        if set(old.files) - set(now) or any(x in old.files for x in new):
            self._commit(Manifest(old.number + 1, {}, {}, {}))
            new = now
        if new:
            self.add(messages(self.spark.read.parquet(*sorted(new))), new)
        if len(self.manifest().segments) > most:
            self.merge()
