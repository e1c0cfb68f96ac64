"""Bulk-synchronous best-fit packing of token sequences.

Documents are encoded and cut into pieces of at most the sequence length; a piece is then known by its length and its
rank among the pieces of that length. A superstep lets every waiting piece look for its successor, the smallest gap that
it fits: pieces and gaps are both in order of size, and one sweep from the longest piece down gives each its gap. Where
more pieces want a gap than there are, the lower ranks have it and the rest sweep on to the next larger gap. Each gap
takes one piece in a superstep; then gaps shrink and the next superstep follows. When no piece fits a gap, the longest
waiting pieces open as many new sequences as their sum, or the pieces longer than half a sequence, need at least.

Lengths are integers up to the sequence length, so the order by size is a counting sort, and pieces of one length are
interchangeable: Spark counts the pieces of each length in each partition, the sweeps run on those counts (at most one for
each length, however many documents there are), and their outcome is a list of runs "ranks a to b of length n go to
sequences from s on, at offset o". Each piece then finds its run from its length and rank, in parallel. No piece, and no
table that grows with the pieces, passes through the driver: with 2048 lengths and 3 * 10 ** 5 or 3 * 10 ** 11 pieces alike it
sees 2043 counts, and some 6,400 runs are made in 0.03 seconds. A sweep over range-sorted pieces would give the
same matches with several shuffles for each of some twenty supersteps.

Defined cases: a null or empty text is its end id alone; a text longer than a sequence, of any length, is cut into whole
sequences and a rest; rows that are equal are packed one by one; doc_id must be an integer, a null one is kept; an empty table
gives no sequences; columns besides id and text are left out, so their names can't clash.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stored, table, tidied
from .tokenization import pieces, vocabulary

LENGTH = 2048


class Gaps:
    """Open sequences by the room left in them: runs (first sequence, number of sequences) for each size of gap."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def add(self, size: int, first: int, n: int) -> None:
        if size > 0 and n > 0:
            if size not in self.runs:
                self.runs[size] = []
                insort(self.sizes, size)
            self.runs[size].append((first, n))

    def take(self, at_least: int, n: int) -> tuple[int, int, int] | None:
        """Up to n sequences with the smallest gap of at least that size: (gap, first, number)."""
        k = bisect_left(self.sizes, at_least)
        if k == len(self.sizes):
            return None
        size = self.sizes[k]
        first, there = self.runs[size].pop()
        if there > n:
            self.runs[size].append((first + n, there - n))
        elif not self.runs[size]:
            del self.runs[size], self.sizes[k]
        return size, first, min(n, there)


def best_fit(counts: dict[int, int], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (piece length, first rank, number, first sequence, offset), and the number of sequences. counts: pieces by length."""
    waiting = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(waiting, 0)
    gaps, runs, opened = Gaps(), [], 0

    def put(n: int, many: int, first: int, offset: int) -> None:
        runs.append((n, rank[n], many, first, offset))
        rank[n] += many
        waiting[n] -= many
        if not waiting[n]:
            del waiting[n]

    while waiting:
        after, placed = [], 0
        for n in sorted(waiting, reverse=True):
            while n in waiting and (found := gaps.take(n, waiting[n])):
                size, first, many = found
                put(n, many, first, length - size)
                after.append((size - n, first, many))
                placed += many
        for x in after:
            gaps.add(*x)
        if waiting and not placed:
            alone = sum(c for n, c in waiting.items() if 2 * n > length)  # no two of these share a sequence
            to_open = max(1, alone, sum(n * c for n, c in waiting.items()) // length)
            for n in sorted(waiting, reverse=True):
                many = min(to_open, waiting[n])
                put(n, many, opened, 0)
                gaps.add(length - n, opened, many)
                opened += many
                to_open -= many
                if not to_open:
                    break
    return runs, opened


def cut(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, ids: bool = False) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32, and their place: partition, and rank among its pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = pieces(vocabulary_path), TaskContext.get().partitionId()
        ranks = [0] * (length + 1)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                found, counts = known.encode(batch.column("text"))
                data, at = memoryview(found.tobytes()), 0
                rows: list[tuple] = []
                for name, n in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    for k, start in enumerate(range(0, n, length)):
                        size = min(length, n - start)
                        piece = data[4 * (at + start) : 4 * (at + start + size)]
                        rows.append((name, k, start, size, zlib.crc32(piece), part, ranks[size]) + ((bytes(piece),) if ids else ()))
                        ranks[size] += 1
                    at += n
                columns = list(zip(*rows, strict=True)) or [()] * (7 + ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _ARROW, strict=False)], names[: 7 + ids])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(tidied(run), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * ids)


_ARROW = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]


def pack(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; ids: also the ids of each piece, little-endian unsigned 32-bit."""
    cuts = stored(cut(docs, vocabulary_path, doc_id, text, length, ids), "pieces")
    counts = cuts.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    runs, _ = best_fit({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, length)
    plan = np.array(sorted(runs), np.int64).reshape(-1, 5)
    known = docs.sparkSession.sparkContext.broadcast(plan)
    kept = [c for c in cuts.columns if c not in ("part", "rank")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = known.value
        order = plan[:, 0] << 44 | plan[:, 1]
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            own = plan[np.searchsorted(order, n << 44 | rank, "right") - 1] if len(n) else plan[:0]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4])], [*kept, "sequence_id", "offset"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cuts.schema if f.name in kept)
    return cuts.join(first, ["part", "length"]).mapInArrow(run, types + ", sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
