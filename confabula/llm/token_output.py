"""Token-id files: one concatenated array of ids with Elias-Fano coded document boundaries.

Documents are range-partitioned and sorted by id, encoded, and written in segments of about a million ids. A segment
holds its ids in as few bytes as the vocabulary needs and the end of every document as an Elias-Fano sequence: the low
bits of each end packed side by side, the high bits in unary, and the bit place of every 64th one, so that a document's
range is found by two selects that read a few bytes each, without a table of 64-bit offsets. Two numbers locate a
segment in the whole: its partition, whose total is all that the driver sees, and the ids before it in its partition.

Spark writes and reads the files, so they can be in any store that Spark reaches, and a lost task is written again.

Defined cases: a null or empty text is its end id alone; doc_id must be an integer, a null one sorts first; repeated rows
are written as often as they come, rows of one id in the order of a hash of their text; a text of any length is one
document, and one of more ids than a segment is meant to hold fills a segment by itself; an empty table gives no
segments; columns besides id and text are left out, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, slices, table, tidied
from .tokenization import pieces, vocabulary

SEGMENT_IDS = 1 << 20
SAMPLE = 64


class EliasFano:
    """A sorted sequence of n numbers up to universe in about n * (2 + log2(universe / n)) bits."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        low_bits = max(0, int(np.floor(np.log2(max(1, universe) / n))))
        low = np.packbits((values[:, None] >> np.arange(low_bits) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th number (from 0)."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k = i // SAMPLE * 4
        at = int.from_bytes(self.samples[k : k + 4], "little")
        left, byte = i % SAMPLE, at >> 3
        word = int.from_bytes(self.high[byte : byte + 8], "little") >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 8
            word = int.from_bytes(self.high[byte : byte + 8], "little")
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        bit = i * self.low_bits
        low = int.from_bytes(self.low[bit >> 3 : (bit + self.low_bits + 7) >> 3], "little") >> (bit & 7) & ((1 << self.low_bits) - 1)
        return high << self.low_bits | low

    def range(self, i: int) -> tuple[int, int]:
        """Where document i begins and ends, for a sequence of ends."""
        return (self.select(i - 1) if i else 0), self.select(i)


SCHEMA = "part int, first long, n_ids long, doc_ids array<long>, width int, ids binary, low_bits int, low binary, high binary, samples binary"


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encode the whole texts and write the segments to path."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = docs.withColumn("_order", F.xxhash64("text")).repartitionByRange("doc_id", "_order").sortWithinPartitions("doc_id", "_order").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(vocabulary_path)
        width = 2 if known.tokenizer.get_vocab_size() <= 1 << 16 else 4
        part, first = TaskContext.get().partitionId(), 0
        names: list[pa.Array] = []
        coded: list[bytes] = []
        ends: list[np.ndarray] = []
        total = 0

        def segment() -> pa.RecordBatch:
            bounds = EliasFano.of(np.concatenate(ends), total)
            row = [part, first, total, pa.concat_arrays(names).to_pylist(), width, b"".join(coded), bounds.low_bits, bounds.low, bounds.high, bounds.samples]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, _ARROW, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                ids, counts = known.encode(batch.column("text"))
                ids, upto, at, done = ids.astype(f"<u{width}"), np.cumsum(counts), 0, 0
                while at < len(upto):
                    to = min(len(upto), int(np.searchsorted(upto, done + segment_ids - total)) + 1)  # the document that fills the segment is its last
                    names.append(batch.column("doc_id").slice(at, to - at))
                    ends.append(upto[at:to] - done + total)
                    coded.append(ids[done : upto[to - 1]].tobytes())
                    total, done, at = total + int(upto[to - 1]) - done, int(upto[to - 1]), to
                    if total >= segment_ids:
                        yield segment()
                        first += total
                        names, coded, ends, total = [], [], [], 0
        if names:
            yield segment()

    placed.mapInArrow(tidied(run), SCHEMA).write.parquet(path)


_ARROW = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids before it), n_tokens, ids_crc32; ids: also the ids, little-endian unsigned 32-bit."""
    segments = spark.read.schema(SCHEMA).parquet(path)
    base, before = {}, 0
    for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row for each partition written
        base[r.part], before = before, before + r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, first, _, names, width, coded, low_bits, low, high, samples = (batch.column(k)[i].as_py() for k in range(batch.num_columns))
                bounds = EliasFano(len(names), low_bits, low, high, samples)
                start, crcs, starts, sizes, own = base[part] + first, [], [], [], []
                for k in range(len(names)):
                    a, b = bounds.range(k)
                    x = np.frombuffer(coded, f"<u{width}", b - a, a * width).astype("<u4").tobytes()
                    starts.append(start + a)
                    sizes.append(b - a)
                    crcs.append(zlib.crc32(x))
                    own.append(x)
                columns = [pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())] + ([pa.array(own, pa.binary())] if ids else [])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return segments.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return read_tokens(spark, path)
