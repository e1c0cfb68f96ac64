"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte is removed if a string of a given length (400 bytes by default) that covers it also starts anywhere else. Strings
are judged on the input. Repeats of a second, shorter length can be reported from the same sort.

Sorting a suffix for every byte is not needed to decide this. With base the shorter length, every start p of a string of
base bytes is given an anchor: of the next base * 2 / 3 eight-byte words the one with the least hash, the first of them if
equal. The choice depends on nothing but the string, so equal strings have their anchors at the same distance, and starts
that share an anchor form one range. Two equal strings therefore have anchors with the same suffix for base / 3 + 1 bytes
at least, the prefix; it is these suffixes, about one for each base / 3 bytes, that are sorted:

1. Fingerprints of the prefix at every anchor are counted; suffixes whose fingerprint is unique can't have a partner and
   go no further (only false partners can pass, and the sort finds them out). A fingerprint that is very frequent is
   spread over many tasks when the rows are marked.
2. Each task sorts what is left of its documents into runs of bounded size. An entry is the text from the anchor to the
   end of the last string of its range, then the text before the anchor backwards to the first. Equal entries collapse,
   so a run has a text once however many copies there are. Runs are front-coded (length of the prefix shared with the
   entry before, and the rest) and cut by fingerprint, so that entries with a common prefix meet in one task.
3. There the runs are merged with a loser tree that carries the common prefix of each candidate with the last entry put
   out: candidates with different common prefixes are decided by those, others compare from the known prefix on.
4. Neighbours in the merged order that share the prefix form a group. An entry that came at least twice is repeated as a
   whole. Where entries differ, their strings at equal distance from the anchor are compared by 64-bit hashes (two
   different strings pass for equal with a chance of about 2 ** -60; all else is compared byte by byte).
5. A prefix that occurs more than HOT times would gather too many entries in one task. Its entries stay in their run,
   which counts the hashes of their strings; what isn't decided there is counted by Spark, partially first.
6. The outcome goes back to run and entry number, and from there to the documents, whose places never left their run.

Defined cases: a null text is empty; texts shorter than the string length lose nothing; a text of any length is worked
through whole, in overlapping pieces; equal rows are copies of each other, so both lose what is at least that long; ids
must be integers and may be null or repeated (rows are told apart by id and text); an empty table gives an empty result;
columns of the documents that have the name of a result column are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OFTEN, bounded_batches, discard, packed, slices, stored, table, tidied, utf8
from .hashing import Substrings, mix
from .id_filter import id_bitmap, keep_ids

SPAN = 400
#: Bytes of a passage of about fifty short words.
PASSAGE = 240
#: A prefix with more occurrences than this is counted by Spark and not merged in one task.
HOT = 20_000
#: Tasks among which the rows of a hot prefix are spread.
SPREAD = 64
#: Bytes of entries in a run, and entries that a merging task should get.
RUN_BYTES = 16 << 20
ENTRIES = 30_000
#: Parts that a merging task works through one after the other, where there are more parts than shuffle partitions.
PARTS_A_TASK = 8
#: Bytes of a document that are looked at together; longer ones are taken in overlapping pieces.
PIECE = 4 << 20

_ODD = np.uint64(0xD1342543DE82EF95)
_PLACE = np.uint64((1 << 30) - 1)


@dataclass(frozen=True)
class Lengths:
    """The string lengths looked for; the first is the one that is removed."""

    sizes: tuple[int, ...]

    @property
    def base(self) -> int:
        return min(self.sizes)

    @property
    def longest(self) -> int:
        return max(self.sizes)

    @property
    def choices(self) -> int:
        """Eight-byte words among which an anchor is chosen; the rest of the base is the prefix that partners must share."""
        return self.base * 2 // 3

    @property
    def prefix(self) -> int:
        return self.base - self.choices + 1


def anchors(data: np.ndarray, bounds: np.ndarray, of: Lengths) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last start, anchor and prefix fingerprint of every range of starts in packed rows of under 2**30 bytes."""
    n, base, choices = len(data), of.base, of.choices
    valid = np.zeros(n + 1, np.int32)
    sizes = np.diff(bounds)
    long = sizes >= base
    np.add.at(valid, bounds[:-1][long], 1)
    np.add.at(valid, bounds[1:][long] - base + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    words = np.ndarray((n,), "<u8", data.tobytes() + bytes(8), 0, (1,)) * _ODD
    least = ((words ^ words >> np.uint64(32)) * _ODD & ~_PLACE) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= choices:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - choices + 1], least[choices - width :])
    at = (least[starts] & _PLACE).astype(np.int64)
    new = np.flatnonzero((at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new - 1, [len(starts) - 1]])
    low, high, at = starts[first], starts[last], at[first]
    return np.searchsorted(bounds, low, "right") - 1, low, high, at, Substrings(data).hash(at, at + of.prefix).view(np.int64)


def ranges(data: np.ndarray, bounds: np.ndarray, of: Lengths) -> Iterator[tuple[np.ndarray, ...]]:
    """anchors() of packed rows; a row longer than PIECE is taken in pieces that overlap by a string."""
    if len(data) <= PIECE:
        yield anchors(data, bounds, of)
        return
    for row in range(len(bounds) - 1):
        a, b = int(bounds[row]), int(bounds[row + 1])
        for at in range(a, max(a + 1, b - of.base + 1), PIECE):
            part = data[at : min(b, at + PIECE + of.base - 1)]
            rows, low, high, anchor, prefix = anchors(part, np.array([0, len(part)]), of)
            yield rows + row, low + at, high + at, anchor + at, prefix


def row_id(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id), F.col(text))


def _fingerprints(of: Lengths):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                ids = batch.column("rid").to_numpy()
                for rows, _, _, _, prefix in ranges(*packed(batch.column("text")), of):
                    yield pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(ids[rows])], ["prefix", "rid"])

    return run


def shared_prefix(x: bytes, y: bytes, start: int = 0) -> int:
    """Bytes that x and y have in common from their beginning; they agree up to start."""
    n = min(len(x), len(y))
    a, b = x[start:n], y[start:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


class Chunk:
    """Front-coded entries of a run in order: shared prefix, length of the rest, bytes after the anchor, starts, copies (2: more), number."""

    def __init__(self) -> None:
        self.heads: list[tuple[int, int, int, int, int, int]] = []
        self.rest: list[bytes] = []
        self.last = b""

    def add(self, entry: bytes, right: int, starts: int, copies: int, number: int) -> None:
        same = shared_prefix(self.last, entry)
        self.heads.append((same, len(entry) - same, right, starts, copies, number))
        self.rest.append(entry[same:])
        self.last = entry

    def coded(self) -> tuple[bytes, bytes]:
        return np.array(self.heads, "<i4").tobytes(), pa.compress(b"".join(self.rest), "zstd", asbytes=True)


def decoded(heads: bytes, rest: bytes) -> Iterator[tuple[int, bytes, int, int, int, int]]:
    last, at, rows = b"", 0, np.frombuffer(heads, "<i4").reshape(-1, 6)
    rest = pa.decompress(rest, int(rows[:, 1].sum()), "zstd", asbytes=True)
    for same, more, right, starts, copies, number in rows.tolist():
        last = last[:same] + rest[at : at + more]
        at += more
        yield same, last, right, starts, copies, number


class LoserTree:
    """Merges sorted sequences of (shared prefix with the one before, entry, ...) without comparing known prefixes again."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources = sources
        self.size = 1 << max(0, (len(sources) - 1).bit_length())
        self.heads: list[tuple | None] = [next(s, None) for s in sources] + [None] * (self.size - len(sources))
        self.same = [0 if h else -1 for h in self.heads]  # shared with the last entry put out; -1: exhausted
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            winners[node], self.losers[node] = self.play(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1] if self.size > 1 else 0

    def play(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix is with the winner afterwards."""
        a, b = self.same[i], self.same[j]
        if a != b:
            return (i, j) if a > b else (j, i)
        if a < 0:
            return i, j
        x, y = self.heads[i][1], self.heads[j][1]
        n = shared_prefix(x, y, a)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            self.same[j] = n
            return i, j
        self.same[i] = n
        return j, i

    def __iter__(self) -> Iterator[tuple[int, int, tuple]]:
        """(shared prefix with the entry before, source, entry) in order."""
        while (head := self.heads[self.winner]) is not None:
            i = self.winner
            yield self.same[i], i, head
            self.heads[i] = new = next(self.sources[i], None)
            self.same[i] = new[0] if new else -1
            node = (self.size + i) >> 1
            while node:
                i, self.losers[node] = self.play(i, self.losers[node])
                node >>= 1
            self.winner = i


class Windows:
    """The strings of differing entries, and how often each is there."""

    def __init__(self, entries: list[tuple[bytes, int, int, int]], size: int, groups: list[int] | None = None):
        """entries: text (after the anchor, then backwards before it), bytes after the anchor, starts, copies."""
        texts = [entry[right:][::-1] + entry[:right] for entry, right, _, _ in entries]
        data = np.frombuffer(b"".join(texts), np.uint8)
        length = np.array([len(x) for x in texts], np.int64)
        starts = np.array([x[2] for x in entries], np.int64)
        weight = np.array([min(2, x[3]) for x in entries], np.int64)
        n = np.maximum(0, np.minimum(starts, length - size + 1))
        self.owner = np.repeat(np.arange(len(n)), n)
        self.inside = np.arange(len(self.owner)) - (np.cumsum(n) - n)[self.owner]
        at = (np.cumsum(length) - length)[self.owner] + self.inside
        self.keys = Substrings(data).hash(at, at + size)
        if groups is not None:
            left = length - np.array([x[1] for x in entries], np.int64)
            self.keys = self.keys ^ mix((left[self.owner] - self.inside + (np.array(groups, np.int64)[self.owner] << 16)).astype(np.uint64))
        order = np.argsort(self.keys)
        keys = self.keys[order]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.twice = np.zeros(len(keys), bool)
        if len(keys):
            times = np.add.reduceat(weight[self.owner[order]], edge)
            self.twice[order] = np.repeat(times > 1, np.diff(np.concatenate([edge, [len(keys)]])))

    def repeated(self) -> np.ndarray:
        """Rows (entry, first, last): the maximal ranges of starts that came twice or more."""
        new = self.inside == 0
        begin = np.flatnonzero(self.twice & (new | ~np.concatenate([[False], self.twice[:-1]])))
        end = np.flatnonzero(self.twice & ~np.concatenate([self.twice[1:] & ~new[1:], [False]])) if len(new) else begin
        return np.stack([self.owner[begin], self.inside[begin], self.inside[end]], axis=1)


def whole_range(length: int, starts: int, size: int) -> int:
    """How many strings of the size start in an entry."""
    return max(0, min(starts, length - size + 1))


def sorted_runs(parts: int, of: Lengths):
    """Map side: documents with their repeated fingerprints -> rows of RUNS: chunks (for each run and part), places (for each
    run and document), and of the entries of hot prefixes what is repeated in the run, and the hashes of the other strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 24, 0
        entries: list[tuple[bytes, int, int, int, int, bool]] = []  # entry, bytes after the anchor, starts, document here, first start, hot
        docs: list[tuple[int, int | None]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            entries.sort()
            chunks: dict[int, Chunk] = {}
            places: dict[int, tuple[list[int], list[int]]] = {}
            hot: list[tuple[bytes, int, int, int]] = []
            numbers: list[int] = []
            i = count = 0
            while i < len(entries):
                entry, right, starts = entries[i][:3]
                j = i
                while j < len(entries) and entries[j][1] == right and entries[j][2] == starts and entries[j][0] == entry:
                    nos, lows = places.setdefault(entries[j][3], ([], []))
                    nos.append(count)
                    lows.append(entries[j][4])
                    j += 1
                if entries[i][5]:
                    hot.append((entry, right, starts, j - i))
                    numbers.append(count)
                else:
                    part = int.from_bytes(hashlib.blake2b(entry[: of.prefix], digest_size=8).digest(), "little") % parts
                    chunks.setdefault(part, Chunk()).add(entry, right, starts, min(2, j - i), count)
                i, count = j, count + 1
            rows = [{"run": number, "part": part} | dict(zip(("heads", "rest"), c.coded(), strict=True)) for part, c in chunks.items()]
            rows += [{"run": number, "rid": docs[d][0], "doc_id": docs[d][1], "entries": places[d][0], "firsts": places[d][1]} for d in places]
            if hot:
                no = np.array(numbers, np.int64)
                for size in of.sizes:
                    w = Windows(hot, size)
                    found, once = w.repeated(), np.flatnonzero(~w.twice)
                    twice = np.unique(w.keys[w.twice]).view(np.int64)
                    for at in range(0, len(found), 50_000):
                        own = found[at : at + 50_000]
                        rows.append({"run": number, "size": size, "entries": no[own[:, 0]], "firsts": own[:, 1], "lasts": own[:, 2]})
                    for at in range(0, len(once), 50_000):
                        own = once[at : at + 50_000]
                        rows.append({"run": number, "size": size, "entries": no[w.owner[own]], "firsts": w.inside[own], "keys": w.keys[own].view(np.int64)})
                    for at in range(0, len(twice), 50_000):
                        rows.append({"run": number, "size": size, "keys": twice[at : at + 50_000]})
            for at in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows[at : at + 256]], kind) for c, kind in _RUNS.items()], list(_RUNS))
            number, held = number + 1, 0
            entries.clear()
            docs.clear()

        for whole in batches:
            for batch in slices(whole):
                data, bounds = packed(batch.column("text"))
                ids, names = batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist()
                wanted = [np.array(x, np.int64) for x in batch.column("prefixes").to_pylist()]
                often = np.unique(np.concatenate([np.array(x, np.int64) for x in batch.column("hot").to_pylist()]))
                own, base = data.tobytes(), len(docs)
                docs += zip(ids, names, strict=True)
                for rows, low, high, at, prefix in ranges(data, bounds, of):
                    edges = np.searchsorted(rows, np.arange(len(wanted) + 1))
                    hits = [np.flatnonzero(np.isin(prefix[a:b], w)) + a for a, b, w in zip(edges, edges[1:], wanted, strict=False)]
                    k = np.concatenate(hits) if hits else np.zeros(0, np.int64)
                    hot = np.isin(prefix[k], often)
                    for r, a, b, x, h in zip(rows[k].tolist(), low[k].tolist(), high[k].tolist(), at[k].tolist(), hot.tolist(), strict=True):
                        end = min(b + of.longest, int(bounds[r + 1]))
                        entry = own[x:end] + own[a:x][::-1]
                        entries.append((entry, end - x, b - a + 1, base + r, a - int(bounds[r]), h))
                        held += len(entry) + 200
                        if held >= RUN_BYTES:
                            yield from flush()
                            docs += zip(ids, names, strict=True)
                            base = 0
        if entries:
            yield from flush()

    return run


RUNS = "run long, part int, heads binary, rest binary, rid long, doc_id long, size int, entries array<int>, firsts array<long>, lasts array<long>, keys array<long>"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
_RUNS = {x.split()[0]: _ARROW[x.split()[1]] for x in RUNS.split(", ")}


class Groups:
    """Decides which starts of each entry are repeated; groups of differing entries are looked at many at a time."""

    def __init__(self, of: Lengths) -> None:
        self.of = of
        self.found: list[np.ndarray] = []  # rows: run, entry, first and last repeated start, counted from the range's first, and size
        self.entries: list[tuple[bytes, int, int, int]] = []
        self.numbers: list[int] = []
        self.owners: list[list[tuple[int, int]]] = []
        self.held = self.groups = 0

    def add(self, group: dict[tuple[bytes, int, int], list]) -> None:
        """group: (entry, bytes after the anchor, starts) -> [copies, (run, number)...]."""
        if len(group) == 1:
            ((entry, _, starts), (copies, *owners)) = next(iter(group.items()))
            if copies > 1:
                for size in self.of.sizes:
                    if n := whole_range(len(entry), starts, size):
                        self.found.append(np.array([(r, e, 0, n - 1, size) for r, e in owners], np.int64))
            return
        self.groups += 1
        for (entry, right, starts), (copies, *owners) in group.items():
            self.entries.append((entry, right, starts, copies))
            self.numbers.append(self.groups)
            self.owners.append(owners)
            self.held += len(entry)
        if self.held > 1 << 20:
            self.decide()

    def decide(self) -> None:
        if not self.entries:
            return
        for size in self.of.sizes:
            for e, a, b in Windows(self.entries, size, self.numbers).repeated().tolist():
                self.found.append(np.array([(r, n, a, b, size) for r, n in self.owners[e]], np.int64))
        self.entries, self.numbers, self.owners, self.held = [], [], [], 0

    def take(self) -> np.ndarray:
        out = np.concatenate(self.found) if self.found else np.zeros((0, 5), np.int64)
        self.found = []
        return out


def _merge(of: Lengths):
    """Reduce side: chunks sorted by part -> (run, entry, first, last, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Groups(of)

        def merged(chunks: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            group: dict[tuple[bytes, int, int], list] = {}
            for same, source, (_, entry, right, starts, copies, number) in LoserTree([decoded(h, r) for _, h, r in chunks]):
                if same < of.prefix and group:
                    out.add(group)
                    group = {}
                    if len(out.found) > 20_000:
                        yield table_of(out.take())
                own = group.setdefault((entry, right, starts), [0])
                own[0] += copies
                own.append((chunks[source][0], number))
            if group:
                out.add(group)
            out.decide()
            yield table_of(out.take())

        def table_of(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], ["run", "entry", "first", "last", "size"])

        part, chunks = None, []
        for batch in batches:
            for p, number, heads, rest in zip(*(batch.column(c).to_pylist() for c in ("part", "run", "heads", "rest")), strict=True):
                if p != part and chunks:
                    yield from merged(chunks)
                    chunks = []
                part = p
                chunks.append((number, heads, rest))
        if chunks:
            yield from merged(chunks)

    return run


def marked_rows(docs: DataFrame, of: Lengths, hot_at: int) -> DataFrame:
    """A stored table (rid, prefixes, hot): the fingerprints of each row that are there more than once, and those of them that are hot."""
    prints = docs.select("rid", "text").mapInArrow(tidied(_fingerprints(of)), "prefix long, rid long")
    twice = prints.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1")
    twice = stored(twice.select("prefix", (F.col("n") > hot_at).alias("hot"), "n"), "prefixes")
    # a prefix of more than a share of 1 / OFTEN of the rows is spread; there are OFTEN of these at most, so they are broadcast
    limit = (twice.agg(F.sum("n")).first()[0] or 0) / OFTEN
    spread = F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    sides = twice.select("prefix", "hot", F.explode(spread).alias("salt"))
    known = F.broadcast(twice.where(F.col("n") > limit).select("prefix", F.lit(True).alias("often")))
    salted = prints.join(known, "prefix", "left").select("prefix", "rid", F.when(F.col("often"), F.pmod("rid", F.lit(SPREAD))).otherwise(0).cast("int").alias("salt"))
    found = salted.join(sides, ["prefix", "salt"]).groupBy("rid")
    marked = stored(found.agg(F.collect_set("prefix").alias("prefixes"), F.collect_set(F.when(F.col("hot"), F.col("prefix"))).alias("hot")), "marked")
    discard(twice)
    return marked


def repeated_spans(docs: DataFrame, of: Lengths, hot_at: int = HOT) -> DataFrame:
    """docs: (rid, doc_id, text). A stored table (rid, doc_id, spans) of the documents with strings that also start elsewhere; spans: (first, end, size)."""
    again = marked_rows(docs, of, hot_at)
    total = again.agg(F.sum(F.size("prefixes")).alias("n")).first().n or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, math.ceil(total / ENTRIES))
    tasks = max(tasks, math.ceil(parts / PARTS_A_TASK))
    bitmap = id_bitmap(again, "rid")
    texts = keep_ids(docs, "rid", again, bitmap, exact=False).join(again, "rid")
    runs = stored(texts.mapInArrow(tidied(sorted_runs(parts, of)), RUNS), "runs")
    discard(again)
    chunks = runs.where("part is not null").select("part", "run", "heads", "rest").repartition(tasks, "part").sortWithinPartitions("part", "run")
    found = chunks.mapInArrow(tidied(_merge(of)), "run long, entry long, first long, last long, size long")
    hot = runs.where("size is not null")
    local = hot.where("lasts is not null").select("run", "size", F.explode(F.arrays_zip("entries", "firsts", "lasts")).alias("x")).select("run", F.col("x.entries").cast("long"), "x.firsts", "x.lasts", F.col("size").cast("long"))
    once = hot.where("keys is not null AND entries is not null").select("run", F.col("size").cast("long").alias("size"), F.explode(F.arrays_zip("keys", "entries", "firsts")).alias("x")).select("run", "size", F.col("x.keys").alias("key"), F.col("x.entries").cast("long").alias("entry"), F.col("x.firsts").alias("first"))
    often = hot.where("keys is not null AND entries is null").select(F.col("size").cast("long").alias("size"), F.explode("keys").alias("key"), F.lit(2).alias("n"))
    counts = once.select("size", "key", F.lit(1).alias("n")).unionByName(often).groupBy("size", "key").agg(F.sum("n").alias("n")).where("n > 1")
    met = once.join(counts.select("size", "key"), ["size", "key"]).select("run", "entry", "first", F.col("first").alias("last"), "size")
    found = found.union(local).union(met).withColumn("kind", F.lit(0))
    places = runs.where("rid is not null").select("run", "rid", "doc_id", "entries", "firsts", F.lit(1).alias("kind"))
    both = found.unionByName(places, allowMissingColumns=True).repartition(tasks, "run").sortWithinPartitions("run", "kind")
    spans = both.select("run", "kind", "entry", "first", "last", "size", "rid", "doc_id", "entries", "firsts").mapInArrow(tidied(_placed), "rid long, doc_id long, spans array<struct<first: long, end: long, size: int>>")
    out = stored(spans.groupBy("rid", "doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans")), "repeats")
    discard(runs)
    return out


_SIZED = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("size", pa.int32())])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by run, those with repeated starts before the documents of the run -> the byte spans covered in each document."""
    now, parts = None, []
    entry = first = last = size = np.zeros(0, np.int64)
    for batch in batches:
        runs, kinds = batch.column("run").to_numpy(), batch.column("kind").to_numpy()
        edges = np.flatnonzero((runs[1:] != runs[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(runs)], strict=True):
            if runs[a] != now:
                now, parts = runs[a], []
                entry = first = last = size = np.zeros(0, np.int64)
            own = batch.slice(a, b - a)
            if kinds[a] == 0:
                parts.append([own.column(c).to_numpy() for c in ("entry", "first", "last", "size")])
                continue
            if parts:
                entry, first, last, size = (np.concatenate(x) for x in zip(*([entry, first, last, size], *parts), strict=True))
                order, parts = np.argsort(entry, kind="stable"), []
                entry, first, last, size = entry[order], first[order], last[order], size[order]
            lists = own.column("entries")
            doc = np.repeat(np.arange(len(own)), np.diff(np.asarray(lists.offsets)))
            no, low = np.asarray(lists.flatten()).astype(np.int64), np.asarray(own.column("firsts").flatten())
            begin, end = np.searchsorted(entry, no, "left"), np.searchsorted(entry, no, "right")
            n = end - begin
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
            doc, x, y, z = np.repeat(doc, n), np.repeat(low, n) + first[at], np.repeat(low, n) + last[at] + size[at], size[at]
            order = np.lexsort((x, z, doc))
            doc, x, y, z = doc[order], x[order], y[order], z[order]
            group = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (z[1:] != z[:-1]))]) if len(doc) else doc
            reach = np.maximum.accumulate(y + (group << 40)) if len(doc) else y
            new = np.flatnonzero(np.concatenate([[True], x[1:] + (group[1:] << 40) > reach[:-1]])) if len(doc) else doc
            till = reach[np.concatenate([new[1:] - 1, [len(doc) - 1]])] - (group[new] << 40) if len(doc) else y
            spans = pa.StructArray.from_arrays([pa.array(x[new]), pa.array(till), pa.array(z[new].astype(np.int32))], fields=list(_SIZED))
            bounds = np.searchsorted(doc[new], np.arange(len(own) + 1))
            yield pa.RecordBatch.from_arrays([own.column("rid"), own.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans)], ["rid", "doc_id", "spans"])


_RESULT = ["n_bytes", "n_removed", "n_spans", "spans"]
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
RESULT = "n_bytes long, n_removed long, n_spans long, spans array<struct<first: long, end: long>>"
#: With a second length: bytes covered by strings of that length that also start elsewhere, and their runs.
ALSO = ["n_repeated", "n_passages"]


def covered(found: list[dict], size: int) -> list[dict]:
    """The maximal byte ranges that strings of the size cover."""
    spans: list[dict] = []
    for a, b in sorted((s["first"], s["end"]) for s in found if s["size"] == size):
        if spans and a <= spans[-1]["end"]:
            spans[-1]["end"] = max(b, spans[-1]["end"])
        else:
            spans.append({"first": a, "end": b})
    return spans


def _apply(names: list[str], text: str, as_text: bool, of: Lengths):
    kinds = [pa.int64(), pa.int64(), pa.int64(), _SPANS, *[pa.int64()] * (2 * len(of.sizes) - 2), pa.string() if as_text else pa.binary()]
    results = [*_RESULT, *ALSO[: 2 * len(of.sizes) - 2], "kept_text" if as_text else "kept_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, 4 << 20):
                rows = []
                given = batch.column("_spans").to_pylist() if "_spans" in batch.schema.names else [None] * batch.num_rows
                for x, found in zip(utf8(batch.column(text)), given, strict=True):
                    x = x or b""
                    spans, *others = [covered(found or [], size) for size in of.sizes]
                    edges = [0, *(e for s in spans for e in (s["first"], s["end"])), len(x)]
                    kept = b"".join(x[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else x
                    also = [n for o in others for n in (sum(s["end"] - s["first"] for s in o), len(o))]
                    rows.append((len(x), len(x) - len(kept), len(spans), spans, *also, kept.decode(errors="ignore") if as_text else kept))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + columns, [*names, *results])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", as_text: bool = False, span: int = SPAN, also: int | None = None, hot_at: int = HOT) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, the removed byte spans, and kept_bytes; as_text: kept_text, without cut characters.

    span: length in bytes of the strings looked for, 32 at least. also: another length, up to span, whose repeats are reported
    in n_repeated and n_passages and stay in the text.
    """
    if span < 32 or (also is not None and not 32 <= also < span):
        raise ValueError("span is at least 32, also less than span and at least 32")
    of = Lengths((span,) if also is None else (span, also))
    docs = bounded_batches(docs).drop(*[c for c in (*_RESULT, *ALSO[: 2 * len(of.sizes) - 2], "kept_bytes", "kept_text", "_rid", "_id", "_other", "_spans") if c not in (doc_id, text)])
    names = docs.columns
    rows = docs.withColumn("_rid", row_id(doc_id, text)).withColumn("_id", F.col(doc_id).cast("long"))
    long = rows.where(F.octet_length(text) >= of.base).select(F.col("_rid").alias("rid"), F.col("_id").alias("doc_id"), F.col(text).alias("text"))
    spans = repeated_spans(long, of, hot_at).toDF("_rid", "_id", "_spans")
    bitmap = id_bitmap(spans, "_rid")
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [RESULT] + [f"{c} long" for c in ALSO[: 2 * len(of.sizes) - 2]] + ["kept_text string" if as_text else "kept_bytes binary"])
    maybe = keep_ids(rows, "_rid", spans, bitmap, exact=False)
    joined = maybe.join(spans.withColumnRenamed("_id", "_other"), (maybe["_rid"] == spans["_rid"]) & F.col("_id").eqNullSafe(F.col("_other")), "left")
    apply = _apply(names, text, as_text, of)
    never = keep_ids(rows.select(*names, "_rid"), "_rid", spans, bitmap, exact=False, wanted=False, then=apply, schema=types)
    return joined.select(*names, "_spans").mapInArrow(tidied(apply), types).union(never)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), also=PASSAGE)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"), *ALSO)
