"""Near-duplicate classes by SimHash, found with an inverted index of byte positions and count filtering.

A text's fingerprint has 64 bits, that is eight bytes at eight positions. Bits in which two fingerprints differ spoil at most
one byte each, so fingerprints that differ in four bits or fewer have at least four bytes in common, position by position.
That is the guaranteed minimum of matches:

1. Texts with the same fingerprint are one node (pre-aggregated; copies go no further).
2. The index has a posting list for the bytes at the first two positions that a pair may share. Of at least four shared
   positions the first is among the first five and the second among the first six, so fifteen lists for each node lose no
   pair. A list of more than LIST nodes is divided by the byte at a third shared position, and by a fourth where it is still
   long: the same index, read deeper where it is dense. A list that is long even with four bytes is cut into blocks, and
   every pair of blocks is a task's share.
3. In a list, or a pair of blocks, the shared bytes of every pair are tallied in numpy; pairs with four or more are kept
   and verified on all 64 bits. What leaves the task is a spanning forest of the verified links, never the pairs.
4. Links give components; a class is named by its smallest doc_id.

Lists are counted by Spark first. Keys of more than a thousandth of the rows (so a thousand of them at most) are joined by
broadcast, others by a shuffle, so that no key's rows meet in one task unless they are few.

Defined cases: null and empty texts, or texts without words, have the fingerprint zero and are linked like any other; a text
of fewer words than a shingle has all of them as its only shingle; texts of any length are hashed piece by piece; repeated
rows have one class; a doc_id with several texts has a row for each, classed by that text; rows with a null doc_id have a
fingerprint, but no class, and take no part in links; an empty table gives an empty result; only the columns of the result
are returned, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, joined, stored, table, tidied, utf8
from .near_dedup import components

WORDS, BITS, SEED = 4, 4, 42
#: Byte positions, and matches that BITS differing bits leave at least.
POSITIONS, MATCHES = 8, 4
#: Nodes in a posting list, or in a block of one, that are compared at once.
LIST = 2048
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20

_SPACE = re.compile(rb"[ \t-\r]")


def _hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 of every run of size words, space-joined."""
    text, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths) + np.arange(len(words))
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    return [xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, size: int = WORDS) -> int:
    """The SimHash of a text, over its shingles with their repeats."""
    counts, n, words, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        words += text[at:end].lower().split()
        if len(words) >= size:
            hashes = np.array(_hashes(words, size), ">u8")
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            n, words = n + len(hashes), words[len(words) - size + 1 :]
        at = end
    if not n:
        return _hashes(words, len(words))[0] if words else 0
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, fp) for every row of (doc_id, text); fp is the fingerprint as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x or b"", size) for x in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(tidied(run), "doc_id long, fp long")


def position_sets(depth: int) -> list[tuple[int, ...]]:
    """What the first depth of at least MATCHES shared positions may be."""
    return [x for x in combinations(range(POSITIONS), depth) if all(p <= POSITIONS - MATCHES + i for i, p in enumerate(x))]


def byte_mask(positions: tuple[int, ...]) -> int:
    """The bytes at these positions, as a signed long."""
    mask = sum(0xFF << 8 * p for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def posted(nodes: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(fp, mask, bytes): a row for each node and set of positions; a list is named by mask and bytes."""
    masks = F.array(*[F.lit(byte_mask(x)).cast("long") for x in sets])
    return nodes.select("fp", F.explode(masks).alias("mask")).withColumn("bytes", F.col("fp").bitwiseAND(F.col("mask")))


def deeper(members: DataFrame, depth: int) -> DataFrame:
    """The rows of long lists of depth positions, in lists of one position more behind their last."""
    more = {byte_mask(x): [byte_mask(y) for y in position_sets(depth + 1) if y[:depth] == x] for x in position_sets(depth)}
    pairs = [(a, b) for a, own in more.items() for b in own]
    known = F.broadcast(members.sparkSession.createDataFrame(pairs, "mask long, next long"))
    out = members.select("fp", "mask").join(known, "mask").select("fp", F.col("next").alias("mask"))
    return out.withColumn("bytes", F.col("fp").bitwiseAND(F.col("mask")))


def tallied(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bytes are equal, position by position, in every pair of a row of x and a row of y (bytes of fingerprints)."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for p in range(POSITIONS):
        out += x[:, p, None] == y[None, :, p]
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for the classes that the links a-b make among n nodes; roots aren't members."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            members = np.flatnonzero(root != np.arange(n))
            return members, root[members]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def near(fps: np.ndarray, ends: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (indexes) within lists that lie one after the other; ends: of its list, for each fingerprint."""
    parts = fps.view(np.uint8).reshape(-1, POSITIONS)
    found_a, found_b = [], []
    left = np.arange(len(fps))
    for shift in range(1, 33):  # neighbours in short lists, of all lists at once
        left = left[left + shift < ends[left]]
        if not len(left):
            break
        matches = (parts[left] == parts[left + shift]).sum(axis=1)
        found_a.append(left[matches >= MATCHES])
        found_b.append(found_a[-1] + shift)
    begins = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]])) if len(fps) else left
    for begin in begins[ends[begins] - begins > 33]:  # longer lists, row by block
        end = int(ends[begin])
        for at in range(int(begin), end, 256):
            a, b = np.nonzero(tallied(parts[at : min(at + 256, end)], parts[at:end]) >= MATCHES)
            later = b > a
            found_a.append(a[later] + at)
            found_b.append(b[later] + at)
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (found_a, found_b))
    verified = np.bitwise_count(fps[a] ^ fps[b]) <= bits
    return a[verified], b[verified]


def compared(lists: DataFrame, names: list[str]) -> DataFrame:
    """(a, b): a spanning forest of the links within each list, whose rows have the same names. Lists are of bounded length."""
    spread = lists.select(*names, "fp").repartition(*names).sortWithinPartitions(*names, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in whole_lists(batches, len(names)):
            edge = np.ones(len(fps), bool)
            edge[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            begins = np.flatnonzero(edge)
            ends = np.append(begins[1:], len(fps))[np.cumsum(edge) - 1]
            member, root = forest(*near(fps, ends), len(fps))
            yield pa.RecordBatch.from_arrays([pa.array(fps[i].view(np.int64)) for i in (member, root)], ["a", "b"])

    return spread.mapInArrow(tidied(run), "a long, b long").distinct()


def whole_lists(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys (a row of n_keys) and fingerprints of sorted batches, regrouped so that no list is cut."""
    keys, fps = np.zeros((0, n_keys), np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        own = np.stack([batch.column(i).to_numpy() for i in range(n_keys)], axis=1)
        keys, fps = np.concatenate([keys, own]), np.concatenate([fps, batch.column(n_keys).to_numpy().view(np.uint64)])
        last = (keys != keys[-1]).any(axis=1) if len(keys) else np.zeros(0, bool)
        at = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if at:
            yield keys[:at], fps[:at]
            keys, fps = keys[at:], fps[at:]
    if len(fps):
        yield keys, fps


def links_between(nodes: DataFrame, most: int = LIST) -> DataFrame:
    """(a, b): links that join all nodes (fp, distinct) which a chain of fingerprints of at most BITS different bits joins."""
    names, depth, links = ["mask", "bytes"], 2, None
    rows = posted(nodes, position_sets(depth))
    while True:
        lists = stored(rows.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1"), "lists")
        members = joined(rows, lists, names, "n", inner=True)
        found = compared(members.where(F.col("n") <= most), names)
        links = found if links is None else links.union(found)
        long = members.where(F.col("n") > most)
        if not lists.where(F.col("n") > most).limit(1).count():
            return links
        if depth == MATCHES:
            blocks = F.ceil(F.col("n") / most).cast("int")
            placed = long.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("long"))
            pairs = placed.select("fp", *names, "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
            pairs = pairs.select("fp", *names, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
            return links.union(compared(pairs, [*names, "low", "high"]))
        rows, depth = stored(deeper(long, depth), "postings"), depth + 1


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, most: int = LIST) -> DataFrame:
    """Per row: doc_id, fingerprint (hexadecimal), component_id (smallest doc_id linked with it, directly or not)."""
    docs = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(fingerprints(docs, size), "fingerprints")
    named = rows.where("doc_id is not null")
    nodes = stored(named.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    parts = components(stored(links_between(nodes.select("fp"), most).distinct(), "links"))
    own = nodes.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    own = stored(own, "members")
    classes = stored(own.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")), "classes")
    classed = joined(own, classes, ["component"], "nodes", inner=True).select("fp", "component_id", "n")
    out = joined(named, stored(classed, "classed"), ["fp"], "n", inner=True).select("doc_id", "fp", "component_id")
    out = out.union(rows.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
