"""Near-duplicate classes by MinHash with tensored banding, every link confirmed on the full sets.

A document's set is its distinct shingles (five words by default), as 64-bit hashes; two shingles pass for equal with a
chance of about 2 ** -60. Tensored banding makes many table keys from few minhashes: there are two small collections of
eight sub-keys, each sub-key made from two minhashes, and every pair of a sub-key of the one and a sub-key of the other is
a table key, so 32 minhashes serve 64 tables of four hashes. Two sets of similarity 0.8 share a key with probability
0.9994; sets further alike are missed less often.

1. Sets that are equal are one node, named by the smallest doc_id (pre-aggregated; copies go no further).
2. Keys that only one node has are dropped. In every other bucket each node is paired with the bucket's smallest node.
   Pairs whose sizes or parity bits rule similarity 0.8 out are dropped, which loses nothing (a parity bit tells whether an
   odd number of shingles fall on it: a lower bound of what two sets differ in). Pairs with fewer than LEAST_EQUAL of 32
   equal minhashes are dropped too: of pairs of similarity 0.8 that are about one in a million, fewer above (least_equal=0
   turns this off). What is left
   is confirmed on the texts' full sets.
3. Links give components (alternating large and small stars; every round is written, only counts reach the driver).
4. A bucket whose nodes are not all in one component may still hide a link between two of its other nodes. Its smallest
   node has met all others and leaves; then in each round some nodes of every such bucket meet all its others across
   components, as many as keep a round's comparisons in proportion to its rows (AT_ONCE_A_ROW), and leave. A pair is compared
   in the first bucket it shares only. Large buckets are spread over tasks.

No bucket is expanded into all its pairs at once, none is capped, and every candidate pair across components that step 2
doesn't rule out is confirmed.

Defined cases: null and empty texts, or texts without words, have an empty set and no links; a text of fewer words than a
shingle has all of them as its only shingle; a text of any length is hashed whole; a doc_id that comes with several texts
is classed text by text, but sets whose smallest doc_id is the same one share a class; repeated rows share a class; doc_id
must be an integer, rows with a null one take no part in links and are kept; an empty table gives an empty result; only
the columns of the result are returned, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, packed, slices, stored, table, tidied
from .hashing import LOWER, Substrings, mix, words
from .id_filter import keep_ids

PERCENT = 80
#: Words in a shingle.
WORDS = 5
#: Sub-keys in each of the two collections, and minhashes in a sub-key.
SUBKEYS, HASHES = 8, 2
N_HASHES = 2 * SUBKEYS * HASHES
#: A pair of similarity 0.8 has fewer equal minhashes than this about once in a million.
LEAST_EQUAL = 13
#: Parity bits of a set.
SKETCH = 512
#: Comparisons of minhashes across components in a round, in all or for each row of the open buckets: so many nodes of each bucket meet its others.
AT_ONCE, AT_ONCE_A_ROW = 2_000_000, 500
#: Rows of one bucket, or pairs with one node, that a task should get; more of them are spread.
A_TASK = 10_000

_RNG = np.random.default_rng(424243)
_XOR = _RNG.integers(0, 1 << 63, N_HASHES, np.uint64)
_ODD = _RNG.integers(0, 1 << 63, N_HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_FEW_WORDS = np.uint64(0x5851F42D4C957F2D)
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """The sorted hashes of the shingles (size words) of every row of a packed text column; with fewer words, of all of them as one."""
    data = LOWER[data]
    rows, starts, ends = words(data, bounds)
    h = Substrings(data).hash(starts, ends)
    shingle = h[: max(0, len(h) - size + 1)]
    for k in range(1, size):
        shingle = mix(shingle ^ mix(h[k : k + len(shingle)] * _SECOND))
    first = np.searchsorted(rows, np.arange(len(bounds)), "left")
    out = []
    for i in range(len(bounds) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            out.append(np.unique(shingle[a : b - size + 1]))
            continue
        few = mix(h[a : min(a + 1, b)] ^ _FEW_WORDS)
        for k in range(a + 1, b):
            few = mix(few ^ mix(h[k : k + 1] * _SECOND))
        out.append(few)
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of N_HASHES minima for each set, which must not be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(x) for x in sets[:-1]])
    out = np.empty((len(sets), N_HASHES), np.uint64)
    for i in range(N_HASHES):
        y = (flat ^ _XOR[i]) * _ODD[i]
        y ^= y >> np.uint64(29)
        y *= _ODD[i - 1]
        out[:, i] = np.minimum.reduceat(y, starts)
    return out


def sub_keys(minima: np.ndarray) -> np.ndarray:
    """The sub-keys of both collections for each row, as 32-bit integers."""
    sub = np.zeros((len(minima), 2 * SUBKEYS), np.uint64)
    for i in range(2 * SUBKEYS):
        for k in range(HASHES):
            sub[:, i] = mix(sub[:, i] * _ODD[i] + minima[:, i * HASHES + k] + np.uint64(i))
    return (sub >> np.uint64(32)).astype(np.uint32).view(np.int32)


def planes(minima: np.ndarray) -> np.ndarray:
    """The low byte of every minhash, bit by bit: the first bits of all minhashes, then the second ones and so on, in longs."""
    bits = np.unpackbits((minima & np.uint64(255)).astype(np.uint8)[:, :, None], axis=2)
    return np.packbits(bits.transpose(0, 2, 1).reshape(len(minima), -1), axis=1).view(np.int64)


def parity_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SKETCH bits for each set, in longs: whether an odd number of shingles fall on the bit."""
    bit = (mix(np.concatenate(sets) ^ _SECOND) % np.uint64(SKETCH)).astype(np.int64)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    odd = np.bincount(row * SKETCH + bit, minlength=len(sets) * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), SKETCH), axis=1).view(np.int64)


def table_keys(nodes: DataFrame) -> DataFrame:
    """(node, place, key): SUBKEYS ** 2 table keys for each node, all pairs of a sub-key of the one and of the other collection."""
    placed = nodes.select("node", "sub", F.explode(F.sequence(F.lit(0), F.lit(SUBKEYS * SUBKEYS - 1))).alias("place"))
    return placed.select("node", "place", F.expr(f"xxhash64(sub[place div {SUBKEYS}], sub[{SUBKEYS} + place % {SUBKEYS}], place)").alias("key"))


def signatures(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """Per row of (doc_id, text): n_shingles, two sums that identify the set, its sub-keys, and its sketch.

    The sketch is a byte of each minhash, in planes of bits, and then the parity bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = shingle_sets(*packed(batch.column("text")), size)
                sizes = np.array([len(x) for x in sets], np.int64)
                full = np.flatnonzero(sizes)
                subs, sig, one, two = [None] * len(sets), [None] * len(sets), np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                if len(full):
                    filled = [sets[i] for i in full]
                    minima = minhashes(filled)
                    own = sub_keys(minima)
                    sketch = np.concatenate([planes(minima), parity_sketches(filled)], axis=1)
                    for k, i in enumerate(full):
                        subs[i], sig[i] = own[k], sketch[k]
                        one[i], two[i] = sets[i].sum(dtype=np.uint64).view(np.int64), mix(sets[i] + _SECOND).sum(dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(one), pa.array(two), pa.array(subs, pa.list_(pa.int32())), pa.array(sig, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "one", "two", "sub", "sig"])

    return docs.mapInArrow(tidied(run), "doc_id long, n_shingles long, one long, two long, sub array<int>, sig array<long>")


def alike(a: str, b: str, least_equal: int) -> Column:
    """Whether sizes (n_) and sketches (sig_) of two nodes allow the similarity.

    Two sets differ in no fewer shingles than their parity bits do, so that bound loses nothing. least_equal: equal minhashes
    that a pair must have; 0 drops no pair.
    """

    planes = " | ".join(f"(sig_{a}[{i}] ^ sig_{b}[{i}])" for i in range(N_HASHES // 8))
    others = f"bit_count(({planes} | shiftrightunsigned({planes}, 32)) & {0xFFFFFFFF}L)"
    differ = [f"bit_count(sig_{a}[{i}] ^ sig_{b}[{i}])" for i in range(N_HASHES // 8, N_HASHES // 8 + SKETCH // 64)]
    sizes = f"least(n_{a}, n_{b}) * 100 >= greatest(n_{a}, n_{b}) * {PERCENT}"
    return F.expr(f"{sizes} AND ({' + '.join(differ)}) * {100 + PERCENT} <= (n_{a} + n_{b}) * {100 - PERCENT} AND {others} <= {N_HASHES - least_equal}")


def first_shared(a: str, b: str) -> Column:
    """The place of the first table key that two nodes share: the one bucket in which the pair is compared."""
    def first(start: int) -> str:
        return "CASE " + " ".join(f"WHEN sub_{a}[{start + i}] = sub_{b}[{start + i}] THEN {i}" for i in range(SUBKEYS)) + " END"

    return F.expr(f"{SUBKEYS} * ({first(0)}) + ({first(SUBKEYS)})")


def sized(rows: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """rows with the size, sketch and sub-keys of the node in that column, as n_, sig_ and sub_ columns."""
    return rows.join(nodes.select(F.col("node").alias(node), F.col("n_shingles").alias(f"n_{node}"), F.col("sig").alias(f"sig_{node}"), F.col("sub").alias(f"sub_{node}")), node)


def confirmed(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """A stored table of those of the pairs (a, b, n_a, n_b) of nodes whose full sets are similar enough.

    A node's text becomes its set once for a task and node. Nodes with many pairs (at most one in A_TASK pairs) are spread:
    their text goes to several tasks, each with a share of the pairs.
    """
    likely = stored(pairs, "likely")
    ids = likely.select(F.explode(F.array("a", "b")).alias("doc_id"))
    texts = stored(keep_ids(docs.where("doc_id is not null"), "doc_id", ids), "texts")
    often = likely.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > A_TASK).select("b", F.ceil(F.col("n") / A_TASK).cast("int").alias("shares"))
    often = stored(often, "often")
    salted = likely.join(often, "b", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("a"), F.col("shares")), F.lit(0)).cast("int")).drop("shares")
    kept = texts.toDF("b", "text_b").join(often, "b", "left").select("b", "text_b", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("salt"))
    full = salted.join(texts.toDF("a", "text_a"), "a").join(kept, ["b", "salt"])
    links = stored(full.mapInArrow(tidied(_confirm(size)), "a long, b long").distinct(), "links")
    discard(likely, texts, often)
    return links


def _confirm(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            good = []
            for a, b, n_a, n_b, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "text_a", "text_b")), strict=True):
                if last != (b, text_b):  # rows come sorted by b
                    last, kept = (b, text_b), set_of(text_b, size)
                own = set_of(text_a, size)
                common = len(np.intersect1d(own, kept, assume_unique=True))
                if len(own) == n_a and len(kept) == n_b and 100 * common >= PERCENT * (n_a + n_b - common):
                    good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in good], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def set_of(text: str | None, size: int) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), size)[0]


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link. links: (a, b)."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, stored(small, "edges")
        discard(before)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (now.n, now.s) == state or now.n == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = (now.n, now.s)


def label(members: DataFrame, parts: DataFrame) -> DataFrame:
    return members.join(parts, "node", "left").select("key", "place", "node", F.coalesce("component", "node").alias("component"))


def links_between(nodes: DataFrame, docs: DataFrame, size: int, least_equal: int = LEAST_EQUAL) -> DataFrame:
    """(node, component) for the nodes that have links."""
    keys = table_keys(nodes)
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    members = stored(keys.join(shared, "key").select("key", "place", "node", "pivot"), "buckets")
    pairs = members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = sized(sized(pairs, nodes, "a"), nodes, "b").where(alike("a", "b", least_equal)).select("a", "b", "n_a", "n_b")
    links = confirmed(pairs, docs, size)
    parts = components(links)
    left = members.where("node <> pivot").select("key", "place", "node")
    while True:
        # what a bucket still has to compare: nodes outside the component that most of its remaining nodes are in, with all others
        named = label(left, parts)
        seen = named.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key")
        seen = seen.agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n")).where("most.n < n")
        named = stored(named.join(seen.select("key", F.col("most.component").alias("main"), "n"), "key"), "open")
        outside = named.where("component <> main")
        work = outside.agg(F.count("*").alias("outside"), F.sum("n").alias("pairs")).first()
        if not work.outside:
            return parts
        shares = F.ceil(F.col("n") / A_TASK).cast("int")
        a = outside.select("key", "place", F.col("node").alias("a"), F.col("component").alias("c"), "n")
        b = named.select("key", F.col("node").alias("b"), F.col("component").alias("d"), (F.col("component") != F.col("main")).alias("out"), F.pmod(F.xxhash64("node"), shares).cast("int").alias("salt"))
        rows = named.count()
        each = max(AT_ONCE, AT_ONCE_A_ROW * rows) // rows  # nodes of a bucket that meet its others in this round
        last = work.pairs <= max(AT_ONCE, AT_ONCE_A_ROW * rows)
        if not last:
            # buckets take different nodes, so that a node of many buckets meets many others in one round
            order = Window.partitionBy("key").orderBy(F.xxhash64("key", "a"), "a")
            a = stored(a.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max(1, each)).drop("_rank"), "chosen")
            left = named.select("key", "place", "node").join(a.select("key", F.col("a").alias("node")), ["key", "node"], "left_anti")
        a = a.select("key", "place", "a", "c", F.explode(F.sequence(F.lit(0), shares - 1)).alias("salt"))
        a, b = sized(a, nodes, "a"), sized(b, nodes, "b")
        # of two nodes that both take their turn, one meets the other
        once = ~F.col("out") | (F.col("a") > F.col("b")) if last else F.lit(True)
        met = a.join(b, (a["key"] == b["key"]) & (a["salt"] == b["salt"]) & (F.col("c") != F.col("d")) & once & alike("a", "b", least_equal) & (F.col("place") == first_shared("a", "b")))
        swap = F.col("a") < F.col("b")
        pairs = met.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"), F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"))
        more = confirmed(pairs.toDF("a", "b", "n_a", "n_b").distinct(), docs, size)
        links = links.union(more)
        if more.limit(1).count():
            parts = components(links)
        if last:
            return parts
        left = stored(left, "left")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, least_equal: int = LEAST_EQUAL) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id linked with it, directly or not), kept. size: words in a
    shingle; least_equal: 0 confirms every pair that shares a table key, at the cost of more comparisons of full sets."""
    docs = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(signatures(docs, size), "signatures")
    sets = rows.where("n_shingles > 0 and doc_id is not null").groupBy("one", "two")
    nodes = stored(sets.agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sub").alias("sub"), F.first("sig").alias("sig")), "nodes")
    parts = links_between(nodes, docs, size, least_equal)
    own = rows.select("doc_id", "n_shingles", "one", "two").join(nodes.select("one", "two", "node"), ["one", "two"], "left")
    out = own.join(parts, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("found"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)
