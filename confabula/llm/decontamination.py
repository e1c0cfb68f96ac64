"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents, verified exactly.

An item's text is cut into windows of ten consecutive words (a shorter item is one window). A window can only occur in a
document that has all of its words, so it is enough to join on one of them, its necessary prefix:

1. Windows are made by Spark from the distinct items; equal ones are one row with the ids of their items.
2. One pass over the documents counts in how many each word of a window occurs; a bitmap of fixed size keeps other words
   out. The windows' words are ordered by rarity, and the rarest is the window's prefix.
3. A second pass gives a probe for each place of a document where a prefix word may be (again by a bitmap): the words
   around it, as far as a window can reach. Probes and windows are joined on the word's hash. The word's place in the window
   fixes where the window would have to start; starts before the document or ends behind it are dropped (positional and
   length bound), and what is left is compared word by word.
4. Ranges and items come together by document, and a last pass puts them to the documents that have any; all others are
   never shuffled.

Windows are broadcast if there are at most FEW_WINDOWS of them (counted); with more, both sides are shuffled by the word, and
a word with many probes is spread over tasks. Neither items nor counts of words go through the driver.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, after lower-casing A-Z.

Defined cases: a null or empty text has no words and no hits; a text of any length is worked through whole; an item without
words matches nothing; an item id that is null counts as the text ``null``; repeated items and ids count once; equal
documents get equal results; with an empty table of items nothing is hit; columns of the documents that have the name of a
result column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, packed, slices, stored, table, tidied, utf8
from .hashing import LOWER, Substrings, words
from .id_filter import among, id_bitmap, keep_ids

WINDOW = 10
#: Windows that are broadcast at most (about 200 bytes each).
FEW_WINDOWS = 100_000
#: Documents with a word from which on its probes are spread over SPREAD tasks.
OFTEN, SPREAD = 20_000, 64

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and hash of every word of packed rows in lower case."""
    rows, starts, ends = words(data, bounds, _BETWEEN)
    return rows, starts, ends, Substrings(data).hash(starts, ends)


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """items: (item, body). (id, window, hashes, items): the distinct windows with their words, their hashes and the items they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "body"):
                names, found, hashes = [], [], []
                for name, x in zip(batch.column("item").to_pylist(), utf8(batch.column("body")), strict=True):
                    own = _WORD.findall((x or b"").lower())
                    data = np.frombuffer(b" ".join(own), np.uint8)
                    h = word_hashes(data, np.array([0, len(data)]))[3].view(np.int64) if own else []
                    for i in range(max(1, len(own) - size + 1) if own else 0):
                        names.append(name)
                        found.append([w.decode(errors="replace") for w in own[i : i + size]])
                        hashes.append(h[i : i + size])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))], ["item", "window", "hashes"])

    cut = items.mapInArrow(tidied(run), "item string, window array<string>, hashes array<long>")
    one = cut.groupBy("window", "hashes").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return one.select(F.xxhash64("window").alias("id"), "window", "hashes", "items")


def document_frequency(docs: DataFrame, text: str, wanted: np.ndarray) -> DataFrame:
    """(word, n): in how many documents each word, by its hash, occurs, of those that may be in the bitmap."""
    known = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                data, bounds = packed(batch.column(text))
                rows, _, _, h = word_hashes(LOWER[data], bounds)
                kept = among(known.value, h)
                rows, h = rows[kept], h[kept]
                order = np.lexsort((h, rows))
                rows, h = rows[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
                each, n = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return docs.select(text).mapInArrow(tidied(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """The windows that may occur, each with its rarest word (ties: the lesser hash), that word's place and documents."""
    each = windows.select("id", "window", "items", F.posexplode("hashes").alias("place", "word"))
    ranked = each.join(frequency, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = Window.partitionBy("id", "window").orderBy("n", "word", "place")
    return ranked.withColumn("_rank", F.row_number().over(rarest)).where("_rank = 1 AND n > 0").drop("_rank")


def probes(docs: DataFrame, text: str, wanted: np.ndarray, size: int) -> DataFrame:
    """docs: (r1, r2, text). A row for each place of a word that may be in the bitmap: the document, the word's number in it, the
    words around it, and the word's number among these."""
    known = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                data, bounds = packed(batch.column(text))
                data = LOWER[data]
                rows, starts, ends, h = word_hashes(data, bounds)
                at = np.flatnonzero(among(known.value, h))
                if not len(at):
                    continue
                own = data.tobytes()
                first = np.searchsorted(rows, rows[at], "left")
                last = np.searchsorted(rows, rows[at], "right")
                low, high = np.maximum(first, at - size + 1), np.minimum(last, at + size)
                near = [_WORD.findall(own[a:b]) for a, b in zip(starts[low].tolist(), ends[high - 1].tolist(), strict=True)]
                near = [[w.decode(errors="replace") for w in x] for x in near]
                place = pa.array(rows[at])
                columns = [batch.column("r1").take(place), batch.column("r2").take(place), pa.array(h[at].view(np.int64)), pa.array(at - first), pa.array(at - low), pa.array(near, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["r1", "r2", "word", "number", "among", "near"])

    return docs.mapInArrow(tidied(run), "r1 long, r2 long, word long, number long, among long, near array<string>")


def matches(found: DataFrame, windows: DataFrame, few: int) -> DataFrame:
    """(r1, r2, first, end, items): the windows that occur, word by word."""
    windows = windows.select("word", "place", "window", "items", "n")
    if windows.limit(few + 1).count() <= few:
        joined = found.join(F.broadcast(windows), "word")
    else:
        # at most one word in OFTEN documents is frequent; of a frequent word the windows go to every share of its probes
        often = windows.where(F.col("n") > OFTEN).select("word", F.lit(True).alias("often")).distinct()
        salted = found.join(often, "word", "left").withColumn("salt", F.when(F.col("often"), F.pmod(F.xxhash64("r1", "number"), F.lit(SPREAD))).otherwise(0).cast("int")).drop("often")
        shares = F.when(F.col("n") > OFTEN, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
        joined = salted.join(windows.withColumn("salt", F.explode(shares)), ["word", "salt"])
    start = F.col("among") - F.col("place")
    size = F.size("window")
    inside = (start >= 0) & (start + size <= F.size("near"))
    same = F.slice("near", (F.greatest(start, F.lit(0)) + 1).cast("int"), size) == F.col("window")
    first = F.col("number") - F.col("place")
    return joined.where(inside & same).select("r1", "r2", first.alias("first"), (first + size).alias("end"), "items")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_NAMES = ["n_words", "n_hit", "hit_spans", "item_ids", "contaminated"]
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
RESULT = "n_words long, n_hit long, hit_spans array<struct<first: long, end: long>>, item_ids array<string>, contaminated boolean"


def _apply(names: list[str], text: str):
    """Count the words, and put the merged ranges and items to the documents (columns _spans and _items, if there are any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, 4 << 20):
                data, bounds = packed(batch.column(text))
                sizes = np.bincount(words(LOWER[data], bounds, _BETWEEN)[0], minlength=batch.num_rows)
                found = batch.column("_spans").to_pylist() if "_spans" in batch.schema.names else [None] * batch.num_rows
                items = batch.column("_items").to_pylist() if "_items" in batch.schema.names else [None] * batch.num_rows
                spans = [merged([(s["first"], s["end"]) for s in x or ()]) for x in found]
                hits = [sum(b - a for a, b in x) for x in spans]
                columns = [pa.array(sizes.astype(np.int64)), pa.array(hits, pa.int64()), pa.array([[{"first": a, "end": b} for a, b in x] for x in spans], _SPANS), pa.array([x or [] for x in items], pa.list_(pa.string())), pa.array([n > 0 for n in hits], pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + columns, [*names, *_NAMES])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, few: int = FEW_WINDOWS) -> DataFrame:
    """docs with n_words, n_hit, the hit word ranges, the sorted ids of the items found, and contaminated (n_hit > 0)."""
    docs = bounded_batches(docs).drop(*[c for c in (*_NAMES, "_r1", "_r2", "_spans", "_items") if c != text])
    names = docs.columns
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("body")).where("body is not null").distinct()
    windows = stored(windows_of(items, size), "windows")
    frequency = document_frequency(docs, text, id_bitmap(windows.select(F.explode("hashes").alias("word")), "word", hashed=True))
    chosen = stored(prefixes(windows, frequency), "prefixes")
    rows = docs.withColumn("_r1", F.xxhash64(*names)).withColumn("_r2", F.xxhash64(F.lit(1), *names))
    found = probes(rows.select(F.col("_r1").alias("r1"), F.col("_r2").alias("r2"), text), text, id_bitmap(chosen, "word", hashed=True), size)
    hits = matches(found, chosen, few).groupBy("r1", "r2").agg(F.collect_set(F.struct("first", "end")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"))
    hits = stored(hits.select(F.col("r1").alias("_r1"), F.col("r2").alias("_r2"), "_spans", "_items"), "hits")
    bitmap = id_bitmap(hits, "_r1")
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [RESULT])
    apply = _apply(names, text)
    hit = keep_ids(rows, "_r1", hits, bitmap, exact=False).join(hits, ["_r1", "_r2"], "left").select(*names, "_spans", "_items").mapInArrow(tidied(apply), types)
    return hit.union(keep_ids(rows.select(*names, "_r1"), "_r1", hits, bitmap, exact=False, wanted=False, then=apply, schema=types))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op6_sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({lower.format("coalesce(text, '')")}, '{word}') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({lower.format("coalesce(text, '')")}, '{word}') AS w FROM benchmark),
    wins AS (
      SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT size FROM wins),
    grams AS (
      SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
      FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
    found AS (SELECT g.doc_id, g.i, g.size, wins.item_id FROM grams g JOIN wins ON g.win = wins.win AND g.size = wins.size),
    hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id),
    own AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(own.n, 0)::BIGINT AS n_items,
      sha256(coalesce(own.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)"""
