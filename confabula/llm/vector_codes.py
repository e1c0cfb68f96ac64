"""Product codes of vectors: each of four parts is named by the nearest entry of that part's codebook.

Components become integers (the floor of 1024 times the component), so that distances, ties and averages are exact. A codebook
has at most 256 entries; it begins with the parts of the smallest ids and is refined in rounds: Spark assigns the parts of
all vectors, each task sums what it assigned to each entry, the sums are added up by Spark, and only they (one row for each
part and entry) reach the driver.

An entry is found with a ball tree over the entries of a part position: metric branch and bound over whole batches. A ball
is skipped only if its lower bound exceeds the best distance found so far. Radii are rounded up and lower bounds down by far
more than floating point can be off, a ball whose bound equals the best is visited (it may hold a lower index at the same
distance), and in a leaf distances are computed and compared in integers.

Defined cases: rows whose vector is null, empty, or holds null or non-finite components are dropped; the dimension is that of
the row with the smallest id, vectors of another length are dropped too; a length that four doesn't divide is filled up
with zeros; components beyond a range of 2 ** 27 in either direction count as its limit, so that all sums fit in longs; an id may be null
(such rows come last in the order of ids) or repeated (then in the order of the components); null labels are one label;
equal vectors get equal codes, and fewer than 256 rows make as many entries; an empty table gives an empty result; only the
columns of the result are returned, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, joined, stored, table, tidied

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Largest integer of a component.
LIMIT = 1 << 27
#: Entries in a leaf of a ball tree.
LEAF = 16
#: Share by which bounds are widened.
SLACK = 1e-9


class Ball(NamedTuple):
    place: int
    entries: np.ndarray
    inside: tuple[Ball, Ball] | None


class BallTree:
    """Balls over the entries (rows of integers) of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.points = entries, entries.astype(np.float64)
        self.squares = (self.points**2).sum(axis=1)
        centers: list[np.ndarray] = []
        radii: list[float] = []

        def ball(own: np.ndarray) -> Ball:
            points, place = self.points[own], len(centers)
            centers.append(points.mean(axis=0))
            away = distances(points, centers[place])
            radii.append(float(away.max()) * (1 + SLACK) + SLACK)
            if len(own) <= LEAF or not away.any():
                return Ball(place, own, None)
            one = points[away.argmax()]
            other = points[distances(points, one).argmax()]
            nearer = distances(points, one) < distances(points, other)
            return Ball(place, own, (ball(own[nearer]), ball(own[~nearer])))

        self.top = ball(np.arange(len(entries)))
        self.centers, self.radii = np.array(centers), np.array(radii)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of integers: the index of the nearest entry, of equally near ones the lowest, and the squared distance."""
        best, at, points = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64), x.astype(np.float64)
        reach = np.full(len(x), np.inf)
        squares = (points**2).sum(axis=1)
        sizes = squares[:, None] + (self.centers**2).sum(axis=1)
        away = sizes - 2 * points @ self.centers.T
        bounds = np.sqrt(np.maximum(away - sizes * SLACK, 0)) * (1 - SLACK) - self.radii
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(self.entries).max()))
        whole = 4 * most * most * x.shape[1] < 1 << 53  # then every sum below is a whole number that a float holds exactly

        def visit(ball: Ball, rows: np.ndarray) -> None:
            rows = rows[bounds[rows, ball.place] <= reach[rows]]
            if not len(rows):
                return
            if ball.inside is None:
                if whole:
                    exact = (squares[rows, None] + self.squares[ball.entries] - 2 * points[rows] @ self.points[ball.entries].T).astype(np.int64)
                else:
                    exact = ((x[rows, None, :] - self.entries[None, ball.entries, :]) ** 2).sum(axis=2)
                k = exact.argmin(axis=1)
                found, name = exact[np.arange(len(rows)), k], ball.entries[k]
                better = (found < best[rows]) | ((found == best[rows]) & (name < at[rows]))
                mine = rows[better]
                best[mine], at[mine] = found[better], name[better]
                reach[mine] = np.sqrt(best[mine].astype(np.float64)) * (1 + SLACK)
                return
            one, other = ball.inside
            first = away[rows, one.place] <= away[rows, other.place]
            for mine, a, b in ((rows[first], one, other), (rows[~first], other, one)):
                visit(a, mine)
                visit(b, mine)

        visit(self.top, np.arange(len(x)))
        return at, best


def distances(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - center) ** 2).sum(axis=1))


def gathered(batches: Iterator[pa.RecordBatch], least: int = 8192) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many rows (the last may be smaller), as a search costs less in large ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= least:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def integers(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, size, parts) of the rows with a whole, finite vector; parts: the integers, filled up to a multiple of PARTS, as bytes."""
    taken = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v")).where(F.size("v") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for x in batch.column("v"):
                own = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                sizes.append(len(own))
                if not np.isfinite(own).all():
                    found.append(None)
                    continue
                own = np.clip(np.floor(np.clip(own, -LIMIT, LIMIT) * SCALE), -LIMIT, LIMIT).astype("<i4")
                found.append(np.pad(own, (0, -len(own) % PARTS)).tobytes())
            out = [batch.column("vec_id"), batch.column("label"), pa.array(sizes, pa.int32()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "label", "size", "parts"])

    return taken.mapInArrow(tidied(run), f"vec_id long, label {taken.schema['label'].dataType.simpleString()}, size int, parts binary").where("parts is not null")


def parts_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as (vector, part, component)."""
    return np.frombuffer(b"".join(batch.column("parts").to_pylist()), "<i4").astype(np.int64).reshape(-1, PARTS, width)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all rows. books: (part, entry, component)."""
    n, width = books.shape[1:]
    known = rows.sparkSession.sparkContext.broadcast(books)
    sums = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, total, count = None, np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in gathered(batches):
            trees = trees or [BallTree(x) for x in known.value]
            x = parts_of(batch, width)
            for p in range(PARTS):
                at, _ = trees[p].nearest(x[:, p])
                np.add.at(total[p], at, x[:, p])
                count[p] += np.bincount(at, minlength=n)
        part, entry = np.nonzero(count)
        columns = [part, entry, count[part, entry], *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "n", *sums])

    types = ", ".join(f"{c} long" for c in ("part", "entry", "n", *sums))
    added = rows.select("parts").mapInArrow(tidied(run), types).groupBy("part", "entry").agg(F.sum("n"), *[F.sum(s) for s in sums])
    books = books.copy()
    for part, entry, many, *own in added.collect():  # PARTS * ENTRIES rows at most
        books[part, entry] = np.array(own, np.int64) // many
    known.unpersist()
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of all rows."""
    known, width = rows.sparkSession.sparkContext.broadcast(books), books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = None
        for batch in gathered(batches):
            trees = trees or [BallTree(x) for x in known.value]
            x = parts_of(batch, width)
            found = [trees[p].nearest(x[:, p]) for p in range(PARTS)]
            digits = np.stack([at for at, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            codes = [digits[i : i + 2 * PARTS] for i in range(0, len(digits), 2 * PARTS)]
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "parts").mapInArrow(tidied(run), f"vec_id long, label {kind}, code string, error long")


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Per kept row vec_id, label, code and error; and the codebooks (part, entry, component), at most 256 entries each."""
    rows = stored(integers(bounded_batches(vectors), vec_id, embedding, label), "integers")
    order = [F.col("vec_id").asc_nulls_last(), "size", "parts"]
    first = rows.orderBy(*order).select("size").first()
    if first is None:
        return stored(coded(rows, np.zeros((PARTS, 0, 0), np.int64)), "codes"), np.zeros((PARTS, 0, 0), np.int64)
    rows = rows.where(F.col("size") == first["size"])
    start = [np.frombuffer(r.parts, "<i4") for r in rows.orderBy(*order).select("parts").limit(entries).collect()]
    books = np.stack(start).astype(np.int64).reshape(len(start), PARTS, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = refined(rows, books)
    return stored(coded(rows, books), "codes"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(table(spark, sf_dir, "embeddings"))
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return joined(codes, sums, ["label"], "n", inner=True).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_sql() -> str:
    """All entries compared with all parts, one component in a row."""
    near = """SELECT vec_id, part, arg_min(entry, struct_pack(d, entry)) AS entry, min(d) AS d FROM (
      SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d FROM parts p JOIN {book} b ON p.part = b.part AND p.pos = b.pos GROUP BY ALL) GROUP BY ALL"""
    rounds = ""
    for i in range(1, ROUNDS + 1):
        rounds += f""", near{i} AS MATERIALIZED ({near.format(book=f"book{i - 1}")}),
    sums{i} AS (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM parts JOIN near{i} USING (vec_id, part) GROUP BY ALL),
    book{i} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM book{i - 1} LEFT JOIN sums{i} USING (part, entry, pos))"""
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, embedding, len(embedding) AS size, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT vec_id, place, (i - 1) // (size // {PARTS}) AS part, (i - 1) % (size // {PARTS}) AS pos, floor({SCALE} * embedding[i]::DOUBLE)::BIGINT AS x
      FROM (SELECT *, unnest(range(1, size + 1)) AS i FROM kept)),
    book0 AS MATERIALIZED (SELECT part, place AS entry, pos, x FROM parts WHERE place < {ENTRIES}){rounds},
    last AS MATERIALIZED ({near.format(book=f"book{ROUNDS}")}),
    codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM last GROUP BY ALL),
    digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{ROUNDS})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), digest"""
