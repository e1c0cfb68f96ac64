"""Per-user vector memories: exact similarity search, listing and removal.

Every query is compared with every memory of its user, which is quadratic by nature. A user's memories and queries are cut into
blocks, and a pair of blocks is a matrix product in a task. Products only tell which pairs can't be among the nearest; of the others
the score is summed in order of components, so it is the same number wherever and however often it is worked out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS

#: Rows of a block on either side, and queries of which a matrix of scores is made at once.
BLOCK, AT_ONCE = 4096, 256
#: Scores that may be equal after rounding to six places differ by a millionth at most.
_MARGIN = 1.1e-6


class _Vectors:
    def __init__(self, column: pa.ChunkedArray):
        lists = pa.concat_arrays(column.cast(pa.list_(pa.float64())).chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        values, self.starts = lists.flatten(), np.cumsum(sizes) - sizes
        #: -1 for those without a score: null, or with a null component.
        self.sizes = np.where(np.asarray(lists.is_null()), -1, sizes)
        self.sizes[np.repeat(np.arange(len(sizes)), sizes)[np.asarray(values.is_null(), bool)]] = -1
        self.values = np.asarray(pc.fill_null(values, 0.0), np.float64)

    def matrix(self, rows: np.ndarray, size: int) -> np.ndarray:
        return self.values[self.starts[rows][:, None] + np.arange(size)] if size else np.zeros((len(rows), 0))


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of rows, component by component."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _nearest(asked: np.ndarray, known: np.ndarray, order: np.ndarray, limit: int, threshold: float | None, unit: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, memory, score) of all pairs that may be among a query's nearest. order: of the memories' ids."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    with np.errstate(all="ignore"):
        left, right = _summed(asked, asked), _summed(known, known)
        far = 4e-16 * (asked.shape[1] + 8)
        for at in range(0, len(asked), AT_ONCE):
            rows = asked[at : at + AT_ONCE]
            both = np.sqrt(left[at : at + AT_ONCE, None] * right)
            scores = rows @ known.T
            off = far * (1.0 if unit else both.max(initial=0.0))
            if unit:
                scores /= both
            scores[~np.isfinite(scores)] = np.inf
            least = np.full(len(rows), -np.inf) if len(known) <= limit else np.partition(scores, len(known) - limit, axis=1)[:, len(known) - limit]
            if threshold is not None:
                least = np.maximum(least, threshold)
            q, m = np.nonzero(~(scores < (least - _MARGIN - 2 * off)[:, None]))
            score = _summed(rows[q], known[m])
            if unit:
                score /= both[q, m]
            # of equal scores of a query the first ids count
            sort = np.lexsort((order[m], score, q))
            q, m, score = q[sort], m[sort], score[sort]
            new = np.ones(len(q), bool)
            new[1:] = (q[1:] != q[:-1]) | ~((score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1])))
            place = np.arange(len(q)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(q) else np.zeros(0, int)
            out.append((q[place < limit] + at, m[place < limit], score[place < limit]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _of_user(asked: _Vectors, queries: np.ndarray, known: _Vectors, memories: np.ndarray, order: np.ndarray, limit: int, threshold: float | None, unit: bool):
    """(queries, memories, scores, whether there is a score), as numbers of rows; without one the first ids count."""
    sizes, length = known.sizes[memories], lambda v, rows, n: rows[v.sizes[rows] == n]
    for n in np.unique(asked.sizes[queries]):
        left, right = length(asked, queries, n), length(known, memories, n) if n >= 0 else memories[:0]
        a, b = asked.matrix(left, max(n, 0)), known.matrix(right, max(n, 0))
        if unit and n >= 0:  # what has no direction has no score
            a_flat, b_flat = ~(a != 0).any(1), ~(b != 0).any(1)
        else:
            a_flat, b_flat = np.full(len(a), n < 0), np.zeros(len(b), bool)
        q, m, score = _nearest(a[~a_flat], b[~b_flat], order[right[~b_flat]], limit, threshold, unit)
        yield left[~a_flat][q], right[~b_flat][m], score, True
        if threshold is None:
            rest = memories[sizes != n] if n >= 0 else memories
            first = lambda x: x[np.argsort(order[x])[:limit]]
            for these, others in ((left[~a_flat], first(np.concatenate([rest, right[b_flat]]) if n >= 0 else rest)), (left[a_flat], first(memories))):
                yield np.repeat(these, len(others)), np.tile(others, len(these)), np.zeros(len(these) * len(others)), False


def _compared(limit: int, threshold: float | None, unit: bool):
    def run(queries: pa.Table, memories: pa.Table) -> pa.Table:
        asked, known = _Vectors(queries["vector"]), _Vectors(memories["embedding"])
        order = np.zeros(len(memories), np.int64)
        order[np.asarray(pc.sort_indices(memories["id"], null_placement="at_start"), np.int64)] = np.arange(len(memories))
        users = pa.chunked_array([*queries["user_id"].chunks, *memories["owner"].chunks], queries["user_id"].type)
        codes = np.asarray(users.combine_chunks().dictionary_encode().indices, np.int64)
        left, right = codes[: len(queries)], codes[len(queries) :]
        by_left, by_right = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]
        for user in np.intersect1d(left, right):
            own = lambda codes, by: by[np.searchsorted(codes, user, "left", by) : np.searchsorted(codes, user, "right", by)]  # noqa: E731, B023
            for q, m, score, there in _of_user(asked, own(left, by_left), known, own(right, by_right), order, limit, threshold, unit):
                found.append((q, m, score, np.full(len(q), there)))
        q, m, score, there = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query_id": queries["query_id"].take(pa.array(q)), "user_id": queries["user_id"].take(pa.array(q)), "id": memories["id"].take(pa.array(m)), "score": pa.array(score, mask=~there)})

    return run


def recall(queries: DataFrame, memories: DataFrame, limit: int = DEFAULTS.memory_limit, threshold: float | None = None, scorer: str = "cosine", block: int = BLOCK) -> DataFrame:
    """queries: (query_id, user_id, vector). The nearest memories of the same user, by an exact score rounded to six places; equal
    scores by id. scorer: cosine or dot.

    Blocks are of about block rows on each side, so one user isn't one task; users of less than a block share one. A vector that is null,
    has a null component or another length, or a cosine with a zero vector, gives no score (null), which comes last.
    """
    if scorer not in ("cosine", "dot"):
        raise ValueError(f"no such scorer: {scorer}")
    asked = queries.where("user_id IS NOT NULL").select("query_id", "user_id", "vector")
    known = memories.where("user_id IS NOT NULL").select("id", "user_id", "embedding")
    number = lambda rows, name: rows.groupBy("user_id").agg(F.count("*").alias(name))
    sizes = number(known, "_known").join(number(asked, "_asked"), "user_id")
    shares = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    sizes = sizes.select("user_id", shares("_known").alias("_rows"), shares("_asked").alias("_columns"), (F.col("_known") + F.col("_asked")).alias("_both"))
    together = sizes.agg(F.ceil(F.sum("_both") / F.lit(block)).cast("int")).scalar()
    few = (F.col("_rows") == 1) & (F.col("_columns") == 1)
    sizes = sizes.withColumn("_own", F.when(~few, F.col("user_id"))).withColumn("_group", F.when(few, F.pmod(F.xxhash64("user_id"), together).cast("int")).otherwise(-1))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "user_id").select("_own", "_group", every("_rows").alias("_row"), at("query_id", "_columns").alias("_column"), "query_id", "user_id", "vector")
    right = known.join(sizes, "user_id").select(F.col("_own").alias("_of"), F.col("_group").alias("_in"), at("id", "_rows").alias("_x"), every("_columns").alias("_y"), "id", F.col("user_id").alias("owner"), "embedding")
    kinds = {**dict(asked.dtypes), **dict(known.dtypes)}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "user_id", "id")) + ", score double"
    found = left.groupBy("_own", "_group", "_row", "_column").cogroup(right.groupBy("_of", "_in", "_x", "_y")).applyInArrow(_compared(limit, threshold, scorer == "cosine"), schema).withColumn("score", F.round("score", 6))
    if threshold is not None:
        found = found.where(F.col("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def remember(memories: DataFrame, new: DataFrame) -> DataFrame:
    return memories.unionByName(new, allowMissingColumns=True)


def forget(memories: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: (id, user_id). (memories left, outcome of each): another user's memory isn't found, an absent one is no error."""
    owners = memories.select("id", F.col("user_id").alias("_owner"))
    outcome = requests.join(owners, "id", "left").select("id", "user_id", F.when(F.col("_owner").isNull(), "ABSENT").when(F.col("_owner") == F.col("user_id"), "DELETED").otherwise("MEMORY_NOT_FOUND").alias("outcome"))
    return memories.join(requests, ["id", "user_id"], "left_anti"), outcome


def forget_user(memories: DataFrame, user: Column) -> DataFrame:
    """All but the user's memories; those of no user stay."""
    return memories.where(~F.col("user_id").eqNullSafe(user))


def listing(memories: DataFrame) -> DataFrame:
    """Every memory with the fields that clients see; absent ones are empty."""
    return memories.select("id", "user_id", F.coalesce("memory", F.lit("")).alias("memory"), F.coalesce("metadata", F.lit("{}")).alias("metadata"))
