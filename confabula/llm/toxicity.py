"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

* Examples are a bounded sample of the labelled rows (MAX_POSITIVE and MAX_NEGATIVE, first by a hash of their id); votes
  are weighted so that the classes count as in all labelled rows.
* Terms are words and word beginnings of four and five letters: all that are in an example. A term's weight is its inverse
  document frequency, over all documents, times a factor between FLOOR and 1 that rises with the likelihood ratio by which
  the term goes with the label in the examples; so no term is left out, and the usual ones don't drown the telling ones.
* Every document is compared with the examples by exact cosine. Examples lie in blocks of BLOCK; for each term and block
  the index knows the highest weight. Documents come in batches: the sums of these highest weights are a bound for each
  document and block; the two blocks with the highest bounds are scored, then all whose bound reaches the document's
  NEIGHBOURS-th best. The lists of terms that are in many examples are kept dense, so that scoring a block is a product of
  matrices and a few lists.
* Votes are weighted by one over distance. The raw vote is turned into a probability by a monotone fit on the examples.
* An example is never a neighbour of a row with its doc_id, in the fit and in scoring, so no row's own label votes on it.

Documents are read once; their terms are written as numbers, which give the frequencies and then the scores. What is
broadcast (terms, examples, fit) is bounded by the examples. Cosines are sums in single precision, rounded to six digits.

Defined cases: texts without a term of the examples (null and empty ones too) get the label's rate in all labelled rows; a text
of any length counts whole; with no labelled rows every score is 0; equal similarities are ordered by the examples'
place in the index; equal texts get equal scores but for rounding and for their own examples, which don't vote; repeated labelled rows
are examples as often as they come, and none of them votes on a row of that doc_id; an empty table stays empty; columns of the input that have the name of a result column are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, slices, stored, table, tidied

MAX_POSITIVE = 800
MAX_NEGATIVE = 2000
#: Least factor of a term, and the likelihood ratio at which the factor is 1.
FLOOR, FULL_RATIO = 0.1, 15.0
BLOCK = 64
#: Lists of terms that are in more than this share of the examples are kept dense.
DENSE = 0.03
NEIGHBOURS = 16
EVIDENCE = 3
THRESHOLD = 0.7
#: Documents scored together, and what cosines are rounded to.
BATCH, DIGITS = 256, 1e6

def terms_of(word: str) -> list[str]:
    return [word] + [word[:n] + "-" for n in (4, 5) if len(word) > n] if word else []


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The words (runs of letters, in lower case) of the texts: of each its text's row and its number in the list of distinct words."""
    found = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), r"[^\pL]+")
    coded = found.flatten().dictionary_encode()
    return np.repeat(np.arange(len(texts)), np.diff(np.asarray(found.offsets))), np.asarray(coded.indices), coded.dictionary.to_pylist()


def term_counts(texts: pa.Array) -> list[Counter]:
    """The terms of each text, as often as they come."""
    rows, numbers, words = words_of(texts)
    terms = [terms_of(w) for w in words]
    found: list[Counter] = [Counter() for _ in range(len(texts))]
    keys, n = np.unique(rows * max(1, len(words)) + numbers, return_counts=True)
    for row, word, times in zip((keys // max(1, len(words))).tolist(), (keys % max(1, len(words))).tolist(), n.tolist(), strict=True):
        for t in terms[word]:
            found[row][t] += times
    return found


def examples_of(labels: DataFrame, doc_id: str, label: str, seed: int = 0) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample of (doc_id, label, weight), weight being the labelled rows that one example stands for; and the rows of each label."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = []
    for value, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE)):
        chosen = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
        parts.append(chosen.withColumn("weight", F.lit(totals.get(value, 0) / max(1, min(most, totals.get(value, 0))))))
    return parts[0].union(parts[1]), totals


class Places:
    """Texts -> places of their terms in the list of terms, remembered for words met before."""

    def __init__(self, terms: list[str]):
        self.place = {t: i for i, t in enumerate(terms)}
        self.memory: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        if (ids := self.memory.get(word)) is None:
            if len(self.memory) > 300_000:
                self.memory.clear()
            ids = self.memory[word] = tuple(self.place[t] for t in terms_of(word) if t in self.place)
        return ids

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (text, term, count), sorted by text and term."""
        doc, numbers, words = words_of(texts)
        ids = [self.of(w) for w in words]
        size = np.array([len(x) for x in ids], np.int64)
        flat, first = np.fromiter((t for x in ids for t in x), np.int64, int(size.sum())), np.cumsum(size) - size
        many = size[numbers]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[numbers], many)
        keys, n = np.unique(np.repeat(doc, many) * max(1, len(self.place)) + flat[at], return_counts=True)
        return keys // max(1, len(self.place)), keys % max(1, len(self.place)), n


def term_vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, steps, counts) of docs (doc_id, text): the places of a text's terms, as differences, and how often each comes."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(known.value)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                doc, term, n = places.counts(batch.column("text"))
                edges = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
                steps = np.diff(term, prepend=0)
                steps[edges[:-1][edges[:-1] < len(term)]] = term[edges[:-1][edges[:-1] < len(term)]]
                lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x.astype(np.int32))) for x in (steps, n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "steps", "counts"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, steps array<int>, counts array<int>")


def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (document, term, count) of a batch of term_vectors()."""
    size = np.diff(np.asarray(batch.column("steps").offsets))
    steps, n = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in ("steps", "counts"))
    upto, first = np.cumsum(steps), np.cumsum(size) - size
    before = np.concatenate([[0], upto])[first]
    return np.repeat(np.arange(len(size)), size), upto - np.repeat(before, size), n


def document_frequency(vectors: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """In how many documents each term is, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            n[:-1] += np.bincount(rows_of(batch)[1], minlength=n_terms)
            n[-1] += batch.num_rows
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], ["term", "n"])

    found = np.zeros(n_terms + 1, np.int64)
    counts = vectors.mapInArrow(tidied(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a term of the examples
    found[counts["term"].to_numpy()] = counts["n"].to_numpy()
    return found[:-1], int(found[-1])


def factors(labels: np.ndarray, terms: list[np.ndarray], n_terms: int) -> np.ndarray:
    """Of each term, how well it goes with label 1 in the examples (likelihood ratio), between FLOOR and 1."""
    pos, neg = (np.bincount(np.concatenate([t for t, y in zip(terms, labels, strict=True) if y == kind] or [np.zeros(0, np.int64)]), minlength=n_terms).astype(float) for kind in (1, 0))
    p, n = float((labels == 1).sum()), float((labels == 0).sum())
    if not p or not n:
        return np.ones(n_terms)
    share = (pos + neg) / (p + n)
    part = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    ratio = 2 * (part(pos, p * share) + part(neg, n * share) + part(p - pos, p * (1 - share)) + part(n - neg, n * (1 - share)))
    return FLOOR + (1 - FLOOR) * np.where(pos / p > neg / n, np.minimum(1, ratio / FULL_RATIO), 0) ** 2


def weigh(doc: np.ndarray, term: np.ndarray, counts: np.ndarray, importance: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF weights of rows (document, term, count), of length 1 for each of n documents."""
    w = (1 + np.log(counts)) * importance[term]
    return w / np.sqrt(np.bincount(doc, w * w, n))[doc]


@dataclass
class BlockMaxIndex:
    """Postings by term and block of examples, with the highest weight of every term in every block."""

    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    row: np.ndarray = field(repr=False)  # term -> row of the dense lists, or -1
    dense: np.ndarray = field(repr=False)  # dense lists: block x row x place in the block
    first: np.ndarray = field(repr=False)  # sparse terms: term -> where its blocks begin in the next four
    block: np.ndarray = field(repr=False)
    highest: np.ndarray = field(repr=False)
    begin: np.ndarray = field(repr=False)  # where the postings of a term in a block begin and end
    end: np.ndarray = field(repr=False)
    place: np.ndarray = field(repr=False)  # postings: place in the block, weight
    weight: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, examples: list[tuple[int, int, float, np.ndarray, np.ndarray]], n_terms: int) -> BlockMaxIndex:
        """examples: id, label, vote weight, terms, term weights. Those with the same strongest frequent term go side by side."""
        often = np.bincount(np.concatenate([x[3] for x in examples]), minlength=n_terms) > DENSE * len(examples)

        def strongest(x) -> tuple:
            w = np.where(often[x[3]], x[4], x[4] - 1)
            return int(x[3][np.argmax(w)]), -float(w.max()), x[0], x[1]

        examples = sorted(examples, key=strongest)
        blocks = -(-len(examples) // BLOCK)
        example = np.repeat(np.arange(len(examples)), [len(x[3]) for x in examples])
        term, w = (np.concatenate([x[k] for x in examples]).astype(kind) for k, kind in ((3, np.int64), (4, np.float64)))
        row = np.full(n_terms, -1, np.int32)
        row[often] = np.arange(often.sum())
        dense = np.zeros((int(often.sum()), blocks * BLOCK), np.float32)
        heavy = often[term]
        dense[row[term[heavy]], example[heavy]] = w[heavy]
        term, example, w = term[~heavy], example[~heavy], w[~heavy]
        order = np.lexsort((example, term))
        term, example, w = term[order], example[order], w[order]
        key = term * blocks + example // BLOCK
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        end = np.concatenate([begin[1:], [len(key)]]) if len(key) else begin
        highest = np.maximum.reduceat(w, begin) if len(key) else w
        first = np.searchsorted(term[begin], np.arange(n_terms + 1))
        about = [np.array([x[k] for x in examples], kind) for k, kind in ((0, np.int64), (1, np.int64), (2, np.float64))]
        dense = np.ascontiguousarray(dense.reshape(len(dense), blocks, BLOCK).transpose(1, 0, 2))
        return cls(*about, row, dense, first, (key[begin] % blocks).astype(np.int32), highest, begin.astype(np.int32), end.astype(np.int32), (example % BLOCK).astype(np.int32), w.astype(np.float32))

    @cached_property
    def dense_highest(self) -> np.ndarray:
        return self.dense.max(axis=2).T

    @cached_property
    def by_id(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.ids, kind="stable")
        return self.ids[order], order

    def own(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, place): for each row the places of the examples that have its doc_id."""
        known, order = self.by_id
        there = np.flatnonzero(np.asarray(ids.is_valid()))
        asked = np.asarray(ids.drop_null()).astype(np.int64)
        first = np.searchsorted(known, asked, "left")
        many = np.searchsorted(known, asked, "right") - first
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        return np.repeat(there, many), order[at]

    def nearest(self, doc: np.ndarray, term: np.ndarray, q: np.ndarray, n: int, k: int, without: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each of n documents, given by rows (document, term, weight), the places and cosines of the k nearest examples that share
        a term, nearest first; ties: the lower place first; -1 where there are no more. without: pairs (document, place) that are left out."""
        term = term.astype(np.int64)
        blocks, often = len(self.dense), self.row[term] >= 0
        dense = np.zeros((n, self.dense.shape[1]), np.float32)
        dense[doc[often], self.row[term[often]]] = q[often]
        doc, term, q = doc[~often].astype(np.int32), term[~often], q[~often].astype(np.float32)
        many = self.first[term + 1] - self.first[term]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[term], many)
        doc, q = np.repeat(doc, many), np.repeat(q, many)
        bounds = dense @ self.dense_highest
        bounds = bounds + np.bincount(doc * blocks + self.block[at], q * self.highest[at], n * blocks).reshape(n, blocks)
        block, width = self.block[at], blocks * BLOCK
        scores = np.zeros((n, width), np.float32)

        def score(need: np.ndarray) -> None:
            for b in np.flatnonzero(need.any(axis=0)).tolist():
                docs = np.flatnonzero(need[:, b])
                scores[docs, b * BLOCK : (b + 1) * BLOCK] = (dense if len(docs) == n else dense[docs]) @ self.dense[b]
            own = np.flatnonzero(need[doc, block])
            begin = self.begin[at[own]]
            size = self.end[at[own]] - begin
            p = np.arange(size.sum(), dtype=np.int32) + np.repeat(begin - (np.cumsum(size, dtype=np.int32) - size), size)
            place = np.repeat((doc[own] * width + block[own] * BLOCK).astype(np.int32), size) + self.place[p]
            scores[:] += np.bincount(place, np.repeat(q[own], size) * self.weight[p], n * width).reshape(n, width)
            if without is not None:
                scores[without] = 0

        need = np.zeros((n, blocks), bool)
        np.put_along_axis(need, np.argsort(-bounds, axis=1, kind="stable")[:, :2], True, axis=1)
        score(need)
        k = min(k, scores.shape[1])
        reached = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        more = ~need & (bounds > 0) & (bounds >= reached[:, None] - 1e-5)
        score(more)
        keys = np.rint(scores * np.float32(DIGITS)).astype(np.int64) * scores.shape[1] + np.arange(scores.shape[1])[::-1]
        best = np.argpartition(-keys, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(keys, best, 1), axis=1), 1)
        cosines = np.rint(np.take_along_axis(scores, best, 1).astype(np.float64) * DIGITS) / DIGITS
        return np.where(cosines > 0, best, -1), cosines

    def votes(self, places: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among each query's neighbours; nan without any."""
        there = places >= 0
        w = np.where(there, self.weights[places] / (0.05 + np.maximum(0, 1 - cosines)), 0)
        total = w.sum(axis=1)
        return np.where(total > 0, (w * self.labels[places]).sum(axis=1) / np.maximum(total, 1e-300), np.nan)


@dataclass
class Model:
    """The index is built by each worker from the examples, which are much smaller, and not pickled."""

    terms: list[str]
    importance: np.ndarray
    #: id, label, vote weight, terms, term weights.
    examples: list[tuple[int, int, float, np.ndarray, np.ndarray]]
    rate: float
    #: Raw vote -> probability, a rising step function.
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @cached_property
    def index(self) -> BlockMaxIndex | None:
        return BlockMaxIndex.of(self.examples, len(self.terms)) if self.examples else None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def probability(self, raw: np.ndarray) -> np.ndarray:
        known = np.interp(np.nan_to_num(raw), self.steps, self.values) if len(self.steps) else raw
        return np.clip(np.where(np.isnan(raw), self.rate, known), 0, 1)


def rising_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: the rising function nearest to (x, y) with weights w, as the centres and values of its levels."""
    order = np.argsort(x, kind="stable")
    levels: list[list[float]] = []  # sum of w*y, w, w*x
    for i in order.tolist():
        levels.append([w[i] * y[i], w[i], w[i] * x[i]])
        while len(levels) > 1 and levels[-2][0] * levels[-1][1] >= levels[-1][0] * levels[-2][1]:
            last = levels.pop()
            levels[-1] = [a + b for a, b in zip(levels[-1], last, strict=True)]
    centres = np.array([x / n for _, n, x in levels])
    return centres, np.array([s / n for s, n, _ in levels])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[Model, DataFrame]:
    """The model, and a stored table of the documents' term vectors for score()."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    chosen, totals = examples_of(labels, doc_id, label)  # at most MAX_POSITIVE + MAX_NEGATIVE rows, so it may be broadcast
    rate = totals.get(1, 0) / max(1, sum(totals.values()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = term_counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "label", "weight")] + [pa.array([list(x) for x in found], pa.list_(pa.string())), pa.array([list(x.values()) for x in found], pa.list_(pa.int64()))], ["doc_id", "label", "weight", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "weight", "text").mapInArrow(tidied(count), f"doc_id {kind}, label int, weight double, terms array<string>, counts array<long>")
    rows = stored(counted, "examples").where("size(terms) > 0").orderBy("doc_id", "label").toArrow().combine_chunks()  # the examples
    if not rows.num_rows:
        return Model([], np.zeros(0), [], rate), stored(term_vectors(docs, []), "vectors")
    lists = rows["terms"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    by_name = np.asarray(pc.sort_indices(coded.dictionary))
    terms = coded.dictionary.take(pa.array(by_name)).to_pylist()
    place = np.empty(len(terms), np.int64)
    place[by_name] = np.arange(len(terms))
    example = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(lists.offsets)))
    term, n = place[np.asarray(coded.indices)], np.asarray(rows["counts"].combine_chunks().flatten())
    order = np.lexsort((term, example))
    example, term, n = example[order], term[order], n[order]
    vectors = stored(term_vectors(docs, terms), "vectors")
    frequency, total = document_frequency(vectors, len(terms))
    edges = np.searchsorted(example, np.arange(rows.num_rows + 1))
    of = [term[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    ids, labels_, votes_ = (rows[c].to_pylist() for c in ("doc_id", "label", "weight"))
    importance = (np.log((1 + total) / (1 + frequency)) + 1) * factors(np.array(labels_), of, len(terms))
    w = weigh(example, term, n, importance, rows.num_rows).astype(np.float32)
    weighed = [(ids[i], labels_[i], votes_[i], of[i].astype(np.int32), w[edges[i] : edges[i + 1]]) for i in range(rows.num_rows)]
    model = Model(terms, importance, weighed, rate)
    raw = np.full(len(weighed), np.nan)
    known = spark.sparkContext.broadcast(model)
    parts = spark.createDataFrame([(i,) for i in range(0, len(weighed), BATCH)], "i int").repartition(max(1, min(64, -(-len(weighed) // BATCH))), "i")

    def leave_one_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, examples = known.value.index, known.value.examples
        for batch in batches:
            for i in batch.column(0).to_pylist():
                own = examples[i : i + BATCH]
                doc = np.repeat(np.arange(len(own)), [len(x[3]) for x in own])
                votes = index.votes(*index.nearest(doc, *(np.concatenate([x[k] for x in own]) for k in (3, 4)), len(own), NEIGHBOURS, index.own(pa.array([x[0] for x in own], pa.int64()))))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(votes), dtype=np.int32)), pa.array(votes, from_pandas=False)], ["i", "raw"])

    for r in parts.mapInArrow(leave_one_out, "i int, raw double").collect():  # the examples
        raw[r.i] = np.nan if r.raw is None else r.raw
    full = ~np.isnan(raw)
    if full.any():
        y, w = (np.array([x[k] for x in weighed], np.float64)[full] for k in (1, 2))
        model.steps, model.values = rising_fit(raw[full], y, w)
    return model, vectors


def score(vectors: DataFrame, model: Model) -> DataFrame:
    """vectors: from fit(), or term_vectors() of other documents with the model's terms. (doc_id, score, evidence): evidence is the
    nearest examples with their labels and cosines."""
    known = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                raw, evidence = np.full(batch.num_rows, np.nan), [[] for _ in range(batch.num_rows)]
                if m.index:
                    doc, term, n = rows_of(batch)
                    places, cosines = m.index.nearest(doc, term, weigh(doc, term, n, m.importance, batch.num_rows), batch.num_rows, NEIGHBOURS, m.index.own(batch.column("doc_id")))
                    raw = m.index.votes(places, cosines)
                    for i, (p, c) in enumerate(zip(places[:, :EVIDENCE].tolist(), cosines[:, :EVIDENCE].tolist(), strict=True)):
                        evidence[i] = [{"doc_id": int(m.index.ids[a]), "label": int(m.index.labels[a]), "cosine": b} for a, b in zip(p, c, strict=True) if a >= 0]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m.probability(raw)), pa.array(evidence, _EVIDENCE)], ["doc_id", "score", "evidence"])

    # vectors are smaller than texts, so files would give few tasks to the dearest step
    least = vectors.sparkSession.sparkContext.defaultParallelism
    spread = vectors if vectors.rdd.getNumPartitions() >= least else vectors.repartition(least)
    return spread.mapInArrow(tidied(run), f"doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score double, evidence array<struct<doc_id: long, label: int, cosine: double>>")


_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))


def held_out() -> Column:
    return F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, vectors = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))
    return score(vectors, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
