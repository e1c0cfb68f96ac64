"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn with its code point as the seed. A letter trigram is the element-wise
product (binding) of its letters' vectors, rotated by two, one and no places; a document is the sum (bundling) of its
trigrams, a language the sum of its documents. A document gets the language whose prototype has the highest cosine with it.

Learning is one pass: a task bundles its documents by language and gives one vector of whole numbers for each, and Spark adds
these up by language and dimension; languages times DIMENSIONS numbers reach the driver. Scoring is a second pass without a
shuffle. Documents are bundled in slices of about a quarter of a megabyte.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a text of any length is bundled whole; rows with
a null language are not learnt from; repeated rows are learnt from as often as they come; equal texts get equal results;
equal similarities go to the language first in order; with no learnt language all is ``und``; an empty table stays empty;
result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, slices, table, tidied

DIMENSIONS = 1024
SEED = 20240117
#: Trigram vectors that a worker keeps (4 KB each).
KEPT = 1 << 14
_POINTS = 0x32400


@cache
def lower_letters() -> np.ndarray:
    """Code point -> 0 if it isn't a letter, else the code point of its lower-case letter."""
    own = np.zeros(0x110000, np.uint32)
    for c in range(_POINTS):
        x = chr(c)
        if x.isalpha():
            own[c] = ord(x.lower()[0])
    return own


@cache
def letter_vector(point: int) -> np.ndarray:
    """The vector of a letter, by its code point; 0 stands for whatever is no letter."""
    return np.random.default_rng([SEED, point]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1


def trigram_vectors(keys: np.ndarray) -> np.ndarray:
    """keys: three code points of 18 bits each."""
    out = np.empty((len(keys), DIMENSIONS), np.float32)
    for i, k in enumerate(keys.tolist()):
        out[i] = np.roll(letter_vector(k >> 36), 2) * np.roll(letter_vector(k >> 18 & 0x3FFFF), 1) * letter_vector(k & 0x3FFFF)
    return out


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and number of every trigram whose middle is a letter (each letter is the middle of one), and the keys by number, in order."""
    texts = [x or "" for x in texts]
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "replace"), np.uint32)
    low = lower_letters()[points]
    there = np.zeros(_POINTS, bool)
    there[low] = True
    there[0] = True
    letters = np.flatnonzero(there)
    dense = np.zeros(_POINTS, np.int32)
    dense[letters] = np.arange(len(letters))
    ids, n = dense[low].astype(np.int64), len(letters)
    middle = low[1:-1] > 0
    keys = ((ids[:-2] * n + ids[1:-1]) * n + ids[2:])[middle]
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), np.array([len(x) + 1 for x in texts]))[: len(middle)][middle]
    if n**3 <= 1 << 22:
        seen = np.flatnonzero(np.bincount(keys, minlength=1)) if len(keys) else keys
        column = np.zeros(n**3, np.int32)
        column[seen] = np.arange(len(seen))
        numbers = column[keys]
    else:
        seen, numbers = np.unique(keys, return_inverse=True)
    return rows, numbers, letters[seen // (n * n)] << 36 | letters[seen // n % n] << 18 | letters[seen % n]


class Bundler:
    """Document vectors, with the vectors of the trigrams seen so far at hand."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.vectors = np.zeros((0, DIMENSIONS), np.float32)

    def vectors_of(self, keys: np.ndarray) -> np.ndarray:
        names = keys.tolist()
        if len(self.place) + len(names) > KEPT:
            self.clear()
        new = [k for k in names if k not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.vectors = np.concatenate([self.vectors, trigram_vectors(np.array(new, np.int64))])
        return self.vectors[[self.place[k] for k in names]]

    def bundle(self, texts: list[str | None], groups: np.ndarray | None = None, n: int | None = None) -> np.ndarray:
        """The sum of the trigrams of each text, or of each of n groups of texts; exact, as sums stay below 2 ** 24 and 2 ** 53."""
        rows, numbers, keys = trigrams(texts)
        self.seen = np.bincount(rows, minlength=len(texts)) > 0  # which texts have a letter
        rows = rows if groups is None else groups[rows]
        n = len(texts) if n is None else n
        out = np.zeros((n, DIMENSIONS), np.float32 if groups is None else np.float64)
        if not len(keys):
            return out
        vectors = self.vectors_of(keys).astype(out.dtype)
        step = max(1, (8 << 20) // len(keys))  # rows whose counts fit a few tens of MB
        for at in range(0, n, step):
            own = (rows >= at) & (rows < at + step)
            size = min(step, n - at)
            counts = np.bincount((rows[own] - at).astype(np.int64) * len(keys) + numbers[own], minlength=size * len(keys)).reshape(size, -1)
            out[at : at + size] = counts.astype(out.dtype) @ vectors
        return out


def learn(docs: DataFrame, lang: str, text: str = "text") -> tuple[list[str], np.ndarray]:
    """The languages in order, and their prototypes (unit length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = defaultdict(lambda: np.zeros(DIMENSIONS, np.int64))
        bundler = Bundler()
        for whole in batches:
            for batch in slices(whole, text):
                names = batch.column(lang).to_pylist()
                order = {name: i for i, name in enumerate(sorted(set(names)))}
                sums = bundler.bundle(batch.column(text).to_pylist(), np.array([order[x] for x in names]), len(order))
                for name, i in order.items():
                    total[name] += sums[i].astype(np.int64)
        for name, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(sums)], ["lang", "dimension", "n"])

    rows = docs.select(text, F.col(lang).cast("string").alias(lang)).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sums = rows.mapInArrow(tidied(run), "lang string, dimension int, n long").groupBy("lang", "dimension").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():  # DIMENSIONS rows a language
        found.setdefault(r.lang, np.zeros(DIMENSIONS))[r.dimension] = r.n
    names = sorted(found)
    prototypes = np.array([found[x] for x in names]).reshape(len(names), DIMENSIONS)
    return names, prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the cosine with that language's prototype (0 if negative)."""
    docs = docs.drop(*[c for c in ("lang_pred", "score") if c != text])
    model = docs.sparkSession.sparkContext.broadcast((names, prototypes.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, vectors = model.value
        bundler = Bundler()
        for whole in batches:
            for batch in slices(whole, text):
                texts = batch.column(text).to_pylist()
                if known:
                    bundled, letters = bundler.bundle(texts), bundler.seen
                    cosines = bundled @ vectors.T / np.maximum(np.linalg.norm(bundled, axis=1), 1e-12)[:, None]
                    best = cosines.argmax(axis=1)
                    scores = np.where(letters, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0)
                    langs = [known[i] if own else "und" for i, own in zip(best, letters, strict=True)]
                else:
                    langs, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores.astype(np.float64))], [*batch.schema.names, "lang_pred", "score"])

    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["lang_pred string, score double"])
    return docs.mapInArrow(tidied(run), types)


def learnable(doc_id: str = "doc_id") -> Column:
    return F.coalesce(remainder(doc_id, 5) != 0, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, prototypes = learn(docs.where(learnable()), "lang")
    found = identify(docs.select("doc_id", "text"), names, prototypes)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
