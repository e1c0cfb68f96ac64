"""Document quality learnt from trusted positives and unlabelled text (non-negative PU learning).

Positives are rows labelled 1; everything that isn't given as labelled is unlabelled. Labels of 0 aren't used. A bounded sample of
each (SAMPLE, first by a hash of the id) is described by counts and ratios of its text; then

* a first classifier tells positives from unlabelled rows. It scores all unlabelled rows, in parallel, and Spark counts them by
  score. The share of positives among the unlabelled (the class prior) is the least ratio, over score thresholds, of
  unlabelled to positive rows above the threshold, with a margin for chance in either when the threshold is chosen; the positives here
  are the half that the classifier hasn't seen;
* a second one minimises the risk  prior * loss(P as 1) + max(0, loss(U as 0) - prior * loss(P as 0)); where a batch makes
  the second part negative, the step goes the other way, so that it can't be fitted below zero.

Both are networks with one hidden layer on standardised features (N_FEATURES of them, about a thousand numbers in all), trained by
gradient steps on the driver; SAMPLE bounds the rows, twelve for every number. No document is shuffled.

Defined cases: a text without words (null, empty, white space) has score 0; a text of any length is described whole; rows with a
null id aren't learnt from; repeated ids are learnt from as often as they come; with no positives or no unlabelled rows every
score is 0; equal texts get equal scores; an empty table stays empty; columns of the input that have the name of a result
column are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, slices, stored, table, tidied, utf8

#: Rows of each kind that are learnt from; the unlabelled ones are weighted so that their scores are spread as those of all unlabelled rows.
SAMPLE = 12_000
HIDDEN = 24
EPOCHS = 40
BATCH = 512
SEED = 7
THRESHOLD = 0.7

_SYMBOLS = [b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">", b"!", b"?", b"@", b"{", b"="]
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_STOPS = b".,;:"
_ENDINGS = (b".", b"!", b"?", b":", b'"', b"'", b")")


def describe(text: bytes | None) -> list[float] | None:
    """Features of a text, None if it has no words."""
    words = text.split() if text else []
    if not words:
        return None
    n, size = len(words), len(text)
    count = Counter(words)
    lines = [x.strip() for x in text.split(b"\n") if x.strip()]
    pairs = list(zip(words, words[1:], strict=False))
    root = lambda x: float(x) ** 0.5
    return [
        np.log1p(n),
        np.log1p(len(lines)),
        np.log1p(n / len(lines)),
        sum(map(len, words)) / n,
        sum(len(w) > 12 for w in words) / n,
        sum(len(w) < 3 for w in words) / n,
        len(count) / n,
        max(count.values()) / n,
        sum(c == 1 for c in count.values()) / n,
        len(set(pairs)) / max(1, len(pairs)),
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        sum(x.endswith(_ENDINGS) for x in lines) / len(lines),
        root((size - len(text.translate(None, _UPPER))) / size),
        root((size - len(text.translate(None, _DIGITS))) / size),
        root((size - len(text.translate(None, _STOPS))) / size),
        1 - len(text.decode()) / size,
        root(sum(w.isalnum() for w in words) / n),
        *(root(min(1.0, text.count(c) / n)) for c in _SYMBOLS),
    ]


N_FEATURES = 18 + len(_SYMBOLS)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with features (null where there are no words) in place of text."""
    names = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, 4 << 20):
                found = pa.array([describe(x) for x in utf8(batch.column(text))], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [found], [*names, "features"])

    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text] + ["features array<double>"])
    return docs.mapInArrow(run, types)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def margin(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(self.standard(x) @ a + b) @ c + d

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(on_p: np.ndarray, on_u: np.ndarray, prior: float, weights: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Both parts of the risk of the scores (0 to 1) of positive and unlabelled rows: with positives as 1, and with the unlabelled as 0.
    weights: of the unlabelled rows, 1 on average."""
    off = lambda s: np.log1p(-np.minimum(s, 1 - 1e-12))
    return float(-prior * np.log(np.maximum(on_p, 1e-12)).mean()), float(-(weights * off(on_u)).mean() + prior * off(on_p).mean())


def slopes(on_p: np.ndarray, on_u: np.ndarray, prior: float | None, weights: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """How the risk changes with each row's margin; where its second part is below zero, that part's change the other way.

    Of the logistic loss, d/dz of the loss as 1 is s - 1, of the loss as 0 it is s. prior None: positives against unlabelled.
    """
    if prior is None:
        return (on_p - 1) / len(on_p), weights * on_u / len(on_u)
    if risk(on_p, on_u, prior, weights)[1] >= 0:
        return prior * (on_p - 1) / len(on_p) - prior * on_p / len(on_p), weights * on_u / len(on_u)
    return prior * on_p / len(on_p), -weights * on_u / len(on_u)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = SEED, weights: np.ndarray | None = None) -> Network:
    """prior: minimise the non-negative PU risk with it; None: just tell positive from unlabelled rows. weights: how many rows of
    the corpus each unlabelled one stands for, 1 on average."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    scale = both.std(axis=0)
    net = Network(both.mean(axis=0), np.where(scale > 1e-9, scale, 1), [])
    net.layers = [rng.normal(0, N_FEATURES**-0.5, (positive.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    p, u = net.standard(positive), net.standard(unlabelled)
    first, second = [np.zeros_like(x) for x in net.layers], [np.zeros_like(x) for x in net.layers]
    steps = max(1, max(len(p), len(u)) // BATCH)
    for step in range(EPOCHS * steps):
        x, at = p[rng.integers(0, len(p), BATCH)], rng.integers(0, len(u), BATCH)
        y = u[at]
        rows = np.concatenate([x, y])
        a, b, c, d = net.layers
        hidden = np.tanh(rows @ a + b)
        s = sigmoid(hidden @ c + d)
        on_p, on_u = s[: len(x)], s[len(x) :]
        slope = np.concatenate(slopes(on_p, on_u, prior, 1.0 if weights is None else weights[at]))
        back = np.outer(slope, c) * (1 - hidden**2)
        grads = [rows.T @ back + 1e-4 * a, back.sum(axis=0), hidden.T @ slope + 1e-4 * c, slope.sum()]
        rate = 3e-3 * (1 - step / (EPOCHS * steps)) + 1e-4
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g**2
            net.layers[i] = net.layers[i] - rate * (first[i] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[i] / (1 - 0.999 ** (step + 1))) + 1e-8)
    return net


#: Score thresholds that are tried for the prior.
CUTS = 200


def cuts_of(margins: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(margins, np.linspace(0, 0.98, CUTS)))


def estimated_prior(positive: np.ndarray, cuts: np.ndarray, counts: np.ndarray) -> float:
    """positive: margins of positives that the classifier hasn't seen; counts: unlabelled rows below the first cut, between cuts, and above."""
    p, n = np.sort(positive), max(1, int(counts.sum()))
    above_p, above_u = 1 - np.searchsorted(p, cuts) / len(p), counts[::-1].cumsum()[::-1][1:] / n
    margin = np.sqrt(np.log(CUTS) / (2 * n)) + np.sqrt(np.log(CUTS) / (2 * len(p)))
    best = int(np.argmin((above_u + margin) / np.maximum(above_p, 1e-9)))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.01, 0.99))


def standing_for(bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights, 1 on average, with which the sampled rows have the shares of all unlabelled rows: bins, of the sampled; counts, of all
    rows by bin. Rows of a bin that the sample hasn't met count with the next bin that it has, of the last ones with the one before."""
    there = np.bincount(bins, minlength=len(counts))
    met = np.flatnonzero(there)
    into = met[np.minimum(np.searchsorted(met, np.arange(len(counts))), len(met) - 1)]
    shares = np.bincount(into, counts, minlength=len(counts)) / max(1, counts.sum())
    return (shares * len(bins))[bins] / there[bins]


@dataclass
class Model:
    network: Network | None
    prior: float


def fit(docs: DataFrame, positives: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """positives: ids of trusted positives; labelled: ids of all rows that aren't to be taken as unlabelled."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def sample(ids: DataFrame) -> DataFrame:
        return ids.where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    p = sample(positives.select(F.col(doc_id).alias("doc_id"))).withColumn("positive", F.lit(True))
    u = sample(docs.select("doc_id").join(labelled.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_anti")).withColumn("positive", F.lit(False))
    chosen = docs.join(F.broadcast(p.union(u)), "doc_id")  # at most 2 * SAMPLE rows are broadcast
    rows = stored(features(chosen.select("doc_id", "positive", "text")).where("features is not null"), "quality").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    positive, unlabelled = (np.array([r.features for r in rows if r.positive == kind]) for kind in (True, False))
    if len(positive) < 4 or len(unlabelled) < 4:
        return Model(None, 0.0)
    first = train(positive[::2], unlabelled[::2], None)
    unseen = first.margin(positive[1::2])
    cuts = cuts_of(unseen)
    known = docs.sparkSession.sparkContext.broadcast((first, cuts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, edges = known.value
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                found = [describe(x) for x in utf8(batch.column("text"))]
                full = [i for i, x in enumerate(found) if x is not None]
                if full:
                    at = np.searchsorted(edges, net.margin(np.array([found[i] for i in full])), "right")
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(full)), pa.array(at)], ["doc_id", "bin"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    bins = docs.where("doc_id is not null").mapInArrow(tidied(place), f"doc_id {kind}, bin long")
    unseen_rows = bins.join(labelled.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_anti").groupBy("bin").agg(F.count("*").alias("n"))
    counts = np.zeros(len(cuts) + 1, np.int64)
    for r in unseen_rows.collect():  # at most CUTS + 1 rows
        counts[r.bin] = r.n
    prior = estimated_prior(unseen, cuts, counts)
    weights = standing_for(np.searchsorted(cuts, first.margin(unlabelled), "right"), counts)
    return Model(train(positive, unlabelled, prior, weights=weights), prior)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, the probability of good quality."""
    docs = docs.drop(*[c for c in ("score",) if c != text])
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = known.value.network
        for whole in batches:
            for batch in slices(whole, text, 4 << 20):
                found = [describe(x) for x in utf8(batch.column(text))]
                full = [i for i, x in enumerate(found) if x is not None]
                out = np.zeros(batch.num_rows)
                if net and full:
                    out[full] = net.probability(np.array([found[i] for i in full]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["score double"]))


def held_out() -> Column:
    return F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out() & (F.col("quality") == 1)), labels.where(~held_out()))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
