"""Alignment of two tokenizers: where tokens of both end together, and which ids go together over the whole corpus.

Texts are worked on a batch at a time. The bytes of a batch's texts are one array with the offset of every document; the
tokens of all documents, in both tokenizations, are one row of ids each, and the prefix sums of their byte lengths are their
ends. Two bincounts over byte offsets mark the ends of A and of B once for the batch, and the batch is cut where both occur.
Prefix sums of the cuts, read at the documents' offsets, give each document's groups and links; the same sums number the
groups, so that the text of a group list is put together for all documents at once.

How often an id pair is linked is counted over all documents: each task adds up the pairs of its links, Spark adds up the
tasks' sums. Of two tokens that end together one's bytes are a suffix of the other's, so there are no more pairs than all
entries of both vocabularies have bytes (about half a million), however large the corpus is; that table is broadcast for a
second pass over the stored links.

B's model is given a text in units, each distinct one once for a worker: a unit begins with blanks or line ends, and the text is
cut before these only if no entry of the vocabulary has a blank behind another character, or a line end, so that no merge
crosses a cut. Other texts, and those that have the vocabulary's mark for a blank in them, are encoded whole.

Defined cases: null and empty texts, and texts of which A's or B's tokens don't give the bytes back, have no tokens: zeros, and an
empty text for the groups; strings of special tokens are plain text; texts of any length are aligned whole (a single unit
without blanks is encoded in one call); doc_id must be an integer, rows with a null or repeated one are kept and counted like others; an
empty table gives an empty result; only the columns of the result are returned, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, packed, slices, stored, table, tidied
from .tokenization import _BYTE_WHOLE, LONGEST, REMEMBERED, Pieces, vocabulary

#: How the vocabulary of B writes a blank.
MARK = "▁"
_UNIT = re.compile(r" +[^ \n]*|\n+[^ \n]*")


class Entries:
    """The bytes of every entry of a vocabulary, and its id in decimal digits."""

    def __init__(self, entries: list[bytes]):
        self.n = len(entries)
        self.lengths = np.array([len(x) for x in entries], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        self.digits = np.array([str(i).encode() for i in range(self.n)], "S8").view(np.uint8).reshape(self.n, 8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after the other."""
        lengths = self.lengths[ids]
        before = np.cumsum(lengths) - lengths
        return self.bytes[np.repeat(self.starts[ids] - before, lengths) + np.arange(int(lengths.sum()))]


class BytePieces(Pieces):
    """The byte-level vocabulary, for which special tokens in a text are plain text; of a text with a blank put before it."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.whole = _BYTE_WHOLE
        values = {c: b for b, c in self.letters.items()}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.entries = Entries([bytes(values[c] for c in x) for x in names])


class WordPieces:
    """The vocabulary of pieces with a mark for blanks, which puts a blank before a text itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(len(self.model))]
        self.entries = Entries([bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(names)])
        self.cuttable = not any(re.search(rf"[^{MARK}]{MARK}|\n", x) for x in names)
        self.blank = [self.model.piece_to_id(MARK)]
        self.known: dict[str, bytes] = {}

    def unit(self, x: str) -> bytes:
        """The ids of a unit; it begins with a blank, which the model puts there, or with a line end, before which the model's blank is dropped."""
        ids = self.blank if x == " " else self.model.encode(x[1:], num_threads=1) if x[0] == " " else self.model.encode(x, num_threads=1)[1:]
        value = np.array(ids, "<u4").tobytes()
        if len(x) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[x] = value
        return value

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if not self.cuttable or MARK in text:
            return np.array(self.model.encode(text, num_threads=1), np.uint32)
        known, unit = self.known, self.unit
        return np.frombuffer(b"".join([known.get(x) or unit(x) for x in _UNIT.findall(f" {text}")]), "<u4")


@cache
def tokenizers(path_a: str, path_b: str) -> tuple[BytePieces, WordPieces]:
    """One pair for each worker process."""
    return BytePieces(path_a), WordPieces(path_b)


def edges(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def aligned_batch(data: np.ndarray, sizes: np.ndarray, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, one: Entries, other: Entries) -> dict[str, np.ndarray]:
    """Per document: ok (both tokenizations give its bytes), n_a, n_b, n_groups, n_links, the bounds of its links and of its groups' text; and these.

    data: the bytes of all documents; sizes: of each; a and b: the ids of all documents in both vocabularies, n_a and n_b of each.
    """
    ok = sizes > 0
    for tell in (lambda ids, n, own: np.diff(np.cumsum(np.concatenate([[0], own.lengths[ids]]))[edges(n)]) == sizes, lambda ids, n, own: gives_bytes(data, sizes, ids, n, own)):
        ok = ok & tell(a, n_a, one) & tell(b, n_b, other)
        # the next test, and all below, is on documents that are right so far
        a, b, data = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)], data[np.repeat(ok, sizes)]
        n_a, n_b, sizes = (np.where(ok, x, 0) for x in (n_a, n_b, sizes))
    ends_a, ends_b = np.cumsum(one.lengths[a]), np.cumsum(other.lengths[b])
    at_a, at_b = (np.bincount(x, minlength=len(data) + 1) for x in (ends_a, ends_b))
    cut = (at_a > 0) & (at_b > 0)
    before = np.cumsum(cut)
    places = edges(sizes)
    groups = np.diff(before[places])
    links = np.diff(np.cumsum(at_a * at_b)[places])
    last_a, last_b = np.flatnonzero(cut[ends_a]), np.flatnonzero(cut[ends_b])  # an entry has bytes, so one token ends at a cut
    pairs = a[last_a].astype(np.uint64) * np.uint64(other.n) + b[last_b]

    group_a, group_b = before[ends_a] - cut[ends_a], before[ends_b] - cut[ends_b]
    place_a = np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]
    place_b = np.arange(len(b)) + (last_a + 1)[group_b]
    text = np.zeros((len(a) + len(b), 8), np.uint8)  # five digits at most, and a sign in the last place
    text[place_a], text[place_b] = one.digits[a], other.digits[b]
    text[place_a, 7], text[place_b, 7] = ord(","), ord(",")
    text[place_a[last_a], 7], text[place_b[last_b], 7] = ord("|"), ord(";")
    tokens = edges(n_a + n_b)
    text[tokens[1:][ok] - 1, 7] = 0
    bounds = np.concatenate([[0], np.cumsum((text > 0).sum(axis=1))])[tokens]
    flat = text.ravel()
    return {"ok": ok, "n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": links, "pairs": pairs, "pair_bounds": edges(links), "text": flat[flat > 0], "text_bounds": bounds}


def gives_bytes(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, n: np.ndarray, own: Entries) -> np.ndarray:
    """Whether the tokens' bytes are those of the document; their number is right already."""
    return np.diff(np.concatenate([[0], np.cumsum(own.joined(ids) != data)])[edges(sizes)]) == 0


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links (pairs a * size of B + b, little-endian unsigned 64-bit); groups: also their text."""
    docs = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = tokenizers(path_a, path_b)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
                spaced = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise("", texts, " "))
                data, bounds = packed(spaced)
                a, n_a = one.encode(spaced, None)
                own = [other.ids(x) for x in texts.to_pylist()]
                n_b = np.array([len(x) for x in own], np.int64)
                found = aligned_batch(data, np.diff(bounds), a, n_a, np.concatenate([np.zeros(0, np.uint32), *own]), n_b, one.entries, other.entries)
                told, linked, starts, ok = found["text"].tobytes(), found["pairs"].astype("<u8").tobytes(), found["text_bounds"].tolist(), found["ok"].tolist()
                lists = [told[x:y] for x, y in zip(starts, starts[1:], strict=False)]
                links = [linked[8 * x : 8 * y] for x, y in zip(found["pair_bounds"].tolist(), found["pair_bounds"].tolist()[1:], strict=False)]
                columns = [batch.column("doc_id"), *[pa.array(found[c]) for c in _COUNTS], pa.array([hashlib.sha256(x).hexdigest() if y else "" for x, y in zip(lists, ok, strict=True)], pa.string()), pa.array(links, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([x.decode() for x in lists], pa.string())] if groups else []), ["doc_id", *_COUNTS, "groups_sha256", "links"] + ["groups"] * groups)

    return docs.mapInArrow(tidied(run), f"doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, groups_sha256 string, links binary" + ", groups string" * groups)


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _links(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(packed(batch.column("links"))[0], "<u8")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links of all documents hold the id pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            own, n = np.unique(_links(batch), return_counts=True)
            pairs, where = np.unique(np.concatenate([pairs, own]), return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, where, np.concatenate([counts, n]))
            counts = total
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], ["pair", "n"])

    return aligned.select("links").mapInArrow(tidied(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def scored(aligned: DataFrame, counts: DataFrame, size_b: int) -> DataFrame:
    """aligned with n_best (links whose count is the highest of their B id) and count_sum (of the counts of its links)."""
    found = counts.orderBy("pair").toArrow()  # bounded by the vocabularies' bytes
    pairs, n = found["pair"].to_numpy().astype(np.uint64), found["n"].to_numpy()
    highest = np.zeros(size_b, np.int64)
    np.maximum.at(highest, (pairs % np.uint64(size_b)).astype(np.int64), n)
    known = aligned.sparkSession.sparkContext.broadcast((pairs, n, n == highest[(pairs % np.uint64(size_b)).astype(np.int64)]))
    names = [c for c in aligned.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            at = np.searchsorted(pairs, _links(batch))
            bounds = edges(batch.column("n_links").to_numpy())
            sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(x[at].astype(np.int64))])[bounds])) for x in (best, n)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + sums, [*names, "n_best", "count_sum"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name != "links")
    return aligned.mapInArrow(tidied(run), types + ", n_best long, count_sum long")


def alignments(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """Per row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; groups: also the groups as text."""
    aligned = stored(align(docs, path_a, path_b, doc_id, text, groups), "aligned")
    size_b = len(sentencepiece.SentencePieceProcessor(model_file=path_b))
    return scored(aligned, pair_counts(aligned), size_b)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
