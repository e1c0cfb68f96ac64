"""Token ids of whole texts, with each distinct piece of text put through the tokenizer once for a worker.

Both vocabularies cut a text into pre-tokens before merging, so the ids of a text are the ids of its pieces one after the
other, provided that the text is only cut where a pre-token must end. The cuts used here are at white space and at
single full stops and commas that stand between letters, digits, blanks and line ends. A text in which these meet
anything else is cut at blanks only, and a text with unusual white space, with the literal of a special token or (for the
lower-case vocabulary) with a character that normalisation might change is encoded whole by the tokenizer, so that its
ids are those of ``Tokenizer.encode(text, add_special_tokens=False)`` in every case.

Cutting, and finding the distinct pieces of a batch, is left to Arrow's kernels; a piece that the worker hasn't met goes
to the vocabulary's merge model if it is one pre-token for certain, else through the whole tokenizer.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pieces that a worker remembers at least and at most half of (about 250 bytes each); longer ones aren't remembered.
REMEMBERED, LONGEST = 300_000, 64

#: Stands before a text that mustn't be cut; it is in no piece of one that is.
_WHOLE = "\0"
_BESIDE_STOPS = r"0-9A-Za-zÀ-ÖØ-öø-ɏ"
_STOPS_MEET = rf"[.,][^ \n{_BESIDE_STOPS}]|[^ \n{_BESIDE_STOPS}][.,]"
_ODD_SPACE = r"\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BYTE_WHOLE = rf"[ \n][ \n]|[{_ODD_SPACE}]|\x00"
_BYTE_NO_STOPS = rf"[ \n][.,]|{_STOPS_MEET}"
_ASCII_PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+| ")
_ASCII_WORD_PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+")


@cache
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be printed, else the next free one from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _settled(c: str) -> bool:
    """Whether normalisation leaves a character by itself: no marks, composed, and one letter in lower case."""
    low, kind = c.lower(), unicodedata.category(c)
    return kind[0] in "LNPSZ" and not 0x1100 <= ord(c) <= 0x11FF and len(low) == 1 and unicodedata.normalize("NFC", c) == c and unicodedata.normalize("NFC", low) == low and c.isalpha() == low.isalpha()


@cache
def unsettled_class() -> str:
    """A character class of all but the settled characters up to U+2BFF, and CJK and Hangul syllables, as a rule says which these are."""
    runs: list[list[int]] = []
    for c in [*range(0x20), *range(0x20, 0x2C00)]:
        if c in (9, 10, 13) or (c > 31 and _settled(chr(c))):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    runs += [[0x3041, 0x3096], [0x30A1, 0x30FA], [0x4E00, 0x9FA5], [0xAC00, 0xD7A3]]
    return "[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]"


class Pieces:
    """Texts -> token ids. words: the vocabulary is lower-case and drops white space; else a word begins with its leading space."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = self.tokenizer.normalizer is not None
        self.letters = byte_letters()
        self.blank = self.letters[32]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.whole = "|".join(filter(None, [special, unsettled_class() if self.words else _BYTE_WHOLE]))
        self.no_stops = _STOPS_MEET if self.words else _BYTE_NO_STOPS
        self.parts = _ASCII_WORD_PARTS if self.words else _ASCII_PARTS

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def merged(self, part: str) -> bytes:
        """The ids of one pre-token."""
        if part.isascii():
            letters = self.blank + part[1:] if part[0] == " " else part
        else:
            letters = part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def piece(self, x: str) -> bytes:
        """The ids of a piece that isn't among those known."""
        if (value := self.older.get(x)) is None:
            if not x:
                value = b""
            elif x[0] == _WHOLE or len(x) > LONGEST:
                return self.ids(x[1:] if x[0] == _WHOLE else x)
            elif "\n" in x:
                value = self.ids(x)
            else:
                low = x.replace("Σ", "σ").lower() if self.words else x  # letter by letter: a final sigma isn't told apart
                if low.isalpha() or (low[0] == " " and low[1:].isalpha()):
                    value = self.merged(low)
                else:
                    value = b"".join(map(self.merged, self.parts.findall(low))) if low.isascii() else self.ids(x)
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        self.known[x] = value
        return value

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """The pieces of each text."""
        whole = pc.match_substring_regex(texts, self.whole)
        stops = pc.invert(pc.match_substring_regex(texts, self.no_stops))
        parts, places = [], []
        for mask, by_blank, by_stop in ((whole, False, False), (pc.and_(pc.invert(whole), stops), True, True), (pc.and_(pc.invert(whole), pc.invert(stops)), True, False)):
            own = texts.filter(mask)
            if not len(own):
                continue
            places.append(np.flatnonzero(mask.to_numpy(zero_copy_only=False)))
            if not by_blank:
                marked = pc.binary_join_element_wise(_WHOLE, own, "")
                parts.append(pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32)), marked))
                continue
            if self.words:
                for x in "\n\t\r":
                    own = pc.replace_substring(own, x, " ")
            else:
                own = pc.replace_substring(own, " ", "\0 ")
            mark = " " if self.words else "\0"
            if by_stop:
                for x in ",." if self.words else ",.\n":
                    own = pc.replace_substring(own, x, f"{mark}{x}{mark}")
            parts.append(pc.split_pattern(own, mark))
        order = np.argsort(np.concatenate(places))
        return pa.concat_arrays(parts).take(pa.array(order))

    def encode(self, texts: pa.Array, end: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (nulls are empty), one after the other, and how many each has. end: an id to put behind each text."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        found = self.cut(pc.fill_null(texts.cast(pa.string()), ""))
        at = np.asarray(found.offsets)
        coded = found.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at = at - at[0]
        names = coded.dictionary.to_pylist()
        values = list(map(self.known.get, names))
        for i in [i for i, x in enumerate(values) if x is None]:
            values[i] = self.piece(names[i])
        sizes = np.array([len(x) >> 2 for x in values], np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        each = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(values), "<u4")))
        index = np.asarray(coded.indices)
        ids = np.asarray(each.take(coded.indices).flatten())
        before = np.concatenate([[0], np.cumsum(sizes[index])])
        counts = np.diff(before[at])
        if end is None:
            return ids, counts
        out = np.full(len(ids) + len(counts), end, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
        return out, counts + 1

    def of(self, text: str | None) -> list[int]:
        return self.encode(pa.array([text], pa.string()), None)[0].tolist()


@cache
def pieces(path: str) -> Pieces:
    """One for each worker process and vocabulary."""
    return Pieces(path)


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)
