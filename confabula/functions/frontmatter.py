"""The fields at the head of a skill document, as JSON text.

The part of YAML that documents use: maps and lists in any depth, by indentation or in brackets, plain and quoted scalars, text in
blocks (| and >, with + and -), comments. Plain scalars have the types of YAML 1.1, but dates stay text.

Defined cases: null text gives null; anything that isn't a map gives an empty map, and so does text that can't be read (tabs
as indentation, open quotes or brackets, anchors, tags); of a key that comes twice the last value counts.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'\[\]{}#&*!|>%@`,](?:(?!:\s|:$|\s\#).)*?)\s*:(?:\s+(.*))?$""")
_BLOCK = re.compile(r"([|>])([+-]?)[1-9]?([+-]?)\s*(?:#.*)?$")
_INT, _FLOAT = re.compile(r"[-+]?(0|[1-9][0-9_]*)$"), re.compile(r"[-+]?([0-9][0-9_]*)?\.[0-9]+([eE][-+]?[0-9]+)?$|[-+]?[0-9]+\.([eE][-+]?[0-9]+)?$")
#: Words with a meaning, and escapes in double quotes.
_WORDS = {"": None, "~": None, "null": None, "true": True, "yes": True, "on": True, "false": False, "no": False, "off": False}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "e": "\x1b", '"': '"', "\\": "\\", "/": "/", " ": " "}
_HEX = {"x": 2, "u": 4, "U": 8}


class Unreadable(ValueError):
    pass


def plain(text: str):
    if text.lower() in _WORDS and text in (text.lower(), text.capitalize(), text.upper()):
        return _WORDS[text.lower()]
    if _INT.match(text):
        return int(text.replace("_", ""))
    return float(text.replace("_", "")) if _FLOAT.match(text) else text


def quoted(text: str, at: int) -> tuple[str, int]:
    """The text in the quotes that begin there, and where they end."""
    mark, out, i = text[at], [], at + 1
    while i < len(text):
        c = text[i]
        if c == mark and mark == "'" and text[i + 1 : i + 2] == "'":
            out.append("'")
            i += 2
        elif c == mark:
            return "".join(out), i + 1
        elif c == "\\" and mark == '"':
            kind = text[i + 1 : i + 2]
            if kind in _HEX:
                out.append(chr(int(text[i + 2 : i + 2 + _HEX[kind]], 16)))
                i += 2 + _HEX[kind]
            elif kind in _ESCAPES:
                out.append(_ESCAPES[kind])
                i += 2
            else:
                raise Unreadable(text)
        else:
            out.append(c)
            i += 1
    raise Unreadable(text)


def inline(text: str, at: int, ends: str = "") -> tuple[object, int]:
    """The value that begins there: in brackets, in quotes, or plain up to one of the letters of ends."""
    at += len(text[at:]) - len(text[at:].lstrip())
    first = text[at : at + 1]
    if first in ("'", '"') and first:
        return quoted(text, at)
    if first not in ("[", "{") or not first:
        found = re.compile(rf"(?:(?!\s#|:\s|:$)[^{re.escape(ends)}])*" if ends else r"(?:(?!\s#).)*").match(text, at)
        if first in ("&", "*", "!", "%", "@", "`") and first:
            raise Unreadable(text)
        if not ends and re.search(r":(\s|$)", found.group()):
            raise Unreadable(text)
        return plain(found.group().strip()), found.end()
    close, out = ("]", []) if first == "[" else ("}", {})
    at += 1
    while True:
        at += len(text[at:]) - len(text[at:].lstrip())
        if text[at : at + 1] == close:
            return out, at + 1
        value, at = inline(text, at, ",[]{}")
        at += len(text[at:]) - len(text[at:].lstrip())
        if close == "}":
            of = None
            if text[at : at + 1] == ":":
                of, at = inline(text, at + 1, ",[]{}")
            out[str(value)] = of
        else:
            out.append(value)
        at += len(text[at:]) - len(text[at:].lstrip())
        if text[at : at + 1] == ",":
            at += 1
        elif text[at : at + 1] != close:
            raise Unreadable(text)


class Document:
    def __init__(self, text: str):
        self.lines, self.at = text.splitlines(), 0

    def here(self) -> tuple[int, str] | None:
        """Indentation and text of the next line that isn't empty or a comment."""
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or self.lines[self.at].lstrip().startswith("#")):
            self.at += 1
        if self.at == len(self.lines):
            return None
        line = self.lines[self.at].lstrip(" ")
        if line.startswith("\t"):
            raise Unreadable(line)
        return len(self.lines[self.at]) - len(line), line.rstrip()

    def value(self, least: int):
        """The value whose lines begin here, at that indentation or more."""
        found = self.here()
        if found is None or found[0] < least:
            return None
        indent, line = found
        if line == "-" or line.startswith("- "):
            return self.list(indent)
        if _KEY.match(line):
            return self.map(indent)
        self.at += 1
        return self.after(line, indent - 1)

    def list(self, indent: int) -> list:
        out = []
        while (found := self.here()) and found[0] == indent and (found[1] == "-" or found[1].startswith("- ")):
            item = found[1][1:].lstrip()
            if _KEY.match(item) or item == "-" or item.startswith("- "):
                inner = indent + len(found[1]) - len(item)
                self.lines[self.at] = " " * inner + item
                out.append(self.value(inner))
            else:
                self.at += 1
                out.append(self.after(item, indent))
        return out

    def map(self, indent: int) -> dict:
        out = {}
        while (found := self.here()) and found[0] == indent and (pair := _KEY.match(found[1])):
            self.at += 1
            key = quoted(pair[1], 0)[0] if pair[1][0] in "'\"" else str(pair[1])
            out[key] = self.after(pair[2] or "", indent)
        if found and found[0] > indent:
            raise Unreadable(found[1])
        return out

    def after(self, text: str, indent: int):
        """The value that begins with the rest of a line at that indentation."""
        if not text or text.startswith("#"):
            found = self.here()
            same = found and found[0] == indent and (found[1] == "-" or found[1].startswith("- ")) and indent >= 0 and self.lines[self.at - 1].strip()[:2] != "- "
            return self.list(indent) if same else self.value(indent + 1)
        if block := _BLOCK.match(text):
            return self.block(block[1], block[2] or block[3], indent)
        lines = [text]
        while (found := self.here()) and found[0] > indent:
            lines.append(found[1])
            self.at += 1
        whole = " ".join(lines)
        value, end = inline(whole, 0)
        if whole[end:].strip() and not whole[end:].lstrip().startswith("#"):
            raise Unreadable(whole)
        return value

    def block(self, kind: str, chomp: str, indent: int) -> str:
        lines = []
        while self.at < len(self.lines) and (not (line := self.lines[self.at]).strip() or len(line) - len(line.lstrip(" ")) > indent):
            lines.append(line)
            self.at += 1
        cut = next((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), 0)
        lines = [x[cut:] for x in lines]
        last = len(lines)
        while last and not lines[last - 1].strip():
            last -= 1
        text = "\n".join(lines[:last])
        if kind == ">":
            text = re.sub(r"(?<=[^\n])\n(\n*)(?=[^\n ])", lambda m: m[1] or " ", text)
        return text + {"-": "", "+": "\n" * (len(lines) - last + 1), "": "\n"}[chomp] if text else ""


def fields(text: str) -> dict:
    document = Document(text)
    try:
        found = document.value(0)
        return found if isinstance(found, dict) and document.here() is None else {}
    except (Unreadable, ValueError, IndexError, RecursionError):
        return {}


def as_json(front: Column) -> Column:
    """The fields of a head (the lines between the two ---) as a JSON object."""

    @F.pandas_udf("string")
    def read(heads: pd.Series) -> pd.Series:
        return heads.map(lambda x: None if x is None else json.dumps(fields(x), ensure_ascii=False))

    return read(front)
