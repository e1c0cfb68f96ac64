"""Token counts by a tokenizer, where a vocabulary file is at hand."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _counter(vocabulary: str):
    """Tokens of a text by the vocabulary file; its characters where the tokenizer can't be loaded or fails on the text."""
    try:
        from tokenizers import Tokenizer

        encode = Tokenizer.from_file(vocabulary).encode
    except Exception:
        encode = None

    def count(x: str | None) -> int:
        if not x:
            return 0
        try:
            return len(encode(x, add_special_tokens=False).ids) if encode else len(x)
        except Exception:
            return len(x)

    return count


def token_count(text: Column, vocabulary: str) -> Column:
    """Tokens of each text by the vocabulary file, batch by batch; null and empty texts have none.

    Where the tokenizer can't be loaded, or fails on a text, its characters are counted.
    """

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = _counter(vocabulary)
        for batch in batches:
            yield batch.map(one, na_action=None).astype("int64")

    return F.pandas_udf(count, "long")(text)


def vocabulary_of(model: str | None, vocabularies: dict[str, str], default: str) -> str:
    """The vocabulary file of a model: that of its name, else of the longest pattern (* and ?) that fits it, else the default."""
    if model in vocabularies:
        return vocabularies[model]
    fits = [p for p in vocabularies if model is not None and fnmatchcase(model, p)]
    return vocabularies[max(fits, key=lambda p: (len(p), p))] if fits else default


def token_count_by_model(text: Column, model: Column, vocabularies: dict[str, str], default: str) -> Column:
    """token_count() by the vocabulary of each row's model; models that aren't known, and null ones, take the default vocabulary.

    A worker loads each vocabulary that its rows ask for once.
    """

    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        counters: dict[str, object] = {}
        for texts, models in batches:
            files = models.map(lambda m: vocabulary_of(m if isinstance(m, str) else None, vocabularies, default))
            for file in set(files) - set(counters):
                counters[file] = _counter(file)
            yield pd.Series([counters[f](x) for f, x in zip(files, texts, strict=True)], dtype="int64")

    return F.pandas_udf(count, "long")(text, model)
