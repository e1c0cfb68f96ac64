"""Words of scripts that are written without spaces, by a lexicon with frequencies.

A run of such letters is cut where the product of the words' frequencies is highest. Costs are whole numbers (thousandths of
minus the logarithm of the frequency), so every engine finds the same path; of equal paths the one whose last word is longer is
taken, and so on backwards. A letter alone is always possible; outside the lexicon it counts as a word found once.

For an index, a word also gives the words of two and three letters inside it, so that they find it; a query is only cut.
Letters alone can't be searched; stretches of them are given as overlapping pairs, so that names the lexicon doesn't have are found.

Defined cases: null texts have no tokens (null), empty ones an empty list; a run of any length is cut whole, in memory in
proportion to it; an empty lexicon gives pairs everywhere; words of a lexicon that are null, empty or of count 0 don't count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from math import floor, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most words of a lexicon (the most frequent), so its broadcast is bounded; longest word.
MOST_WORDS, LONGEST = 1_000_000, 16
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"
#: Runs whose cut a task remembers.
REMEMBERED = 100_000


@dataclass(frozen=True)
class Lexicon:
    counts: dict[str, int] = field(repr=False)

    @classmethod
    def of(cls, words: DataFrame, most: int = MOST_WORDS) -> Lexicon:
        """words: (word, n). The most frequent ones, up to that many; ties in order of the word."""
        good = words.where(f"n > 0 AND length(word) BETWEEN 1 AND {LONGEST}").groupBy("word").agg(F.sum("n").alias("n"))
        found = good.orderBy(F.desc("n"), "word").limit(most).toArrow()
        return cls(dict(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True)))

    @cached_property
    def costs(self) -> dict[str, int]:
        total = max(2, sum(self.counts.values()))
        return {w: floor(1000 * log(total / n) + 0.5) for w, n in self.counts.items()}

    @cached_property
    def unknown(self) -> int:
        return floor(1000 * log(max(2, sum(self.counts.values()))) + 0.5)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.counts), default=1)

    def path(self, run: str) -> list[str]:
        """The words of the most probable path."""
        best, begin = [0], [0]
        for end in range(1, len(run) + 1):
            choices = [(best[end - 1] + self.costs.get(run[end - 1], self.unknown), end - 1)]
            for start in range(max(0, end - self.longest), end - 1):
                if (cost := self.costs.get(run[start:end])) is not None:
                    choices.append((best[start] + cost, start))
            cost, start = min(choices)
            best.append(cost)
            begin.append(start)
        out, end = [], len(run)
        while end:
            out.append(run[begin[end] : end])
            end = begin[end]
        return out[::-1]

    def searched(self, run: str, inner: bool = True) -> list[str]:
        """The tokens of a run. inner: with the words inside words."""
        out, alone = [], ""
        for word in [*self.path(run), ""]:
            if len(word) == 1:
                alone += word
                continue
            out += [alone[i : i + 2] for i in range(len(alone) - 1)]
            alone = ""
            if inner:
                out += [word[i : i + n] for n in (2, 3) if n < len(word) for i in range(len(word) - n + 1) if word[i : i + n] in self.costs]
            out += [word] if word else []
        return out


class Segmenter:
    """Column functions that cut texts by a lexicon, which is broadcast once. unspaced: the class of letters that are cut; texts
    without one never reach Python."""

    def __init__(self, words: DataFrame, unspaced: str = UNSPACED, most: int = MOST_WORDS):
        self.unspaced, self.lexicon = unspaced, Lexicon.of(words, most)
        self._sent = words.sparkSession.sparkContext.broadcast(self.lexicon)

    def _cut(self, runs: Column, cut: Callable[[Lexicon, str], list[str]]) -> Column:
        """Each run's words, for rows that have any run."""
        sent = self._sent

        @F.pandas_udf("array<array<string>>")
        def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: dict[str, list[str]] = {}
            for batch in batches:
                out = []
                for row in batch:
                    if len(known) > REMEMBERED:
                        known.clear()
                    for run in () if row is None else row:
                        if run not in known:
                            known[run] = cut(sent.value, run)
                    out.append(None if row is None else [known[run] for run in row])
                yield pd.Series(out, dtype=object)

        return words(F.when(F.size(runs) > 0, runs))

    def path(self, run: Column) -> Column:
        """A run's most probable words."""
        return F.element_at(self._cut(F.when(run != "", F.array(run)), lambda lexicon, x: lexicon.path(x)), 1)

    def _tokens(self, text: Column, inner: bool) -> Column:
        split = F.regexp_extract_all(F.lower(text), F.lit(rf"{self.unspaced}+|(?:(?!{self.unspaced})[\p{{L}}\p{{N}}])+"), F.lit(0))
        pieces = F.filter(split, lambda x: F.length(x) >= 2)
        dense = F.filter(pieces, lambda x: x.rlike(f"^{self.unspaced}"))
        spaced = F.filter(pieces, lambda x: ~x.rlike(f"^{self.unspaced}"))
        cut = F.flatten(self._cut(dense, lambda lexicon, x: lexicon.searched(x, inner)))
        return F.when(F.size(dense) > 0, F.concat(spaced, cut)).otherwise(pieces)

    def tokens(self, text: Column) -> Column:
        """For an index: words, and the words inside them."""
        return self._tokens(text, True)

    def query_tokens(self, text: Column) -> Column:
        """For a query: words only."""
        return self._tokens(text, False)


def discovered(texts: DataFrame, text: str, unspaced: str = UNSPACED, longest: int = 4, least: int = 5, cohesion: float = 20.0, freedom: int = 3) -> DataFrame:
    """(word, n): words of a corpus without spaces, found from the corpus itself. A string of two to longest letters is a word if it
    comes least times, the letters hold together (in every cut into two it comes at least cohesion times as often as if its halves
    were independent), and at least freedom different letters, or ends of a run, are on either side of it."""
    run = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"{unspaced}+"), F.lit(0)))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run")))
    at = texts.select(run.alias("run")).select("run", F.explode(sizes).alias("size")).select("run", "size", F.explode(F.sequence(F.lit(1), F.length("run") - F.col("size") + 1)).alias("i"))
    beside = at.select(
        F.substr("run", F.col("i"), F.col("size")).alias("word"),
        F.when(F.col("i") > 1, F.substr("run", F.col("i") - 1, F.lit(1))).otherwise("").alias("before"),
        F.substr("run", F.col("i") + F.col("size"), F.lit(1)).alias("after"),
    )
    counts = beside.groupBy("word").agg(F.count("*").alias("n"), F.approx_count_distinct("before", 0.02).alias("b"), F.approx_count_distinct("after", 0.02).alias("a"))
    letters = counts.where("length(word) = 1").agg(F.sum("n").alias("letters"))  # one row
    strings = counts.where((F.length("word") > 1) & (F.col("n") >= least) & (F.least("a", "b") >= freedom)).crossJoin(F.broadcast(letters))
    halves = strings.withColumn("k", F.explode(F.expr("sequence(1, length(word) - 1)"))).select("word", "n", "letters", F.expr("left(word, k)").alias("left"), F.expr("substr(word, k + 1)").alias("right"))
    own = lambda side: counts.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}"))
    held = halves.join(own("left"), "left").join(own("right"), "right").withColumn("times", F.col("n") * F.col("letters") / (F.col("n_left") * F.col("n_right")))
    return held.groupBy("word", "n").agg(F.min("times").alias("times")).where(F.col("times") >= cohesion).select("word", "n")
