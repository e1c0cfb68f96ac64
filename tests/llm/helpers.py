"""Small fixtures and brute-force forms of the training-data operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def texts(seed=1, n=60):
    """Documents with copies, near copies, shared passages, ties, nulls, empty and long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghiéñ") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(120))

    def words(k):
        return [rng.choice(vocabulary) for _ in range(k)]

    out = [None, "", " \n\t", "one", "One", "two words", "Two  words", "x" * 1000, "ab " * 700, passage[:399], passage[:400], passage[:401]]
    for _ in range(n):
        kind = rng.random()
        base = [x for x in out if x and len(x) > 500]
        if kind < 0.15 and base:
            out.append(rng.choice(base))
        elif kind < 0.5 and base:
            w = rng.choice(base).split(" ")
            for _ in range(rng.randint(1, 1 + len(w) // 15)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary).upper()
            out.append(" ".join(w))
        elif kind < 0.7:
            a = rng.randint(0, 80)
            out.append(" ".join([*words(rng.randint(0, 60)), passage[a : a + rng.randint(380, 700)], *words(rng.randint(0, 60))]))
        else:
            out.append(" ".join(words(rng.randint(1, 300))) + ".\n" + " ".join(words(10)))
    out.append(" ".join(words(40_000)))
    rng.shuffle(out)
    return list(enumerate(out))
