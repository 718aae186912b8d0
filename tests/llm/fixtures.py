"""Small tables with the odd rows that every operator must take: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, `row` string, text_key int, score string, "
          "unit long, shard string, `size` int, `key` string")


def vocabulary(n: int = 60, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def sentence(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def docs(spark, rows):
    """``rows`` of (doc_id, text, source) with more columns whose names the operators use themselves."""
    full = [(i, t, "en" if (i or 0) % 2 else None, s, len(t) if t else None, "r", 1, "s", 2, "old", 3, "k") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows(seed: int = 3) -> list[tuple]:
    rng, words = random.Random(seed), vocabulary()
    long = sentence(rng, words, 6000)
    base = sentence(rng, words, 40)
    return [(1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, long, "b"), (5, base, "a"), (6, base, None),
            (6, base, None), (None, base, "c"), (None, None, None), (7, base + " " + words[0], "b"), (8, "one", "a"),
            (9, "ONE", "b"), (5, sentence(rng, words, 25), "a")]


def union_find(n: int, links) -> list[int]:
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]
