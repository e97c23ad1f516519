"""Small frames with what real tables hold: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like those the operators make themselves.
CLASHING = {"size": 1, "key": "k", "rid": 2, "h": 3, "kept": True, "component_id": 4, "score": 0.5, "target": 1.0}


def words(rng: random.Random, n: int) -> list[str]:
    syllables = ["an", "the", "re", "ti", "on", "Ed", "ST", "ou", "ñe", "é", "ing", "ly"]
    return ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]


def documents(seed: int = 3, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    passage = " ".join(words(rng, 120))
    line = "the same line again and again. " * 30
    out = []
    for i in range(n):
        text = " ".join(words(rng, rng.choice([1, 3, 40, 150, 400])))
        if i % 5 == 0:
            text = f"{text} {passage} {' '.join(words(rng, 20))}"
        if i % 11 == 0:
            text = text + "\n" + line
        if i % 7 == 3 and out:
            text = out[rng.randrange(len(out))][1]  # a copy
        if i % 7 == 5 and out and out[-1][1]:
            parts = out[-1][1].split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        out.append((i, text, "en", rng.choice(["a", "b", "c", None]), len(text or "")))
    out += [
        (n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \n\t ", "en", "a", 4), (n + 3, "one", "en", "b", 3),
        (n + 4, "ONE", "en", "b", 3), (None, "no id here", "en", "b", 10), (n + 5, "wörd x " * 9000, "de", "c", 63000),
        out[2], out[2], (n + 6, "a" * 3000, "en", "a", 3000), (n + 7, "😀 " * 500, "en", "d", 1000),
    ]
    return out


def frame(spark, rows=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, DDL)
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})


def empty(spark):
    return frame(spark, [])
