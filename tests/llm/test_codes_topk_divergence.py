"""Vector codes, source divergence and exact top-k search against plain versions of their rules."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest

from marketloom.llm import source_divergence, top_k, vector_codes
from marketloom.llm.source_divergence import DivergenceSettings, terms_of
from marketloom.llm.top_k import TopKSettings
from marketloom.llm.vector_codes import CodeSettings

CLASHING = ("1 AS query", "2 AS score", "'x' AS code", "3 AS v", "4 AS part", "5 AS error", "6 AS low", "'y' AS x", "7 AS rank")
DDL = "vec_id long, embedding array<float>, label int"


def vectors(seed=5, n=150, width=8):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.0, rng.uniform(-1, 1)]) for _ in range(width)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(n + i, list(rows[3][1]), 1) for i in range(40)]  # copies tie with each other
    rows += [
        (900, None, 1), (901, [float("nan")] + [0.0] * (width - 1), 1), (902, [float("inf")] + [0.0] * (width - 1), 2),
        (903, [None] + [0.1] * (width - 1), 2), (904, [0.0] * width, None), (905, [0.5] * (width - 3), 2), (906, [], 2),
        (950, [1e30] * width, 1), (None, [0.3] * width, 1), (7, [0.9] * width, 2), rows[11], rows[11], (50, [-0.7] * width, 1),
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL).selectExpr("*", *CLASHING).repartition(3)


def whole(rows, scale):
    out = []
    for i, v, label in rows:
        if v is not None and all(c is not None and math.isfinite(c) and abs(c) < 1e9 for c in v):
            v = [math.floor(scale * float(np.float32(c))) for c in v]
            out.append((i, v, label))
    width = max((len(v) for _, v, _ in out), default=0)
    return [(i, v + [0] * (width - len(v)), label) for i, v, label in out]


def by_hand_codes(rows, s):
    kept = sorted(whole(rows, s.scale), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    length = -(-width // s.parts)
    split = [[(v + [0] * (length * s.parts - width))[p * length:(p + 1) * length] for p in range(s.parts)] for _, v, _ in kept]
    books = [[row[p] for row in split[:s.entries]] for p in range(s.parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(s.rounds):
        for p in range(s.parts):
            groups = defaultdict(list)
            for row in split:
                groups[near(row[p], books[p])[1]].append(row[p])
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    found = [[near(row[p], books[p]) for p in range(s.parts)] for row in split]
    errors = [sum(d for d, _ in f) for f in found]
    labels = Counter()
    for (_, _, label), e in zip(kept, errors):
        labels[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{k:02x}" for _, k in f), e, labels[label], digest) for (i, _, label), f, e in zip(kept, found, errors)), key=str)


@pytest.mark.parametrize("width,entries", [(8, 16), (10, 256), (1, 4)])
def test_codes_follow_the_rules(spark, width, entries):
    rows, s = vectors(width=width) if width > 3 else [(i, [i * 0.37 - 9], i % 2) for i in range(50)], CodeSettings(entries=entries)
    got = vector_codes.vector_codes(frame(spark, rows), settings=s)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == by_hand_codes(rows, s)


def test_codes_of_empty_and_void_tables(spark):
    assert vector_codes.vector_codes(frame(spark, [(1, [0.5], 1)]).where("false")).count() == 0
    assert vector_codes.vector_codes(frame(spark, [(1, None, 1), (2, [float("nan")], 1)])).count() == 0
    got = [tuple(r)[:4] for r in vector_codes.vector_codes(frame(spark, [(1, [], 1), (2, [], None)])).collect()]
    assert sorted(got) == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]


def test_transform_keeps_distances_and_rises_in_sequency():
    rng = np.random.default_rng(2)
    for length in (1, 2, 5, 16, 31):
        a, b = rng.integers(-3000, 3000, (2, 20, length))
        size = vector_codes.walsh_hadamard(a).shape[1]
        scaled = np.square(vector_codes.walsh_hadamard(a) - vector_codes.walsh_hadamard(b)).sum(1)
        assert (scaled == size * np.square(a - b).sum(1)).all()
        basis = vector_codes.walsh_hadamard(np.eye(size, dtype=np.int64)).T
        assert [(np.diff(row) != 0).sum() for row in basis] == list(range(size))
        rows, entries = rng.integers(-9, 9, (300, length)), rng.integers(-9, 9, (40, length))
        index, error = vector_codes.nearest(rows, entries)
        plain = np.square(rows[:, None] - entries[None]).sum(2)
        assert (index == plain.argmin(1)).all() and (error == plain.min(1)).all()


def by_hand_top(rows, s):
    kept = whole(rows, s.scale)
    out = []
    for i, q, _ in kept:
        if i is not None and i % s.every == 0:
            scored = [(-sum(a * b for a, b in zip(q, v)), j is None, j or 0, j) for j, v, _ in kept if j != i]
            out += [(i, r + 1, t[3], -t[0]) for r, t in enumerate(sorted(scored)[:s.k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("s", [TopKSettings(every=10, bins=4, row_block=16, query_block=4), TopKSettings(every=25, k=60, bins=64, row_block=50), TopKSettings()])
def test_top_k_follows_the_rules(spark, s):
    got = top_k.top_k(frame(spark, vectors()), settings=s)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == by_hand_top(vectors(), s)


def test_top_k_of_large_numbers_is_exact(spark):
    """Products beyond 2^53 are not exact in doubles."""
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-2e5, 2e5) for _ in range(6)], 1) for i in range(60)]
    s = TopKSettings(every=10)
    assert sorted(map(tuple, top_k.top_k(frame(spark, rows), settings=s).collect()), key=str) == by_hand_top(rows, s)


def test_top_k_of_few_rows(spark):
    assert top_k.top_k(frame(spark, [(1, [0.5], 1)]).where("false")).count() == 0
    assert top_k.top_k(frame(spark, [(50, [0.5], 1)])).count() == 0
    got = top_k.top_k(frame(spark, [(50, [0.5, 1.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (51, [0.0, 1.0], 1)])).collect()
    assert sorted(map(tuple, got)) == [(50, 1, 51, 65536), (50, 2, 1, 32768)]


def by_hand_divergence(rows, s):
    one = 10**9
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        text = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= s.least_docs]
        totals = {x: sum(counts[lang, x][t] for t in kept) for x in sources}

        def p(n, total):
            return 1 + one * (n + 2) // (total + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for x in sources:
            own = {t: p(counts[lang, x][t], totals[x]) for t in kept}
            pairs = [(-sum(f(own[t], p(counts[lang, y][t], totals[y])) for t in kept), y.encode(), y) for y in sources - {x}]
            every = {t: p(sum(counts[lang, y][t] for y in sources), sum(totals.values())) for t in kept}
            terms = [(-f(own[t], every[t]), t.encode(), t) for t in kept if counts[lang, x][t] and own[t] > every[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:s.ranks])):
                out += [(lang, x, part, i[2], -i[0], r + 1) for r, i in enumerate(items)]
    return sorted(out)


def texts(seed=4, n=300):
    rng = random.Random(seed)
    stock = [a + b for a in ["Ab", "été", "ß", "x", "ZÄ", "😀", "q"] for b in ["", "la", "É", "zz", "m"]]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "é", None, "", "Z"])
        some = rng.sample(stock, 12) if source == "s1" else stock
        rows.append((i, rng.choice([" ", "-", "1", "_\n"]).join(rng.choices(some, k=rng.randint(0, 25))), lang, source, 0))
    rows += [(n, None, "en", "silent", 0), (n + 1, "", "alone", "one", 0), (n + 2, "tiny words", "few", "a", 0), (n + 3, "12 34", "few", "b", 0)]
    rows += [(None, "ab " * 5000, "en", "s1", 0), rows[3], rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("s", [DivergenceSettings(), DivergenceSettings(held=3, piece=40, cells=30, ranks=3, least_docs=2)])
def test_divergence_follows_the_rules(spark, s):
    df = spark.createDataFrame(texts(), "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", "1 AS term", "2 AS n", "3 AS docs", "4 AS value", "5 AS kinds", "6 AS blocks", "7 AS part").repartition(3)
    got = source_divergence.source_divergence(df, s)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == by_hand_divergence(texts(), s)
    assert source_divergence.source_divergence(df.where("false"), s).count() == 0


def test_terms_of_a_long_text_meet_no_cuts():
    text = ("Straße été ".encode() * 3000) + b"a" * 5000 + " é9b".encode()
    whole_text = [t for part in terms_of(text, 1 << 30) for t in part]
    for piece in (7, 64, 1000):
        assert [t for part in terms_of(text, piece) for t in part] == whole_text
    assert whole_text[:2] == ["straße".encode(), "été".encode()] and whole_text[-2:] == ["é".encode(), b"b"]
    assert replace(DivergenceSettings(), ranks=2).ranks == 2 and list(terms_of(b"")) == []
