import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from fixtures import documents, empty, frame
from pyspark.sql import functions as F

from marketloom.llm import exact_dedup, mixing, passages, simhash, substring_bytes, substring_words
from marketloom.llm.common import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").encode().lower()


def test_exact_groups(spark):
    rows = documents()
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    want = Counter()
    for doc, text, *_ in rows:
        own = groups[lower(text)]
        ids = [i for i in own if i is not None]
        keep = max(ids) if ids else None
        want[(doc, keep, len(own), doc == keep, hashlib.sha256(lower(text)).hexdigest())] += 1
    for support in (1 / 4096, 0.05):
        assert Counter(map(tuple, exact_dedup.exact_duplicates(frame(spark), support=support).collect())) == want
    kept = exact_dedup.drop_exact_duplicates(frame(spark))
    assert kept.columns == frame(spark).columns
    assert Counter(lower(r["text"]) for r in kept.collect()) == Counter(groups.keys())
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty(spark)).count() == 0


def test_mix_meets_targets(spark):
    rows = documents()
    got = mixing.mix(frame(spark)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall((r[1] or "").encode()))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    held, total = set(), sum(sizes.values())
    while True:  # the limit met source by source
        left = total - sum(3 * sizes[s] for s in held)
        free = [s for s in order if s not in held]
        share = sum(weight[s] for s in free)
        new = [s for s in free if left * weight[s] > 3 * sizes[s] * share]
        if not new:
            break
        held.update(new)
    target = {s: float(3 * sizes[s]) if s in held else left * weight[s] / share for s in order}
    taken = defaultdict(int)
    for r in got:
        s = r["mixed_source"]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 4
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(frame(spark).repartition(7)).collect()), key=str)
    whole = mixing.apply_mix(frame(spark))
    assert whole.columns == frame(spark).columns
    times = Counter((r["doc_id"], r["text"]) for r in whole.collect())
    assert set(times) <= {(r[0], r[1]) for r in rows} and all((r[0], r[1]) in times for r in rows if not (r[1] or "").split())
    assert mixing.mix(empty(spark)).count() == 0 and mixing.apply_mix(empty(spark)).count() == 0


def brute_fingerprint(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    shingles = [b" ".join(w[i: i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(rows, bits=4):
    fps = [brute_fingerprint(r[1]) for r in rows]
    part = list(range(len(rows)))

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                part[top(i)] = top(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)].append(r[0])
    return [(r[0], fps[i], min(least[top(i)], default=None)) for i, r in enumerate(rows)]


def test_simhash(spark):
    rows = documents()
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(frame(spark)).collect()]
    assert sorted(got, key=str) == sorted(brute_components(rows), key=str)
    kept = simhash.drop_near_duplicates(frame(spark))
    assert kept.columns == frame(spark).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({c for _, _, c in got}, key=str)
    assert simhash.near_duplicates(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(frame(spark), max_bits=6)


def test_simhash_runs(spark):
    """Long runs of one key and short ones give the components of all links."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-(1 << 62), 1 << 62, 40)
    fps = set()
    for c in centres:
        for _ in range(60):
            f = int(c)
            for bit in rng.integers(0, 63, rng.integers(0, 6)):
                f ^= 1 << int(bit)
            fps.add(f)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(simhash.variants(nodes))).collect()}
    # runs dealt over tasks as pairs of blocks link the same, however small the blocks are
    for most in (6, 20):
        assert found == {r["node"]: r["root"] for r in components(simhash.links(simhash.variants(nodes), most=most)).collect()}
    keys = simhash.variants(nodes)
    dealt = simhash.dealt(keys, 6)
    assert dealt.groupBy("at", "key").count().agg(F.max("count")).first()[0] < keys.groupBy("at", "key").count().agg(F.max("count")).first()[0]
    assert dealt.select("fp").distinct().count() == nodes.count() and simhash.dealt(keys, 10**6) is keys
    part = simhash._parts(np.array(fps).view(np.uint64), 4)
    for f, p in zip(fps, part):
        assert found.get(f, f) == fps[p]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 6000 + i) for i in range(300)]
    part = {}

    def top(i):
        while part.setdefault(i, i) != i:
            i = part[i]
        return i

    for a, b in edges:
        x, y = top(a), top(b)
        part[max(x, y)] = min(x, y)
    want = {i: top(i) for e in edges for i in e}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in want.items() if k != v} == {k: v for k, v in got.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_words(rows, window=50):
    split = [WORD.findall((r[1] or "").encode()) for r in rows]
    first = {}
    for r, w in zip(rows, split):
        for i in range(len(w) - window + 1):
            h = tuple(w[i: i + window])
            if r[0] is not None:
                first[h] = min(first.get(h, r[0]), r[0])
    out = []
    for r, w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            owner = first.get(tuple(w[i: i + window]))
            if r[0] is not None and owner is not None and owner < r[0]:
                gone[i: i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, length=400):
    texts = [(r[1] or "").encode() for r in rows]
    count = Counter(t[i: i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i: i + length]] > 1:
                gone[i: i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((r[0], len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [20_000, 2])
def test_substrings(spark, monkeypatch, most):
    """Groups taken by one task, and groups dealt by content, give the brute-force result."""
    rows = documents()
    monkeypatch.setattr(passages.Passage, "__init__", _limited(passages.Passage.__init__, most))
    monkeypatch.setattr(passages, "BLOCK", 5000)
    got = substring_words.drop_repeated_passages(frame(spark)).drop("n_spans").collect()
    assert sorted(map(tuple, got), key=str) == brute_words(rows)
    got = substring_bytes.drop_repeated_bytes(frame(spark)).collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows)


def _limited(make, most):
    def init(self, *args, **kwargs):
        make(self, *args, **{**kwargs, "most": most})

    return init


def test_substrings_of_nothing(spark):
    assert substring_words.drop_repeated_passages(empty(spark)).count() == 0
    assert substring_bytes.drop_repeated_bytes(empty(spark)).count() == 0


def test_automaton_tells_owners():
    rng = np.random.default_rng(4)
    seqs = [rng.integers(0, 3, rng.integers(5, 60)).tolist() for _ in range(12)]
    shard = substring_words.SuffixAutomaton(seqs, list(range(12)))
    for query in [*seqs, rng.integers(0, 4, 80).tolist()]:
        want = []
        for i in range(len(query) - 5):
            w = query[i: i + 6]
            want.append(min((k for k, s in enumerate(seqs) if any(s[j: j + 6] == w for j in range(len(s)))), default=passages.NOBODY))
        assert list(shard.owners_of(query, 6)) == want


def test_held_out_rule():
    assert zlib.crc32(b"12") % 4 in range(4)


def test_rows_whose_ids_share_low_bits_are_apart(spark):
    """Ids 2^32 apart, and -1 beside null, name rows of their own."""
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text), ((1 << 32) + 1, text), (-1, "n " + text), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_words.drop_repeated_passages(df).collect()}
    assert got == {-1: 0, 1: 200, (1 << 32) + 1: 200, None: 0}
    two = df.where("doc_id > 0")
    got = {r.doc_id: r.n_removed for r in substring_words.drop_repeated_passages(two).collect()}
    assert got == {1: 0, (1 << 32) + 1: 200}


def repetitive():
    """Texts of few letters, periods, and copies of a text with single bytes changed, so that phrases repeat in many contexts."""
    rng = np.random.default_rng(11)
    base = bytes(rng.integers(97, 100, 3000, np.uint8)).decode()
    rows = [(i, "".join(base[a: a + 60] for a in rng.integers(0, 200, 12))) for i in range(20)]
    for i in range(20, 50):
        letters = list(base[rng.integers(0, 500): 1500])
        for at in rng.integers(0, len(letters), 12):
            letters[at] = "x"
        rows.append((i, "".join(letters)))
    return rows + [(50, "a" * 700), (51, "ab" * 300 + "c"), (52, "b" * 33 + "ab" * 40), (53, "abc" * 200 + "a" * 100), (54, base + base), (55, None), (56, "é" * 300)]


@pytest.mark.parametrize("modulus", [2, 7, 40, 10**9])
def test_parse_of_repetitive_texts(spark, monkeypatch, modulus):
    """Dense, usual and missing triggers give the brute-force result, from parses alone."""
    rows = repetitive()
    monkeypatch.setattr(passages, "BLOCK", 1000)
    monkeypatch.setattr(substring_bytes, "by_content", None)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_bytes.drop_repeated_bytes(df, length=40, gram=6, modulus=modulus).collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows, 40)


def test_phrases_are_prefix_free():
    """Phrases overlap by a trigger, give the text back, and none is a proper prefix of another but at a text's end."""
    p = passages.Passage(length=400, gram=6, words=False, earlier=False, modulus=7)
    whole, seen = set(), 0
    for _, text in repetitive():
        t = (text or "").encode()
        triggers = passages.trigger_places(np.frombuffer(t, np.uint8), p).tolist()
        assert triggers == [i for i in range(len(t) - 5) if passages.gram_hashes(passages._BYTES[np.frombuffer(t[i: i + 6], np.uint8)], 6)[0] % 7 == 0]
        bounds = [0, *triggers]
        phrases = [substring_bytes.phrases_from(t, a, triggers, p) for a in bounds]
        for a, parse in zip(bounds, phrases):
            assert b"".join([x[:-6] for x in parse[:-1]] + parse[-1:])[:400] == t[a: a + 400]
        whole.update(x[0] for x in phrases[:-1])
        seen += len(phrases) - 1
    ordered = sorted(whole)
    assert not any(b != a and b.startswith(a) for a, b in zip(ordered, ordered[1:])) and len(whole) < seen / 2


def test_order_of_parses_is_that_of_texts():
    """Ranks and common prefixes put together from dictionary and parse are those of the bytes themselves."""
    p = passages.Passage(length=60, gram=6, words=False, earlier=False, modulus=7)
    parses, texts = [], []
    for _, text in repetitive()[:50]:
        t = text.encode()
        triggers = passages.trigger_places(np.frombuffer(t, np.uint8), p).tolist()
        for a in triggers[:-20: 5]:
            parses.append(substring_bytes.phrases_from(t, a, triggers, p))
            texts.append(b"".join([x[:-6] for x in parses[-1][:-1]] + parses[-1][-1:]))
    dictionary = sorted({x for parse in parses for x in parse})
    order, common = substring_bytes.phrase_array(dictionary)
    assert order.tolist() == list(range(len(dictionary)))
    rank = {x: i for i, x in enumerate(dictionary)}
    order, got = substring_bytes.parse_array([[rank[x] for x in parse] for parse in parses], np.array([len(x) for x in dictionary]), common, 6)
    assert [texts[i] for i in order] == sorted(texts)
    for i, j, c in zip(order, order[1:], got[1:].tolist()):
        same = next((k for k, (x, y) in enumerate(zip(texts[i], texts[j])) if x != y), None)
        assert c > 1 << 60 if same is None else c == same
