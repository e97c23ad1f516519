import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from fixtures import documents, empty, frame, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marketloom.llm import html_text, mixing, packing, pitman_yor, toxicity, vector_graph
from test_dedup import brute_components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_packing_round_trip(spark):
    rows = documents()
    plain = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for doc, text, *_ in rows:
        want[(doc, tuple(plain.encode(text or "", add_special_tokens=False).ids + [1]))] += 1
    totals = Counter()
    for (doc, ids), n in want.items():
        totals[(doc, len(ids))] += n
    got = packing.pack(frame(spark), TOKENIZER).collect()
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append(r)
    for rows_of in windows.values():
        at = 0
        for r in sorted(rows_of, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    covered = Counter()
    for r in got:
        covered[(r["doc_id"], r["doc_tokens"])] += r["length"]
    assert covered == Counter({k: k[1] * n for k, n in totals.items()})
    by_doc = {doc: ids for (doc, ids) in want if doc is not None}
    for r in got:
        if r["doc_id"] is not None:
            own = np.array(by_doc[r["doc_id"]][r["start"]: r["start"] + r["length"]], "<u4")
            assert zlib.crc32(own.tobytes()) == r["ids_crc32"]
    assert packing.pack(empty(spark), TOKENIZER).count() == 0


def test_sum_of_squares_choice():
    """The level chosen is the one a plain search over all levels finds."""
    rng = np.random.default_rng(3)
    levels = packing.Levels(32)
    for _ in range(400):
        size = int(rng.integers(1, 32))
        costs = {}
        for h in range(0, 33 - size):
            if h == 0 or levels.count[h]:
                count = levels.count.copy()
                if h:
                    count[h] -= 1
                if h + size < 32:
                    count[h + size] += 1
                costs[h] = int((count ** 2).sum())
        best = levels.place(size)
        assert costs[best] == min(costs.values())
        group = [*levels.take(best), size]
        if best + size < 32:
            levels.put(best + size, group)
    assert levels.total == levels.count.sum()


def test_open_windows_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MAX_OPEN", 4)
    rng = np.random.default_rng(5)
    docs = [(i, rng.integers(0, 9, int(rng.integers(1, 200))).astype(np.uint32)) for i in range(300)]
    rows = list(packing.pack_task(iter(docs), 64, 0))
    for i, ids in docs:
        own = sorted(r for r in rows if r[0] == i)
        assert [r[1] for r in own] == list(np.cumsum([0] + [r[2] for r in own[:-1]])) and sum(r[2] for r in own) == len(ids)


def toxic_rows():
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        text = words(rng, rng.choice([5, 60, 300]))
        if i % 4 == 0:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["scumbag", "Moronic", "worthless"]))
        rows.append((i, " ".join(text), "en", "a", 1))
        labels.append((i, int(i % 4 == 0)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    tags = spark.createDataFrame([*labels, labels[0], (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, [*rows, (900, None, None, None, None), (901, "", None, None, None)]), tags).collect()
    assert len(got) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    right = [r for r in held if r["predicted"] == int(r["doc_id"] % 4 == 0)]
    assert len(right) >= 0.95 * len(held) > 50
    flipped = spark.createDataFrame([(d, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, t in labels], "doc_id long, toxic int")
    again = toxicity.toxicity(frame(spark, rows), flipped)
    first = toxicity.toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    none = toxicity.toxicity(frame(spark, rows[:3]), tags.where("false")).collect()
    assert len(none) == 3 and len({r["score"] for r in none}) == 1
    assert toxicity.toxicity(empty(spark), tags).count() == 0
    kept = toxicity.drop_toxic(frame(spark, rows), tags)
    assert kept.columns == frame(spark).columns and 290 <= kept.count() <= 310


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="</p><p>no</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, a lot of them.</div>
%s<aside><p>Aside text of some length.</p></aside><form><label>Mail</label><input value="a>b"></form>
<section id="comments"><article class="comment"><p>First! A reader wrote this comment here.</p></article></section>
<footer>&copy; 2020</footer></body></html>"""


def test_html_text(spark):
    article = "<h1>A &lt;b&gt; title</h1><p>One <b>bold</b>word&nbsp; here.<br>Next\n line<p class='ad'>Buy!</p><p>Caf&eacute; &#8212; end.</p>"
    want = "A <b> title One boldword here. Next line Café — end."
    assert html_text.main_text(PAGE % f"<article>{article}</article>") == want
    assert html_text.main_text(PAGE % f"<div id='main'>{article}</div>") == want
    assert html_text.main_text("<div id='main-menu'><p>Home</p></div><article>Text</article><article class='related'>More</article>") == "Text"
    long = "<p>" + "Many words of a long paragraph follow each other here. " * 3 + "</p>"
    assert html_text.main_text(PAGE % f"<div>{long}{long}<p>Short.</p></div>").endswith("Short.")
    assert "Buy" not in html_text.main_text("<p class=ad>Buy this now<p>" + "real text " * 20)
    for nothing in (None, "", " ", "<nav>Home</nav>", "<script>var x = 1;</script>", "<!-- unclosed", "<p></p>"):
        assert html_text.main_text(nothing) == ""
    assert html_text.main_text("a < b & c") == "a < b & c"
    assert len(html_text.main_text("<article>" + "<p>x y</p>" * 50_000 + "</article>")) == 50_000 * 4 - 1
    assert html_text.main_text("<a href='" * 20_000) is not None
    pages = spark.createDataFrame([(1, "u", PAGE % f"<main>{article}</main>"), (2, None, None), (None, "v", "<p>x")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract(pages.withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("?"))).collect()}
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want) and got[2]["text"] == "" and got[None]["url"] == "v"
    assert html_text.extract(pages.where("false")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    rows = []
    for i in range(900):
        v = centres[i % 40] + rng.normal(size=16) * (0.12 if i % 3 else 3.0)
        rows.append((i, [float(x) for x in v]))
    rows += [(1000 + i, rows[1][1]) for i in range(50)] + [
        (2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [float("inf")] * 16), (2005, []),
        (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (None, rows[0][1]), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("cells", F.lit("x")).withColumn("node", F.lit(1))
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    n, part = Counter(), {k: k for k in good}

    def top(k):
        while part[k] != k:
            k = part[k]
        return k

    for a in good:
        for b in good:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                    n[a] += 1
                    n[b] += 1
                    part[top(b)] = top(a)
    least = {}
    for k in good:
        least[top(k)] = min(least.get(top(k), 1 << 60), rows[k][0])
    for s in (vector_graph.Settings(), vector_graph.Settings(shard=60, most=200, sample=400)):
        got = sorted(map(tuple, vector_graph.linked_vectors(df, s).collect()), key=str)
        assert len(got) == len(rows)
        if s.most > 1000:
            want = [(i, n[k], least[top(k)] if k in part else i) for k, (i, _) in enumerate(rows)]
            assert [g[:3] for g in got] == [w for w in sorted(want, key=str)]
        else:
            assert sum(g[1] for g in got) >= 0.9 * sum(n.values())
    assert vector_graph.linked_vectors(df.where("false")).count() == 0
    assert [tuple(r) for r in vector_graph.linked_vectors(df.where("vec_id = 2001")).collect()] == [(2001, 0, 2001, True)]


def test_names_of_wrappers_and_titles():
    text = "<p>" + "real text " * 30 + "</p>"
    want = html_text.main_text(f"<article>{text}</article>")
    assert want
    for wrapper in ("div class='content has-sidebar'", "div class='no-comments'", "div class='search-results'", "form id='aspnetForm'"):
        for inner in (text, f"<article>{text}</article>"):
            assert html_text.main_text(f"<body><nav>Home</nav><{wrapper}>{inner}</{wrapper.split()[0]}></body>") == want
    titles = ("<h2 id='related-work'>One</h2><section id='discussion'><p>Two</p></section><h2 id='how-to-search'>Three</h2>"
              "<p class='notice'>Four</p><p><span id='feedback'>Five</span></p>")
    assert html_text.main_text(f"<article>{text}{titles}</article>") == want + " One Two Three Four Five"
    assert html_text.main_text(f"<div>{text}</div><div class='comments'>{text * 3}</div>") == want
    assert html_text.main_text(f"<div>{text}</div><div class='sidebar'><article>Teaser</article></div>") == want
    assert html_text.main_text(f"<div class='comments'>{text}</div>") == want


def test_short_parts_of_the_article():
    long = "<p>" + "real text " * 30 + "</p>"
    rest = html_text.main_text(f"<div>{long}</div>")
    adverts = "<div class='ad'>Buy</div>" * 4 + "<ul>" + "<li><a href='/x'>More</a></li>" * 4 + "</ul>"
    page = (f"<body><div>Motto</div><nav>Home</nav><ul>{'<li><a href=/y>Go</a></li>' * 4}</ul><div id='post'><h1>A title of the page</h1>"
            f"<div class='by'>By someone</div><p>1 May 2020</p>{adverts}{long}{adverts}<p>Short.</p><p>End.</p></div>"
            f"<ul>{'<li><a href=/z>Go</a></li>' * 4}</ul><div>Imprint</div></body>")
    assert html_text.main_text(page) == f"A title of the page By someone 1 May 2020 {rest} Short. End."
    assert html_text.main_text(f"<body><h1>Title</h1>{adverts}{long}{adverts}<p>End.</p></body>") == f"Title {rest} End."


def brute_links(rows):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    ids = [i for i, _ in rows]
    roots = list(range(len(rows)))
    for a, b in zip(*np.nonzero(near)):
        while roots[a] != roots[roots[a]] or roots[b] != roots[roots[b]]:
            roots[a], roots[b] = roots[roots[a]], roots[roots[b]]
        top = min(roots[a], roots[b])
        roots[roots[a]] = roots[roots[b]] = roots[a] = roots[b] = top
    for k in range(len(rows)):
        while roots[k] != roots[roots[k]]:
            roots[k] = roots[roots[k]]
    return sorted((i, int(n) - 1, ids[r]) for i, n, r in zip(ids, near.sum(1), roots))


def test_vectors_of_a_crowd(spark):
    """A group of near copies, none equal, that its shards cannot cover, and vectors no group holds."""
    rng = np.random.default_rng(8)
    near = rng.normal(size=16)[None, :] + rng.normal(size=(700, 16)) * 0.12
    rest = rng.normal(size=(60, 16)).repeat(2, axis=0) + rng.normal(size=(120, 16)) * 0.05
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(np.concatenate((near, rest)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_links(rows)
    # with a core no vector reaches, every vector is compared
    for more in ({}, {"core": 2.0}):
        s = vector_graph.Settings(shard=32, most=400, sample=400, most_overlap=2, block=256, **more)
        assert sorted(tuple(r)[:3] for r in vector_graph.linked_vectors(df, s).collect()) == want


def test_audit_of_few_links(spark):
    """A hot group found whole doesn't hide that no link of the pairs was found."""
    rng = np.random.default_rng(4)
    near = rng.normal(size=16)[None, :] + rng.normal(size=(200, 16)) * 0.05
    pairs = rng.normal(size=(20, 16)).repeat(2, axis=0) + rng.normal(size=(40, 16)) * 0.01
    vectors = np.concatenate((near, pairs))
    nodes = spark.createDataFrame([(i, 1, [float(e) for e in v]) for i, v in enumerate(vectors)], "node long, copies long, v array<double>")
    n = [199] * 200 + [0] * 40
    found = spark.createDataFrame([(i, k, k) for i, k in enumerate(n)], "node long, found long, distinct long")
    s = vector_graph.Settings()
    assert vector_graph._audit(nodes, found, s) < s.recall
    whole = spark.createDataFrame([(i, k or 1, k or 1) for i, k in enumerate(n)], "node long, found long, distinct long")
    assert vector_graph._audit(nodes, whole, s) == 1


def test_language_model(spark):
    rows = documents()
    got = sorted(pitman_yor.score(frame(spark)).collect(), key=str)
    tokens = [re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().lower()) + [None] for r in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0 for r in rows]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    base = [sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t) for t in tokens]
    want = sorted(((r[0], h, len(t), sum(w in count for w in t), n) for r, t, h in zip(rows, tokens, held)), key=str)
    assert [tuple(r)[:5] for r in got] == want
    assert np.allclose(sorted(r["base_score"] for r in got), sorted(base))
    assert all(r["score"] < 0 for r in got)
    again = sorted(pitman_yor.score(frame(spark)).collect(), key=str)
    assert [r["n_tokens"] for r in got] == [r["n_tokens"] for r in again]
    assert pitman_yor.score(empty(spark)).count() == 0
    only_held = [r for r, h in zip(rows, held) if h]
    assert pitman_yor.score(frame(spark, only_held)).count() == len(only_held)


def test_settling_sweep_is_no_sample(spark, monkeypatch):
    """Two samples take three sweeps, and nothing is added up before the tables of the second."""
    sweep, seen = pitman_yor._sweep, []

    def noted(states, t, number, s):
        out = sweep(states, t, number, s)
        seen.append(max(float(pitman_yor.load(r["blob"])[5].max(initial=0)) for r in out.select("blob").collect()))
        return out

    monkeypatch.setattr(pitman_yor, "_sweep", noted)
    df = frame(spark, [(i, "some words and some more words", "en", "a", 30) for i in range(1, 8)])
    assert df.count() == pitman_yor.score(df, s=pitman_yor.Settings(sweeps=2)).count()
    assert len(seen) == 3 and seen[:2] == [0, 0] and seen[2] > 0


def test_words_are_contexts_of_their_own(spark):
    """What follows a word is learnt from that word, also where another ends alike."""
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    learnt = [i for i in range(200) if i not in held]
    rows = [(i, ("walking apple", "talking berry")[n % 2], "en", "a", 13) for n, i in enumerate(learnt)]
    asked = ("walking apple", "walking berry", "talking berry", "talking apple")
    rows += [(i, x, "en", "a", 13) for i, x in zip(held, asked)]
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(frame(spark, rows)).collect()}
    right, wrong, right_too, wrong_too = (got[i] for i in held[:4])
    assert right > wrong + 1 and right_too > wrong_too + 1


def test_totals_of_contexts(spark):
    """Every range gets the sums over all ranges of the contexts it has, whoever adds them up."""
    rng = np.random.default_rng(2)
    own = {r: np.sort(rng.choice(1000, n, replace=False)) for r, n in ((0, 300), (1, 0), (2, 700), (5, 1))}
    tables = {r: rng.integers(0, 9, len(x)) for r, x in own.items()}
    rows = [(r, [(x["owner"], bytearray(x["blob"])) for x in pitman_yor._reports(own[r], 1000, 3, tables[r])]) for r in own]
    want = sum(np.bincount(own[r], tables[r], minlength=1000) for r in own)
    replies = pitman_yor._totals(spark.createDataFrame(rows, f"range int, {pitman_yor.SENT}")).toPandas()
    for r, x in own.items():
        (got,) = pitman_yor._joined(replies[replies.range == r])
        assert np.array_equal(got, want[x])


def test_probabilities_sum_to_one():
    """Over the vocabulary and one unknown word, in any context, after seating."""
    s = pitman_yor.Settings(classes=8)
    rng = np.random.default_rng(9)
    words_n = 50
    counts = rng.integers(0, 6, (words_n, s.classes)) * (rng.random((words_n, s.classes)) < 0.4)
    counts[:, 0] += 1
    many = np.full(words_n, s.classes, np.uint16)
    kinds = np.tile(np.arange(s.classes), words_n)
    flat = counts.reshape(-1).astype(np.int64)
    tables = pitman_yor.sit(rng, flat, np.full(len(flat), 0.5), 0.6)
    assert ((tables > 0) == (flat > 0)).all() and (tables <= flat).all()
    roots = pitman_yor.sit(rng, tables.reshape(words_n, -1).sum(1), np.full(words_n, 0.5), 0.6)
    t = pitman_yor.Totals(int(flat.sum()), words_n, 0.6, 0.6, counts.sum(0), tables.reshape(words_n, -1).sum(0).astype(float), roots.sum())
    _, p = pitman_yor._predict(many, kinds, flat, tables, roots, t, s)
    unknown = (s.root_strength + 0.6 * roots.sum()) / (words_n + 1) / (s.root_strength + tables.sum())
    for u in range(s.classes):
        own = (s.strength + 0.6 * t.tables[u]) / (s.strength + t.customers[u])
        assert math.isclose(p[kinds == u].sum() + own * unknown, 1, rel_tol=1e-9)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage's rows, from its own input, as plain Python finds them."""
    rows, labels = toxic_rows()
    rows = [(i + 5000, *r[1:]) for i, r in enumerate(rows)] + [r for r in documents() if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d + 5000, 0, t) for d, t in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs.write.parquet(f"{sf}/{len(seen)}")
        docs = spark.read.parquet(f"{sf}/{len(seen)}")
        seen.append(docs.collect())
    score = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    key = lambda rs: sorted((r["doc_id"], r["text"] or "") for r in rs)
    assert key(seen[1]) == key(r for r in seen[0] if not score[r["doc_id"]])
    best = {}
    for r in seen[1]:
        k = (r["text"] or "").encode().lower()
        if k not in best or r["doc_id"] > best[k]["doc_id"]:
            best[k] = r
    assert key(seen[2]) == key(best.values())
    parts = brute_components(seen[2])
    assert key(seen[3]) == key(r for r, (d, _, c) in zip(seen[2], parts) if d == c)
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(spark.createDataFrame(seen[3], docs.schema)).collect()}
    times = Counter(r["doc_id"] for r in seen[4])
    assert times == Counter({d: math.floor(t / s + 0.5) if s else 1 for d, (t, s) in taken.items()}) + Counter()
    packed = corpus_pipeline.run(spark, sf).collect()
    whole = Counter()
    for r in packed:
        whole[r["doc_id"]] += r["length"]
    plain = Tokenizer.from_file(TOKENIZER)
    assert whole == Counter({r["doc_id"]: times[r["doc_id"]] * (len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in seen[4]})
    assert corpus_pipeline.ORACLE_SQL is None


def test_slices_are_read_right():
    """Texts in slices of a larger Arrow array give the words they hold."""
    import pyarrow as pa

    texts = [f"Doc {i} ñandú É% end." for i in range(500)]
    part = pa.array(texts).slice(200, 50)
    plain = Tokenizer.from_file(TOKENIZER)
    ids, cuts = packing.WordIds(TOKENIZER).texts(part)
    for i, t in enumerate(texts[200:250]):
        assert ids[cuts[i]: cuts[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids + [1]
    for big in (part, part.cast(pa.large_string())):
        hashes, _, codes, bounds = pitman_yor.encode(big, pitman_yor.Settings())
        assert len(bounds) == 51 and bounds[-1] == 50 * 6 == len(codes) and len(hashes) == 50 + 5
