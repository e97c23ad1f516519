"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are dealt to overlapping cluster shards of bounded size. Each shard builds a graph: every vector's nearest and some
random shard members are robust-pruned into a short adjacency list. Lists of a vector from its shards are united.
Every vector then searches each shard it belongs to, greedily from the shard's medoid; once near, the search widens as long as
what it meets is within range. All hits are verified by cosine in double precision. A bounded set of queries is
compared with every vector to audit recall. Where it falls short, vectors near their cluster's centre (those of groups larger
than shards can cover) are compared with each other exactly, block by block; then shards overlap more; at last all vectors are
compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import components
from marketloom.session import interim


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.9
    shard: int = 512  # vectors per cluster aimed at
    most: int = 4096  # vectors a shard may hold before it is split
    overlap: int = 2  # clusters a vector is dealt to
    most_overlap: int = 6
    sample: int = 16384  # vectors the clusters are fitted on
    clusters: int = 1024  # at one level
    near: int = 48  # candidates of a vector: nearest, random
    far: int = 16
    degree: int = 24
    alpha: float = 1.2
    beam: int = 24
    slack: float = 0.05  # the range is searched this far below the threshold
    audit: int = 1024  # queries of the recall audit
    recall: float = 0.97
    few: int = 64  # links; vectors with more are audited apart
    core: float = 0.8  # cosine with the centre from which a vector counts as one of a crowd
    block: int = 2048  # vectors of a crowd compared at once


#: What a search counts per vector.
COUNTS = ("found", "distinct", "crowd", "crowd_distinct")


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; the same input gives the same centres."""
    k = max(1, min(k, len(x)))
    centres = x[np.random.default_rng(11).permutation(len(x))[:k]].copy()
    for _ in range(rounds if k > 1 else 0):
        own = np.concatenate([(x[i: i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def nearest_cells(x: np.ndarray, centres: np.ndarray, many: int) -> np.ndarray:
    many = min(many, len(centres))
    return np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :many]


def build_graph(x: np.ndarray, s: Settings) -> list[np.ndarray]:
    """Adjacency lists of one shard: robust pruning of nearest and random members, and reverse edges."""
    n = len(x)
    if n == 1:
        return [np.empty(0, np.int64)]
    sim = (x.astype(np.float32) @ x.astype(np.float32).T)
    np.fill_diagonal(sim, -2)
    near = min(s.near, n - 1)
    candidates = np.argpartition(-sim, near - 1, axis=1)[:, :near]
    random = np.random.default_rng(n).integers(0, n, (n, s.far))
    candidates = np.concatenate((candidates, random), axis=1)
    rows = np.arange(n)
    own = sim[rows[:, None], candidates]
    own[candidates == rows[:, None]] = -2
    alive = own > -2
    gap = np.sqrt(np.maximum(0, 2 - 2 * own))
    edges = []
    for _ in range(s.degree):
        best = np.where(alive, own, -3).argmax(1)
        some = alive[rows, best]
        if not some.any():
            break
        chosen = candidates[rows, best]
        edges.append(np.stack((rows[some], chosen[some]), axis=1))
        between = sim[chosen[:, None], candidates]
        covered = s.alpha * np.sqrt(np.maximum(0, 2 - 2 * between)) <= gap
        alive &= ~covered & (candidates != chosen[:, None])
    pairs = np.concatenate(edges)
    back = pairs[:, ::-1]
    back = back[np.argsort(-sim[back[:, 0], back[:, 1]], kind="stable")]
    back = back[np.argsort(back[:, 0], kind="stable")]
    first = np.searchsorted(back[:, 0], back[:, 0])
    back = back[np.arange(len(back)) - first < s.degree]
    pairs = np.unique(np.concatenate((pairs, back)), axis=0)
    return np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], rows[1:]))


def range_search(x: np.ndarray, lists: list[np.ndarray], s: Settings, chunk: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every vector of a shard as a query, the shard members it links with: (query, hit) index pairs.

    Many queries take their steps together. A query expands its nearest unexpanded node while that node is among
    the ``beam`` best seen or within range.
    """
    n = len(x)
    width = max(1, max(map(len, lists)))
    table = np.full((n, width), -1, np.int64)
    for i, own in enumerate(lists):
        table[i, : len(own)] = own
    medoid = int((x @ x.mean(0)).argmax())
    floor = s.cosine - s.slack
    for at in range(0, n, chunk):
        q = x[at: at + chunk]
        m = len(q)
        seen = np.full((m, n), -3.0)
        todo = np.full((m, n), -3.0)
        seen[:, medoid] = todo[:, medoid] = q @ x[medoid]
        active = np.arange(m)
        while len(active):
            best = todo[active].argmax(1)
            value = todo[active, best]
            beam = min(s.beam, n)
            bar = np.minimum(floor, np.partition(seen[active], n - beam, axis=1)[:, n - beam])
            go = (value > -3) & (value >= bar)
            active, best = active[go], best[go]
            if not len(active):
                break
            todo[active, best] = -3
            ahead = table[best]
            r, c = np.nonzero((ahead >= 0) & (seen[active[:, None], ahead] == -3))
            rows, nodes = active[r], ahead[r, c]
            value = np.einsum("ij,ij->i", q[rows], x[nodes])
            seen[rows, nodes] = todo[rows, nodes] = value
        a, b = np.nonzero(seen >= s.cosine)
        a = a + at
        yield a[a != b], b[a != b]


def _shards(nodes: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(cell, node, copies, v, core, cells): one row per vector and shard; ``cells`` are all shards of the vector.
    And (node, copies, v, home, core): one row per vector, with its nearest cluster and whether it is near the centre."""
    spark = nodes.sparkSession
    n = nodes.count()
    rows = nodes.orderBy(F.xxhash64("node"), "node").limit(s.sample).select("v").collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r[0]), []).append(r[0])
    centres = {d: kmeans(unit(np.array(v, np.float64)), min(s.clusters, -(-n // s.shard))) for d, v in by_size.items()}
    sent = spark.sparkContext.broadcast(centres)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for d, part in f.groupby(f.v.map(len)):
                x = unit(np.stack(part.v.to_list()))
                own = sent.value.get(d)
                near = np.zeros((len(x), 1), int) if own is None else nearest_cells(x, own, s.overlap)
                core = np.zeros(len(x), bool) if own is None else np.einsum("ij,ij->i", x, own[near[:, 0]]) >= s.core
                yield part.assign(core=core, home=[f"{d}:{c}" for c in near[:, 0]], cells=[[f"{d}:{c}" for c in row] for row in near])

    dealt = interim(nodes.mapInPandas(deal, "node long, copies long, v array<double>, core boolean, home string, cells array<string>"))
    homes = dealt.select("node", "copies", "v", "home", "core")
    dealt = dealt.drop("home")
    while True:  # shards beyond the limit are split by clusters of their own
        members = dealt.select(F.explode("cells").alias("cell"), "node")
        large = interim(members.groupBy("cell").count().where(F.col("count") > s.most))
        if large.isEmpty():
            break
        bound = s.sample // 4
        picked = dealt.select(F.explode("cells").alias("cell"), "node", "v").join(large, "cell").where(
            F.pmod(F.xxhash64("node", "cell"), F.lit(1 << 20)) < F.lit(bound << 20) / F.col("count"))

        def fit(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
            x = unit(np.stack(f.v.to_list()))
            k = min(64, max(2, int(-(-int(f["count"].iloc[0]) // s.shard))))
            return pd.DataFrame({"cell": [key[0]], "centres": [kmeans(x, k).astype("<f8").tobytes()]})

        splits = interim(picked.groupBy("cell").applyInPandas(fit, "cell string, centres binary"))

        def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                cells = []
                for v, cell, raw in zip(f.v, f.cell, f.centres):
                    if raw is None:
                        cells.append([cell])
                    else:
                        x = unit(v[None, :])
                        cells.append([f"{cell}:{c}" for c in nearest_cells(x, np.frombuffer(raw).reshape(-1, x.shape[1]), s.overlap)[0]])
                yield f[["node", "copies", "v", "core"]].assign(cells=cells)

        again = dealt.select("node", "copies", "v", "core", F.explode("cells").alias("cell")).join(splits, "cell", "left")
        parts = again.mapInPandas(split, "node long, copies long, v array<double>, core boolean, cells array<string>")
        dealt = interim(parts.groupBy("node").agg(
            F.first("copies").alias("copies"), F.first("v").alias("v"), F.first("core").alias("core"), F.array_distinct(F.flatten(F.collect_list("cells"))).alias("cells")))
    return dealt.select(F.explode("cells").alias("cell"), "node", "copies", "v", "core", F.array_sort("cells").alias("cells")), homes


def _union(part: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the parts of each a and b; a part is named by its first member."""
    while True:
        p, q = part[a], part[b]
        apart = p != q
        if not apart.any():
            return
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(part, np.maximum(p, q), np.minimum(p, q))
        while (part != part[part]).any():
            part[:] = part[part]


def _graph(shards: DataFrame, s: Settings) -> DataFrame:
    """(node, near): adjacency lists of each vector, united over its shards."""

    def build(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node")
        ids = f.node.to_numpy()
        lists = build_graph(unit(np.stack(f.v.to_list())), s)
        return pd.DataFrame({"node": ids, "near": [ids[own] for own in lists]})

    lists = shards.select("cell", "node", "v").groupBy("cell").applyInPandas(build, "node long, near array<long>")
    # a vector is in few shards and has a bounded list in each
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _search(shards: DataFrame, graph: DataFrame, s: Settings) -> DataFrame:
    """(node, found, distinct, crowd, crowd_distinct, root) per vector and shard: links not counted in an earlier shard, weighted
    by copies and not, those of them between two vectors near their centres, and the smallest node the shard's links
    connect it with."""

    def search(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node")
        ids, copies, core = f.node.to_numpy(), f.copies.to_numpy(), f.core.to_numpy(bool)
        x = unit(np.stack(f.v.to_list()))
        place = pd.Series(np.arange(len(ids)), index=ids)
        lists = [place.reindex(own).dropna().to_numpy(np.int64) for own in f.near]
        kinds, kind = np.unique([" ".join(c) for c in f.cells], return_inverse=True)
        # a pair that shares several shards is counted in the first of them
        first = np.array([[min(set(p.split()) & set(q.split())) == key[0] for q in kinds] for p in kinds])
        hit = np.zeros((len(ids), len(ids)), bool)
        for a, b in range_search(x, lists, s):
            hit[a, b] = hit[b, a] = True
        sums, part = {c: np.zeros(len(ids), np.int64) for c in COUNTS}, np.arange(len(ids))
        for at in range(0, len(ids), 256):
            a, b = np.nonzero(hit[at: at + 256])
            a = a + at
            new = first[kind[a], kind[b]]
            for c, many in zip(COUNTS, (new * copies[b], new, new * copies[b] * (core[a] & core[b]), new & core[a] & core[b])):
                sums[c] += np.bincount(a, many, len(ids)).astype(np.int64)
            _union(part, a, b)
        return pd.DataFrame({"node": ids, **sums, "root": ids[part]})

    return shards.join(graph, "node").groupBy("cell").applyInPandas(search, "node long, found long, distinct long, crowd long, crowd_distinct long, root long")


def _exact(nodes: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(node, exact, exact_distinct): all links among ``nodes``, weighted by copies and not; and (a, b): edges that connect what these links connect.

    Vectors of a cluster are packed into blocks, one row each. Pairs of blocks that can hold a link, by the angle between
    their means and their radii, are compared as tasks of their own; what they return is added up per block.
    """
    reach = float(np.arccos(min(1.0, s.cosine)))
    counted = nodes.join(nodes.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(s.block)).alias("blocks")), "home")
    named = counted.withColumn("block", F.concat_ws("/", "home", F.pmod(F.xxhash64("node", F.lit("block")), "blocks")))

    def pack(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node")
        x = unit(np.stack(f.v.to_list()))
        mean = x.mean(0)
        mean = unit(mean[None, :])[0] if np.abs(mean).max() > 1e-9 else x[0]
        radius = float(np.arccos(np.clip(x @ mean, -1, 1)).max())
        return pd.DataFrame({"block": [key[0]], "mean": [mean], "radius": [radius], "ids": [f.node.to_numpy("<i8").tobytes()],
                             "copies": [f.copies.to_numpy("<i8").tobytes()], "x": [x.astype("<f8").tobytes()]})

    blocks = interim(named.groupBy("block").applyInPandas(
        pack, "block string, mean array<double>, radius double, ids binary, copies binary, x binary"))
    stats = blocks.select("block", "mean", "radius").orderBy("block").collect()
    sent = nodes.sparkSession.sparkContext.broadcast([(r["block"], np.array(r["mean"]), r["radius"]) for r in stats])

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The blocks a block is compared with: itself and later ones."""
        for f in frames:
            for block, mean, radius in zip(f.block, f["mean"], f.radius):
                others = [(n, r, m) for n, m, r in sent.value if n >= block and len(m) == len(mean)]
                angle = np.arccos(np.clip(np.stack([m for _, _, m in others]) @ mean, -1, 1))
                near = angle <= reach + radius + np.array([r for _, r, _ in others]) + 1e-6
                for (n, _, _), go in zip(others, near):
                    if go:
                        pair = f"{block} {n}"
                        yield pd.DataFrame({"pair": [pair] * (1 + (n != block)), "block": [block, n][: 1 + (n != block)]})

    pairs = interim(blocks.select("block", "mean", "radius").mapInPandas(meet, "pair string, block string"))

    def compare(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block")
        ids, copies = ([np.frombuffer(b, "<i8") for b in f[c]] for c in ("ids", "copies"))
        x = [np.frombuffer(b, "<f8").reshape(len(i), -1) for b, i in zip(f.x, ids)]
        n, alone = len(ids[0]), len(ids) == 1
        every = np.concatenate(ids)
        found, distinct, part = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64), np.arange(len(every))
        for at in range(0, n, 256):
            near = x[0][at: at + 256] @ x[-1].T >= s.cosine
            a, b = np.nonzero(near)
            a, b = a + at, b + (0 if alone else n)
            if alone:
                a, b = a[a != b], b[a != b]
            found += np.bincount(a, copies[-1][b - (0 if alone else n)], len(every)).astype(np.int64)
            distinct += np.bincount(a, minlength=len(every))
            if not alone:
                found += np.bincount(b, copies[0][a], len(every)).astype(np.int64)
                distinct += np.bincount(b, minlength=len(every))
            _union(part, a, b)
        cut = [slice(0, n), slice(n, None)][: len(ids)]
        return pd.DataFrame({"block": f.block, "ids": f.ids, "found": [found[c].tobytes() for c in cut], "distinct": [distinct[c].tobytes() for c in cut],
                             "roots": [every[part][c].astype("<i8").tobytes() for c in cut]})

    got = pairs.join(blocks.select("block", "ids", "copies", "x"), "block").groupBy("pair").applyInPandas(
        compare, "block string, ids binary, found binary, distinct binary, roots binary")

    def total(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(f.ids.iloc[0], "<i8")
        found, distinct = (sum(np.frombuffer(b, "<i8") for b in f[c]) for c in ("found", "distinct"))
        edges = [np.stack((ids, np.frombuffer(b, "<i8")), axis=1) for b in f.roots]
        # vectors of this block that share a root are joined here, so that a root is named once per part
        roots = np.unique(np.concatenate(edges)[:, 1])
        part = np.arange(len(ids) + len(roots))
        for e in edges:
            _union(part, np.arange(len(ids)), len(ids) + np.searchsorted(roots, e[:, 1]))
        every = np.concatenate((ids, roots))
        none = np.full(len(roots), -1)
        return pd.DataFrame({"node": every, "exact": np.concatenate((found, none)), "exact_distinct": np.concatenate((distinct, none)), "root": every[part]})

    sums = interim(got.groupBy("block").applyInPandas(total, "node long, exact long, exact_distinct long, root long"))
    return sums.where("exact >= 0").select("node", "exact", "exact_distinct"), sums.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _audit(nodes: DataFrame, found: DataFrame, s: Settings) -> float:
    """Share of its distinct links that the search found of a vector, by comparing a bounded set with every vector.

    The mean over vectors with few links or over those with many, whichever is less: each vector counts once.
    """
    spark = nodes.sparkSession
    asked = nodes.orderBy(F.xxhash64("node", F.lit("audit")), "node").limit(s.audit).collect()
    sent = spark.sparkContext.broadcast([(r["node"], np.array(r["v"])) for r in asked])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_size: dict[int, list] = {}
        for node, v in sent.value:
            by_size.setdefault(len(v), []).append((node, v))
        queries = {d: (np.array([n for n, _ in q]), unit(np.stack([v for _, v in q]))) for d, q in by_size.items()}
        total = {d: np.zeros(len(q[0]), np.int64) for d, q in queries.items()}
        for f in frames:
            for d, part in f.groupby(f.v.map(len)):
                if d in queries:
                    names, q = queries[d]
                    near = q @ unit(np.stack(part.v.to_list())).T >= s.cosine
                    total[d] += (near & (names[:, None] != part.node.to_numpy()[None, :])).sum(1)
        for d, (names, _) in queries.items():
            yield pd.DataFrame({"asked": names, "links": total[d]})

    there = nodes.mapInPandas(count, "asked long, links long").groupBy("asked").agg(F.sum("links").alias("links"))
    share = F.coalesce(F.col("distinct"), F.lit(0)) / F.col("links")
    both = there.where("links > 0").join(found, F.col("asked") == F.col("node"), "left").groupBy(F.col("links") > s.few).agg(F.avg(share))
    return min((r[1] for r in both.collect()), default=1.0)


def linked_vectors(vectors: DataFrame, s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
    component; so do vectors whose id is null. Only vectors of one length link. Equal vectors are one node of the
    graph and link with each other; an id given twice is two vectors. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = good & F.exists("v", lambda e: e != 0)
    rows = interim(rows.select("vec_id", F.when(good, F.transform("v", lambda e: e + F.lit(0.0))).alias("v")))
    nodes = interim(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    # ids are the graph's node names, so two vectors under one id need names of their own
    if nodes.groupBy("node").count().where("count > 1").isEmpty():
        named = nodes.select("node", "copies", "v")
    else:
        named = interim(nodes.select(F.xxhash64("v").alias("node"), "copies", "v"))
    exact = None
    for overlap in range(s.overlap, s.most_overlap + 1):
        own = Settings(**{**s.__dict__, "overlap": overlap})
        if named.isEmpty():
            found = None
            break
        shards, homes = _shards(named, own)
        shards = interim(shards)
        hits = interim(_search(shards, interim(_graph(shards, own)), own))
        edges = hits.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        found = interim(hits.groupBy("node").agg(*[F.sum(c).alias(c) for c in COUNTS]))
        if _audit(named, found, own) >= s.recall:
            break
        if exact is None:  # clusters and centres don't depend on the overlap
            exact = _exact(homes.where("core"), own)
        counted = found.join(exact[0], "node", "left")
        found = interim(counted.select("node", *[
            (F.col(c) + F.coalesce(F.col(e) - F.col(w), F.lit(0))).alias(c) for c, w, e in zip(COUNTS, COUNTS[2:], ("exact", "exact_distinct"))]))
        edges = edges.unionByName(exact[1])
        if _audit(named, found, own) >= s.recall:
            break
    else:  # no overlap suffices
        counts, edges = _exact(homes, s)
        found = counts.select("node", F.col("exact").alias("found"))
    roots = None if found is None else components(edges)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = found.select("node", "found")
    classes = nodes.join(named.withColumnRenamed("node", "name").drop("copies"), "v").join(found.withColumnRenamed("node", "name"), "name")
    classes = classes.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    least = classes.groupBy("root").agg(F.min("node").alias("component_id"))
    classes = interim(classes.join(least, "root").select(
        F.col("v").alias("w"), (F.col("found") + F.col("copies") - 1).alias("links"), "component_id"))
    out = rows.join(classes, rows.v == classes.w, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
