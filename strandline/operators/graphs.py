"""Weighted k-mer graphs: edges, topology, PageRank, components, clustering, communities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import tiles as T
from strandline.sources.shared import saved


def edges(df: DataFrame, k: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep..., src, dst, weight: a k-mer joins its first to its last k-1 symbols. 4^k rows at most."""
    base = df if keep else df.withColumn("name", F.lit(1))
    n = T.kmer_counts(base, k, keep=keep or ("name",))
    return n.select(*keep, F.substring("kmer", 1, k - 1).alias("src"), F.substring("kmer", 2, k - 1).alias("dst"), F.col("cnt").alias("weight"))


def stats(e: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nodes, edges, occupancies and density (self-loops count) of each graph."""
    nodes = e.select(*keep, "src").union(e.select(*keep, "dst")).distinct().groupBy(*keep).agg(F.count(F.lit(1)).alias("nodes"))
    n = e.groupBy(*keep).agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("total_weight"))
    both = n.join(nodes, list(keep)) if keep else n.crossJoin(F.broadcast(nodes))
    v = F.col("nodes").cast("double")
    return both.select(*keep, "nodes", "edges", "total_weight", (v / 4 ** (k - 1)).alias("node_occupancy"), (F.col("edges") / F.lit(float(4**k))).alias("edge_occupancy"), F.coalesce(F.col("edges") / F.nullif(v * (v - 1), F.lit(0.0)), F.lit(0.0)).alias("density"))


def matrix(e: DataFrame, most: int = 4**7) -> tuple[list[str], np.ndarray]:
    """Nodes and weight matrix on the driver, for graphs of a proven size: 4^(k-1) nodes, 4,096 for k = 7."""
    rows = e.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} edges: use the DataFrame forms")
    names = sorted({r.src for r in rows} | {r.dst for r in rows})
    at = {n: k for k, n in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for r in rows:
        w[at[r.src], at[r.dst]] += r.weight
    return names, w


def pagerank(e: DataFrame, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """node, rank, by joins and sums. Stops once a round moves the ranks by less than `tol` a node in all, which
    is looked at where ranks are written: every fifth round, or every round in a graph with nodes without a way
    out, whose rank all nodes share."""
    e = saved(e.select("src", "dst", "weight"))  # words are counted once
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    nodes = saved(nodes.join(e.select(F.col("src").alias("node"), F.lit(False).alias("sink")).distinct(), "node", "left").select("node", F.coalesce("sink", F.lit(True)).alias("sink")))
    told = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_if("sink").alias("sinks")).first()
    n, every = max(1, told.n), 1 if told.sinks else 5
    flow = saved(e.select("src", "dst", (F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).alias("share")))
    ranks = nodes.select("node", "sink", F.lit(1 / n).alias("rank"), F.lit(None).cast("double").alias("was"))
    for k in range(1, rounds + 1):
        got = flow.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("come"))
        lost = 0.0
        if told.sinks:
            lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0))).first()[0]
        new = F.lit(damping) * (F.coalesce("come", F.lit(0.0)) + F.lit(lost / n)) + F.lit((1 - damping) / n)
        # The former rank is only looked at where ranks are written, so that a round reads them once.
        write = k % every == 0 or k == rounds
        before = ranks if write else nodes.withColumn("rank", F.lit(None).cast("double"))
        ranks = before.select("node", "sink", F.col("rank").alias("was")).join(got, "node", "left").select("node", "sink", new.alias("rank"), "was")
        if write:
            ranks = saved(ranks)
            if tol > 0 and (ranks.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0) < n * tol:
                break
    return ranks.select("node", "rank")


def pagerank_frame(e: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """The same by a fixed number of rounds, whatever the ranks do. Edges are written once, so that no round counts
    words again."""
    return pagerank(e, damping, rounds, tol=0)


def weak_components(e: DataFrame) -> DataFrame:
    """node, component (its smallest node) of a graph whose edges count both ways, by large and small stars: every
    node hands its neighbours on to the smallest of them, until a round changes nothing."""
    edges = saved(e.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    mark = before = None
    while mark is None or mark != before:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = saved(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        lower = saved(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = saved(small.union(lower.select("a", F.col("m").alias("b"))).distinct())
        told = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        before, mark = mark, (told.n, told.h)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def _least_reaching(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """node, colour: the smallest node from which each node is reached. Only what became smaller is handed on."""
    colours = saved(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("fresh")))
    while True:
        got = e.join(colours.where("fresh").select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("c"))
        new = colours.join(got, "node", "left").select("node", F.least("colour", "c").alias("colour"), F.coalesce(F.col("c") < F.col("colour"), F.lit(False)).alias("fresh"))
        colours = saved(new)
        if not colours.where("fresh").head(1):
            return colours.select("node", "colour")


def _reaching(roots: DataFrame, e: DataFrame) -> DataFrame:
    """node, colour of all nodes from which the root of their colour is reached by edges of that colour."""
    found = fresh = saved(roots)
    while fresh.head(1):
        step = e.join(fresh.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
        fresh = saved(step.join(found, "node", "left_anti"))
        found = saved(found.unionByName(fresh))
    return found


def strong_components(e: DataFrame) -> DataFrame:
    """node, component: the smallest node of those that reach it and that it reaches.

    Nodes without an edge in or out are components of their own and are trimmed, until none is left. Then each node
    takes the colour of the smallest node that reaches it; a node of its own colour is the smallest of its component,
    which is what reaches it backwards inside the colour. What is found goes, and so do edges between
    colours; the rest begins anew. All steps are joins of edge and node tables; rounds follow the longest of the
    shortest ways. Self-loops change nothing."""
    out = None
    e = saved(e.select("src", "dst").distinct())
    nodes = saved(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    e = saved(e.where("src <> dst"))

    def settled(part: DataFrame) -> DataFrame:
        return part if out is None else out.unionByName(part)

    while nodes.head(1):
        while True:
            inner = e.select(F.col("src").alias("node")).intersect(e.select(F.col("dst").alias("node")))
            ends = saved(nodes.join(inner, "node", "left_anti"))
            if not ends.head(1):
                break
            out = settled(ends.select("node", F.col("node").alias("component")))
            nodes = saved(nodes.join(ends, "node", "left_anti"))
            e = saved(e.join(ends, F.col("src") == F.col("node"), "left_anti").join(ends, F.col("dst") == F.col("node"), "left_anti"))
        if not nodes.head(1):
            break
        colours = _least_reaching(nodes, e)
        own = e.join(colours.select(F.col("node").alias("src"), "colour"), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("c")), "dst")
        own = saved(own.where("colour = c").select("src", "dst", "colour"))
        found = _reaching(colours.where("node = colour"), own)
        out = settled(found.select("node", F.col("colour").alias("component")))
        nodes = saved(nodes.join(found, "node", "left_anti"))
        kept = own.join(found, F.col("src") == F.col("node"), "left_anti").join(found, F.col("dst") == F.col("node"), "left_anti")
        e = saved(kept.select("src", "dst"))
    return out if out is not None else nodes.select("node", F.col("node").alias("component"))


def degrees(e: DataFrame) -> DataFrame:
    """node, in_degree, out_degree, degree: edges, not weights."""
    d = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return d.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), (F.sum("i") + F.sum("o")).alias("degree"))


def degree_histogram(e: DataFrame) -> DataFrame:
    d = degrees(e)
    return d.groupBy(F.lit("in").alias("kind"), F.col("in_degree").alias("degree")).agg(F.count(F.lit(1)).alias("n")).union(d.groupBy(F.lit("out"), "out_degree").agg(F.count(F.lit(1))))


def clustering(e: DataFrame) -> DataFrame:
    """node, degree, triangles, coefficient in the undirected graph without self-loops. Triangles come
    from wedges of ordered edges, each once."""
    u = e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    n = u.select(F.col("a").alias("node")).union(u.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    t = u.join(u.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").join(u.select("a", F.col("b").alias("c")), ["a", "c"])
    t = t.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    loops = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().join(n, "node", "left").join(t, "node", "left")
    d, t_ = F.coalesce("degree", F.lit(0)), F.coalesce("triangles", F.lit(0))
    return loops.select("node", d.alias("degree"), t_.alias("triangles"), F.when(d > 1, 2.0 * t_ / (d * (d - 1))).otherwise(0.0).alias("coefficient"))


def undirected(e: DataFrame, weighted: bool = True) -> DataFrame:
    """a, b, w for a <= b: of a pair of edges between two nodes, the one from the larger node counts."""
    w = F.coalesce(F.max(F.when(F.col("src") >= F.col("dst"), F.col("weight"))), F.max("weight")) if weighted else F.lit(1)
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(w.cast("decimal(19,0)").alias("w"))


def communities_frame(e: DataFrame, weighted: bool = True, one_pair: bool = False) -> tuple[DataFrame, float]:
    """(node, community, by its smallest node) by merging pairs that add modularity, and the modularity.

    A round merges every pair of communities that are each other's best, or with `one_pair` the best of all
    alone, as greedy merging does (a round for each merge: for small graphs). Then edges between communities are
    contracted to one each. Gains are whole numbers, m2 w - k k, so ties are ties: they go to the smaller names.
    No round is without the best pair, and rounds end when no pair adds anything."""
    u = saved(undirected(e, weighted))
    ends = u.select(F.col("a").alias("c"), "w").union(u.select(F.col("b").alias("c"), "w"))
    degree = saved(ends.groupBy("c").agg(F.sum("w").cast("decimal(25,0)").alias("k")))
    parts = degree.select(F.col("c").alias("node"), F.col("c").alias("community"))
    m2 = degree.agg(F.sum("k")).first()[0]
    if not m2:
        return parts, 0.0
    link = saved(u.where("a <> b").select("a", "b", F.col("w").cast("decimal(25,0)").alias("w")))
    while True:
        at = lambda c: degree.select(F.col("c").alias(c), F.col("k").alias(f"k{c}"))
        gain = F.col("w") * F.lit(m2).cast("decimal(25,0)") - F.col("ka") * F.col("kb")
        gains = link.join(at("a"), "a").join(at("b"), "b").select(F.struct((-gain).alias("loss"), "a", "b").alias("pair")).where("pair.loss < 0")
        if one_pair:
            merged = gains.agg(F.min("pair").alias("pair")).where("pair IS NOT NULL")
        else:
            best = gains.select(F.explode(F.array("pair.a", "pair.b")).alias("c"), "pair").groupBy("c").agg(F.min("pair").alias("pair"))
            merged = best.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        merged = saved(merged.select(F.col("pair.b").alias("old"), F.col("pair.a").alias("new")))
        if not merged.head(1):
            break
        now = lambda df, c: df.join(merged, F.col(c) == F.col("old"), "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")
        degree = saved(now(degree, "c").groupBy("c").agg(F.sum("k").cast("decimal(25,0)").alias("k")))
        joined = now(now(link, "a"), "b").where("a <> b")
        link = saved(joined.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").cast("decimal(25,0)").alias("w")))
        parts = saved(now(parts, "community"))
    return parts, modularity(u, parts)


def modularity(u: DataFrame, parts: DataFrame) -> float:
    """Of a partition (node, community) of an undirected graph (a, b, w)."""
    of = lambda c: parts.select(F.col("node").alias(c), F.col("community").alias(f"c{c}"))
    both = u.join(of("a"), "a").join(of("b"), "b")
    ends = both.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), (F.col("ca") == F.col("cb")).alias("inside")), F.struct(F.col("cb").alias("c"), (F.col("ca") == F.col("cb")).alias("inside")))).alias("z"), F.col("w").cast("double").alias("w"))
    sums = ends.groupBy("z.c").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("z.inside"), F.col("w")).otherwise(0.0)).alias("i"))
    total = sums.agg(F.sum("k").alias("m2"), F.sum("i").alias("i"), F.sum(F.col("k") * F.col("k")).alias("kk")).first()
    return float(total.i / total.m2 - total.kk / total.m2**2) if total.m2 else 0.0


def _undirected(w: np.ndarray, weighted: bool) -> np.ndarray:
    """A reciprocal edge overwrites the first and does not add to it."""
    low = np.tril(w, -1)
    u = np.where(low + low.T > 0, low + low.T, np.triu(w, 1) + np.triu(w, 1).T)
    u = u + np.diag(np.diag(w))
    return u if weighted else (u > 0).astype(float)


def communities(e: DataFrame, weighted: bool = True) -> tuple[DataFrame, float]:
    """(node, community) by greedy merging of the pair that adds most modularity, and the modularity."""
    names, w = matrix(e)
    a = _undirected(w, weighted)
    m2 = a.sum() + np.trace(a)
    groups = [[k] for k in range(len(names))]
    x = (a + np.diag(np.diag(a))) / m2 if m2 else a
    deg = x.sum(1)
    while len(groups) > 1:
        gain = 2 * (x - np.outer(deg, deg))
        np.fill_diagonal(gain, -np.inf)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[i, j] <= 0:
            break
        i, j = min(i, j), max(i, j)
        x[i] += x[j]
        x[:, i] += x[:, j]
        deg[i] += deg[j]
        x, deg = np.delete(np.delete(x, j, 0), j, 1), np.delete(deg, j)
        groups[i] += groups.pop(j)
    score = float(np.trace(x) - (deg**2).sum())
    order = sorted(groups, key=lambda g: (-len(g), min(g)))
    rows = [(names[k], n) for n, g in enumerate(order) for k in sorted(g)]
    return e.sparkSession.createDataFrame(rows, "node string, community int"), score


def betweenness(e: DataFrame, sources: int = 1024) -> DataFrame:
    """node, betweenness: shares of shortest directed paths through a node.

    All sources of a block of about `sources` go on together, a level at a time: the nodes that a level reaches
    first, with the number of shortest paths to them. Shares are then pushed back from the farthest level. A
    block has a row for each source and node that it reaches; with every source in turn the work is that of
    nodes times edges, and the blocks bound what is held at once."""
    e = saved(e.select("src", "dst").distinct())
    nodes = saved(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    e = saved(e.where("src <> dst"))
    n = nodes.count()
    blocks = max(1, -(-n // sources))
    total = None
    for b in range(blocks):
        start = nodes.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == b)
        levels = [saved(start.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")))]
        seen = levels[0].select("s", "node")
        while levels[-1].head(1):
            step = levels[-1].join(e, F.col("node") == F.col("src")).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
            levels.append(saved(step.join(seen, ["s", "node"], "left_anti")))
            seen = seen.unionByName(levels[-1].select("s", "node"))
        shares = []
        behind = None
        for level in reversed(levels[1:-1]):
            level = level.withColumn("share", F.lit(0.0)) if behind is None else level.join(behind, ["s", "node"], "left").select("s", "node", "paths", F.coalesce("share", F.lit(0.0)).alias("share"))
            level = saved(level)
            shares.append(level.select("node", "share"))
            # Every node before this level hands its paths on; only those of the level before are its sources.
            before = levels[len(levels) - 2 - len(shares)].select("s", F.col("node").alias("src"), F.col("paths").alias("p"))
            pushed = level.join(e, F.col("node") == F.col("dst")).select("s", "src", ((F.lit(1.0) + F.col("share")) / F.col("paths")).alias("x"))
            behind = pushed.join(before, ["s", "src"]).groupBy("s", F.col("src").alias("node")).agg(F.sum(F.col("p") * F.col("x")).alias("share"))
        for part in shares:
            part = saved(part.groupBy("node").agg(F.sum("share").alias("share")))
            total = part if total is None else total.unionByName(part)
    scale = F.lit(1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0)
    got = nodes if total is None else nodes.join(total.groupBy("node").agg(F.sum("share").alias("share")), "node", "left")
    return got.select("node", (F.coalesce("share", F.lit(0.0)) * scale).alias("betweenness")) if total is not None else got.select("node", F.lit(0.0).alias("betweenness"))


def eigenvector(e: DataFrame, rounds: int = 1000, tol: float = 1e-6) -> DataFrame:
    names, w = matrix(e)
    a, x = (w > 0).astype(float), np.full(len(names), 1 / max(1, len(names)))
    for _ in range(rounds):
        new = x + x @ a
        new /= np.linalg.norm(new) or 1
        done = np.abs(new - x).sum() < len(names) * tol
        x = new
        if done:
            break
    return e.sparkSession.createDataFrame(list(zip(names, x.tolist(), strict=True)), "node string, centrality double")


def clustering_z(e: DataFrame, graphs: int = 10, seed: int = 42) -> float:
    """Mean clustering against seeded random graphs of the same size and density."""
    names, w = matrix(e)
    n = len(names)
    p = (w > 0).sum() / (n * (n - 1)) if n > 1 else 0.0
    rng = np.random.default_rng(seed)

    def mean(a: np.ndarray) -> float:
        d = a.sum(1)
        t = np.diag(a @ a @ a)
        return float(np.divide(t, d * (d - 1), out=np.zeros(n), where=d > 1).mean())

    own = ((w + w.T) > 0).astype(float)
    np.fill_diagonal(own, 0)
    draws = []
    for _ in range(graphs):
        r = np.triu(rng.random((n, n)) < p, 1).astype(float)
        draws.append(mean(r + r.T))
    return (mean(own) - float(np.mean(draws))) / (float(np.std(draws)) + 1e-8)


def logos(e: DataFrame, parts: DataFrame, top: int = 12, most: int = 6, least: int = 3) -> DataFrame:
    """community, pos, base, share: bases of the nodes of highest degree in the largest communities."""
    sizes = parts.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least).where(F.col("community") < most)
    d = parts.join(F.broadcast(sizes), "community").join(degrees(e), "node")
    d = d.withColumn("rn", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "node"))).where(F.col("rn") <= top)
    s = d.select("community", F.posexplode(F.split("node", "")).alias("pos", "base")).where("base <> ''")
    n = s.groupBy("community", "pos", "base").agg(F.count(F.lit(1)).alias("n"))
    return n.select("community", "pos", "base", (F.col("n") / F.sum("n").over(Window.partitionBy("community", "pos"))).alias("share"))
