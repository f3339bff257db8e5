"""Graph figures on edge tables against plain loops."""

import random
from collections import deque

import pytest

from strandline.operators import graphs


def graph(spark, pairs, weight=lambda k: 1 + k % 5):
    return spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", weight(k)) for k, (a, b) in enumerate(pairs)], "src string, dst string, weight long")


def reach(pairs):
    nodes = sorted({x for p in pairs for x in p})
    out = {}
    for s in nodes:
        seen, todo = {s}, [s]
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[s] = seen
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(45)} | {(40, 41), (41, 42), (42, 40), (42, 43), (50, 50), (43, 44), (44, 43)})
    r = reach(pairs)
    want = {f"n{x:02d}": f"n{min(y for y in r[x] if x in r[y]):02d}" for x in r}
    assert {x.node: x.component for x in graphs.strong_components(graph(spark, pairs)).collect()} == want
    assert graphs.strong_components(graph(spark, pairs).limit(0)).count() == 0


def paths(pairs):
    """Betweenness by counting the shortest paths of every pair."""
    nodes = sorted({x for p in pairs for x in p})
    after = {x: sorted({b for a, b in pairs if a == x and b != x}) for x in nodes}
    dist, count = {}, {}
    for s in nodes:
        dist[s, s], count[s, s], todo = 0, 1, deque([s])
        while todo:
            x = todo.popleft()
            for y in after[x]:
                if (s, y) not in dist:
                    dist[s, y], count[s, y] = dist[s, x] + 1, 0
                    todo.append(y)
                if dist[s, y] == dist[s, x] + 1:
                    count[s, y] += count[s, x]
    n, out = len(nodes), {}
    for v in nodes:
        out[v] = sum(count[s, v] * count[v, t] / count[s, t] for s in nodes for t in nodes if len({s, v, t}) == 3 and (s, t) in dist and (s, v) in dist and (v, t) in dist and dist[s, v] + dist[v, t] == dist[s, t]) / ((n - 1) * (n - 2))
    return out


@pytest.mark.parametrize("sources", [1024, 7])
def test_betweenness(spark, sources):
    rng = random.Random(5)
    pairs = sorted({(rng.randrange(18), rng.randrange(18)) for _ in range(40)} | {(30, 31), (5, 5)})
    got = {r.node: r.betweenness for r in graphs.betweenness(graph(spark, pairs), sources).collect()}
    assert got == {f"n{v:02d}": pytest.approx(b, abs=1e-12) for v, b in paths(pairs).items()}


def test_pagerank_with_and_without_sinks(spark):
    rng = random.Random(3)
    for pairs in (sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(25)} | {(3, 20)}), [(k, (k + s) % 7) for k in range(7) for s in (1, 3)]):
        nodes = sorted({x for p in pairs for x in p})
        w = {p: 1 + k % 5 for k, p in enumerate(pairs)}
        rank = dict.fromkeys(nodes, 1 / len(nodes))
        for _ in range(60):
            total = {a: sum(v for (x, _), v in w.items() if x == a) for a in nodes}
            lost = sum(rank[a] for a in nodes if not total[a])
            rank = {b: 0.85 * (sum(rank[a] * v / total[a] for (a, y), v in w.items() if y == b) + lost / len(nodes)) + 0.15 / len(nodes) for b in nodes}
        got = {r.node: r["rank"] for r in graphs.pagerank(graph(spark, pairs), rounds=30).collect()}
        assert got == {f"n{a:02d}": pytest.approx(x, abs=1e-5) for a, x in rank.items()}


def test_communities_merge_as_the_matrix_does(spark):
    rng = random.Random(9)
    pairs = sorted({(b * 5 + rng.randrange(5), b * 5 + rng.randrange(5)) for b in range(3) for _ in range(14)} | {(0, 5), (5, 10), (10, 0)})
    e = graph(spark, pairs)
    parts, score = graphs.communities(e)
    want = {}
    for r in parts.collect():
        want.setdefault(r.community, set()).add(r.node)
    for one in (True, False):
        got, frame_score = graphs.communities_frame(e, one_pair=one)
        sets = {}
        for r in got.collect():
            sets.setdefault(r.community, set()).add(r.node)
        assert all(c == min(s) for c, s in sets.items())
        if one:
            assert sorted(map(sorted, sets.values())) == sorted(map(sorted, want.values())) and frame_score == pytest.approx(score)
        # The modularity by its definition.
        u = {(r.a, r.b): float(r.w) for r in graphs.undirected(e).collect()}
        m2 = 2 * sum(u.values())
        of = {n: c for c, s in sets.items() for n in s}
        k = dict.fromkeys(of, 0.0)
        for (a, b), w in u.items():
            k[a] += w
            k[b] += w
        q = sum(2 * w for (a, b), w in u.items() if of[a] == of[b]) / m2 - sum((sum(k[n] for n in s) / m2) ** 2 for s in sets.values())
        assert frame_score == pytest.approx(q) and frame_score > 0.9 * score
    assert graphs.communities_frame(e.limit(0))[1] == 0.0


def test_pagerank_reads_its_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    e = graph(spark, [(a, (a * 7 + b) % 20) for a in range(20) for b in (1, 2, 3)] + [(3, 30)])
    ranks = graphs.pagerank_frame(e.mapInPandas(seen, e.schema), rounds=4)
    assert abs(sum(r["rank"] for r in ranks.collect()) - 1) < 1e-9
    assert read.value == e.count()
