import random

import numpy as np
import pytest

from strandline.functions import kernels as K
from strandline.operators import graphs, near


def plain(s, positive=True, points=400):
    """By all pairs of whole coordinates."""
    if not s:
        return None, None
    x, y = (np.cumsum([1 if b in up else -1 for b in s]) for up in ("AG", "AT"))
    at = np.round(np.linspace(0, len(s) - 1, points)).astype(int)
    x, y = x[at], y[at]
    d = np.sqrt(((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2).astype(float))
    pool = d[d > 0] if positive else d
    near = (d > 0) & (d < np.percentile(pool, 10)) if len(pool) else d > 1e9
    label = np.arange(points)
    for _ in range(points):
        label = np.minimum(label, np.where(near, label, points).min(1))
    parts = len(set(label.tolist()))
    return parts, max(0, int(near.sum()) // 2 - points + parts) if positive else -1


def test_homology_equals_the_kernel(spark):
    rng = random.Random(11)
    recs = {f"r{n}": "".join(rng.choices("ACGT", k=n)) for n in (1, 2, 30, 399, 400, 900, 40_000)} | {"aaa": "A" * 500, "turn": "ACGT" * 300, "none": ""}
    df = spark.createDataFrame(list(recs.items()), "name string, sequence string")
    for arguments in ({}, {"positive": False}):
        for r in near.homology(df, **arguments).collect():
            want = plain(recs[r.name], **arguments)
            assert (r.betti_0, r.betti_1) == want, (r.name, arguments)
            if r.name == "r40000":  # scaled coordinates part equal distances, of which shorter walks have many
                k = K.homology(recs[r.name], **arguments)
                assert want[0] == k["betti_0"] and want[1] == pytest.approx(k["betti_1"], rel=0.01)
    assert near.homology(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_weak_components(spark, seed):
    rng = random.Random(seed)
    name = list(range(500))
    rng.shuffle(name)
    pairs = [(name[k], name[k + 1]) for k in range(499) if k % 100 != 99] + [(7, 7)] + [(name[0], x) for x in name[1:40]]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graphs.weak_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in pairs)}


def test_points_of_a_row_equal_those_of_joins(spark):
    rng = random.Random(5)
    recs = {f"r{n}": "".join(rng.choices("ACGT", k=n)) for n in (1, 2, 60, 500, 9000)} | {"aaa": "A" * 500, "turn": "ACGT" * 300}
    at = near.sampled(spark.createDataFrame(list(recs.items()), "name string, sequence string"), 90).localCheckpoint()
    for arguments in ({}, {"positive": False}, {"share": 0.03}):
        one = {r.name: r.asDict() for r in near.figures(at, **arguments).collect()}
        two = {r.name: r.asDict() for r in near.joined_figures(at, **arguments).collect()}
        assert one.keys() == two.keys() == recs.keys()
        for name, r in one.items():
            assert {**r, "eps": 0} == {**two[name], "eps": 0}, (name, arguments)
            assert (r["eps"] is None) == (two[name]["eps"] is None)
            assert r["eps"] is None or r["eps"] == pytest.approx(two[name]["eps"], rel=1e-12)


def test_points_do_not_meet_by_rows(spark):
    df = spark.createDataFrame([("a", "ACGGT" * 300)], "name string, sequence string")
    plan = near.homology(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # totals of chunks and the record's own row: no join of points with points
