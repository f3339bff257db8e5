import numpy as np

from strandline.llm import ann


def brute(rows, pick, k):
    good = [(i, np.array(v, float) / np.abs(np.array(v, float)).max()) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for a, (i, x) in enumerate(good):
        if pick(i):
            s = sorted((-float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), j) for b, (j, y) in enumerate(good) if j != i)
            out[i] = [(j, -v) for v, j in s[:k]]
    return out


def same(out, want):
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    for q, w in want.items():
        assert len(got[q]) == len(w)
        assert np.allclose([s for _, s in got[q]], [s for _, s in w], atol=1e-12)
        if len({round(s, 9) for _, s in w}) == len(w):
            assert [j for j, _ in got[q]] == [j for j, _ in w]


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8))
    x[300:600] = x[0] + rng.normal(size=(300, 8)) * 1e-3  # a third lies close together
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0] * 3), (None, [1.0] * 8), (1004, [1e200] * 8), (1005, [1e-200] * 8), (1006, [None] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    same(ann.nearest(df, lambda i: i % 50 == 0, block_rows=64, shards=3).collect(), brute(rows, lambda i: i % 50 == 0, 5))


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    out = ann.nearest(df, lambda i: i % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in out) == [(0, 1, 50), (0, 2, 2), (50, 1, 0), (50, 2, 2)]
    assert ann.nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0])] + [(k, [2.0, 1.0]) for k in (9, 7, 8, 3, 4, 5, 6)], "vec_id long, embedding array<double>")
    out = ann.nearest(df, lambda i: i == 0).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [3, 4, 5, 6, 7]


def test_repeated_identifiers(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [0.2, 1.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = [(r.query_id, r.vec_id, round(r.score, 12)) for r in ann.nearest(df, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect()]
    pairs = sorted((-np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y), j) for i, x in rows if i == 50 for j, y in rows if j != 50)
    assert out == [(50, j, round(-s, 12)) for s, j in pairs[:5]]


def test_many_components_stay_exact(spark):
    rng = np.random.default_rng(8)
    x = rng.choice([-1.0, 1.0], size=(120, 4096))
    x[1] = x[0]
    x[1, :7] *= -1
    x[2:40] = x[1]  # ties that a product rounded to float32 would part
    a, b = (rng.integers(-127, 128, (5, 4096)).astype(np.int8) for _ in range(2))
    assert np.array_equal(ann.products(a, b), a.astype(np.int64) @ b.astype(np.int64).T)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = ann.nearest(df, lambda i: i == 0, block_rows=64).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [1, 2, 3, 4, 5]
