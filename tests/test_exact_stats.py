"""Exact quantiles, correlations and word sets against NumPy and plain loops."""

import numpy as np
import pytest

from strandline.operators import spectra, stats


def test_quantiles(spark):
    rng = np.random.default_rng(4)
    groups = {"hot": np.concatenate([np.full(4000, 2.5), rng.normal(size=999)]), "few": np.array([3.0]), "two": np.array([1.0, 4.0]), "many": rng.normal(size=3001), "same": np.full(70, -1.0)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("few", None), ("two", float("nan")), ("void", None)]
    rng.shuffle(rows)
    qs = [0.0, 0.05, 0.1, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(str(g), None if v is None else float(v)) for g, v in rows], "kind string, x double").repartition(7)
    got = {(r.kind, r.q): r.value for r in stats.exact_quantiles(df, "kind", "x", qs).collect()}
    assert got == {(g, q): pytest.approx(np.quantile(x, q), abs=1e-12) for g, x in groups.items() for q in qs}
    assert stats.exact_quantiles(df.limit(0), "kind", "x", qs).count() == 0


def test_correlation_matrix_with_gaps(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4)) + 1e6  # far from zero
    x[:, 1] += x[:, 0] - 1e6
    x[:, 3] = 7.25
    rows = [[None if rng.random() < 0.1 else float(v) for v in r] for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    got = {(r.a, r.b): (r.n, r.r) for r in stats.correlation_matrix(df, list("abcd")).collect()}
    assert len(got) == 16
    for i, p in enumerate("abcd"):
        for j, q in enumerate("abcd"):
            both = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
            n, r = got[p, q]
            assert n == len(both)
            assert r is None if "d" in (p, q) else r == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9)
    assert stats.correlation_matrix(df.limit(2), list("abcd")).count() == 0


@pytest.mark.parametrize("k", [3, 11, 31, 40])
def test_jaccard_at_any_length(spark, k):
    rng = np.random.default_rng(k)
    base = "".join(rng.choice(list("ACGT"), 700))
    seqs = {"a": base, "b": base[100:600] + "N" + base[:90], "c": "".join(rng.choice(list("ACGT"), 300)), "d": "ACGT", "e": base[300:]}
    sets = {n: {s[i : i + k] for i in range(len(s) - k + 1) if "N" not in s[i : i + k]} for n, s in seqs.items()}
    got = {(r.a, r.b): (r.shared, r.jaccard) for r in spectra.jaccard(spark.createDataFrame(list(seqs.items()), "name string, sequence string"), k).collect()}
    want = {(p, q): (len(x & y), len(x & y) / len(x | y)) for p, x in sets.items() for q, y in sets.items() if p < q and x & y}
    assert got == {k: (n, pytest.approx(j)) for k, (n, j) in want.items()}


def test_no_permutations_no_p(spark):
    df = spark.createDataFrame([("f", "c", k, 1.0 * k, 0.5) for k in range(5)], "feature string, control string, k int, o double, c double")
    assert [r.paired_permutation_p for r in stats.permutation_sums(df, 0).collect()] == [None]


def test_a_vector_moves_once_however_many_blocks(spark):
    rng = np.random.default_rng(8)
    vectors = spark.createDataFrame([(f"r{k:03d}", rng.bytes(20_000)) for k in range(40)], "name string, v binary").localCheckpoint()

    def moved():
        told = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(told.apply(k).totalShuffleWrite() for k in range(told.size()))

    def compare(x, y):
        return np.ones((len(x), len(y)), bool), {"same": np.array([[int(a == b) for b in y] for a in x])}

    before = moved()
    got = spectra._pair_tiles(vectors, "same long", compare, 4)
    assert sorted((r.a, r.b) for r in got.collect()) == [(f"r{a:03d}", f"r{b:03d}") for a in range(40) for b in range(a + 1, 40)]
    assert moved() - before < 3 * 40 * 20_000


def test_pairs_of_records_equal_their_two_tables(spark):
    rng = np.random.default_rng(9)
    recs = [(f"r{n}", "".join(rng.choice(list("ACGT"), n))) for n in (2, 3, 9, 60, 900)] + [("a", "A" * 50), ("none", "")]
    df = spark.createDataFrame(recs, "name string, sequence string")
    j = {(r.a, r.b): r.jaccard for r in spectra.jaccard(df, 7).collect()}
    want = {(r.a, r.b): (j.get((r.a, r.b), 0.0), r.distance) for r in spectra.fisher_matrix(df).collect()}
    assert {(r.a, r.b): (r.jaccard, r.fisher_rao) for r in spectra.pairs_of_records(df).collect()} == want


def test_shared_words_by_pairs_and_by_columns():
    rng = np.random.default_rng(3)
    for high in (20, 3000):
        x, y = ([np.unique(rng.integers(0, high, rng.integers(0, 60))).astype(np.uint32) for _ in range(n)] for n in (13, 9))
        want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
        for dense, most in ((0, 50), (3, 5), (2048, 1 << 22)):
            assert spectra._shared_words(x, y, dense, most).tolist() == want


def test_adjusted_values_in_one_range(spark, monkeypatch):
    plans, write = [], stats.checkpointed
    monkeypatch.setattr(stats, "checkpointed", lambda d: (plans.append(d._jdf.queryExecution().analyzed().toString()), write(d))[1])
    rng = np.random.default_rng(1)
    p = [None if k % 7 == 0 else float(v) for k, v in enumerate(np.round(rng.random(500) ** 3, 2))]
    got = {r.i: r.q for r in stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i long, p double"), "p", ["i"], "q").collect()}
    order = sorted(range(500), key=lambda k: (p[k] is None, p[k] or 0, k))
    low = 1.0
    for rank in range(500, 0, -1):
        k = order[rank - 1]
        if p[k] is not None:
            low = min(low, p[k] * 500 / rank)
        assert got[k] == pytest.approx(1.0 if p[k] is None else low)
    assert plans and not any("currentrow$(), unboundedfollowing" in x.lower() or "currentrow, unboundedfollowing" in x.lower() for x in plans)  # such a frame costs the square of a range
