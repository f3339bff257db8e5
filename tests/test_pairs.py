"""Pairs of all records: what is met where, and common words of blocks of sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import spectra
from strandline.plans import catalog


def _vectors(spark, names):
    return spark.createDataFrame([(n, bytes([k % 251])) for k, n in enumerate(names)], "name string, v binary").repartition(3)


def _all(x, y):
    return np.ones((len(x), len(y)), bool), {"one": np.ones((len(x), len(y)), np.int64)}


def test_a_name_stays_over_a_run_of_pairs(spark):
    names = [f"{'zyxw'[k % 4]}_{k * 37 % 101}" for k in range(101)]
    rows = spectra._pair_tiles(_vectors(spark, names), "one long", _all, 16).select("a", "b").collect()
    order = sorted(names)
    assert sorted((r.a, r.b) for r in rows) == [(a, b) for k, a in enumerate(order) for b in order[k + 1 :]]
    changes = sum(x.a != y.a for x, y in zip(rows, rows[1:], strict=False))
    assert changes < len(rows) / 4


def test_few_records_are_met_in_many_tasks(spark):
    rows = spectra._pair_tiles(_vectors(spark, [f"r{k}" for k in range(300)]), "one long", _all)
    assert rows.rdd.getNumPartitions() > 4 and rows.count() == 300 * 299 // 2


def test_equal_names_make_no_pair_of_their_own(spark):
    rows = spectra._pair_tiles(_vectors(spark, ["b"] * 9 + ["a", "c", "c"]), "one long", _all, 2).collect()
    assert sorted((r.a, r.b) for r in rows) == [("a", "b")] * 9 + [("a", "c")] * 2 + [("b", "c")] * 18


def test_no_records_no_pairs(spark):
    assert spectra._pair_tiles(_vectors(spark, ["x"]).limit(0), "one long", _all).count() == 0
    assert spectra._pair_tiles(_vectors(spark, ["x"]), "one long", _all).count() == 0


@pytest.mark.parametrize("dense", [0, 3, 40, 10**9])
def test_common_words_by_pairs_and_by_columns(dense):
    rng = np.random.default_rng(5)
    share = rng.random(4096) ** 3
    x, y = (rng.random((n, 4096)) < share * rng.random((n, 1)) for n in (13, 9))
    x[4] = False
    shared, m, n = spectra._shared(*(spectra._word_rows([np.packbits(r).tobytes() for r in z]) for z in (x, y)), dense)
    assert shared.tolist() == (x.astype(int) @ y.T.astype(int)).tolist()
    assert m.tolist() == x.sum(1).tolist() and n.tolist() == y.sum(1).tolist()


def test_quick_rounding_is_rounding(spark):
    rng = np.random.default_rng(6)
    u = rng.integers(1, 16385, 20_000)
    x = [*(rng.integers(0, u + 1) / u), *(rng.random(5000) * np.pi), *((rng.integers(-3_000_000, 3_000_000, 5000) + 0.5) / 1e6), *(rng.normal(size=500) * 1e9), -0.0, -1e-9, 999.9999995, 1e300, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in x], "x double")
    assert df.where(~(catalog.quick_round(F.col("x")) + 0.0).eqNullSafe(F.round("x", 6) + 0.0)).collect() == []
    plan = catalog.rounded(df, catalog.quick_round)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan


def test_millionths_are_rounding(spark):
    rng = np.random.default_rng(8)
    u = rng.integers(1, 16385, 20_000)
    x = [*(rng.integers(0, u + 1) / u), *(rng.random(5000) * np.pi), *((rng.integers(0, 3_000_000, 5000) + 0.5) / 1e6), 0.0, 1.0, 1e-9, 5e-7, 999.9999995]
    got = spectra._millionths(np.array(x)) / 1e6
    df = spark.createDataFrame(list(zip(map(float, x), got.tolist(), strict=True)), "x double, got double")
    assert df.where(F.col("got") != F.round("x", 6)).collect() == []


@pytest.mark.parametrize("whole", [True, False])
def test_pairs_are_dealt_once_and_equal_values_meet(whole):
    rng = np.random.default_rng(9)
    n = 700
    rank = rng.permutation(2 * n)
    low, high = (rank[:n], rank[:n]) if whole else (rank[:n], rank[n:])
    j, f = (np.clip(rng.normal(m, s, (n, n)), 0, 3e6).astype(np.int32) for m, s in ((120_000, 40_000), (1_900_000, 30_000)))
    before = low[:, None] < high[None]
    at, first = spectra._dealt(before, None if whole else low[:, None] > high[None], [j.ravel(), f.ravel()])
    a, b = np.where(first, low[at // n], high[at % n]), np.where(first, high[at % n], low[at // n])
    assert (a < b).all()
    want = {tuple(sorted((x, y))) for x in low.tolist() for y in high.tolist() if x != y}
    assert len(at) == len(want) and set(zip(a.tolist(), b.tolist(), strict=True)) == want
    kinds = [len(np.unique(z.ravel()[at])) for z in (j, f)]
    lead, other = (z.ravel()[at] for z in ((j, f) if kinds[0] > kinds[1] else (f, j)))
    assert len(np.unique(other[: spectra.PAGE])) <= spectra.CELL
    assert (np.diff(lead) < 0).sum() <= 2


def test_written_pairs_take_less_room_than_their_doubles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spectra, "LEAST_BLOCKS", 1)
    rng = np.random.default_rng(10)
    units = rng.choice(list("ACGT"), (2, 4000))
    texts = []
    for k in range(900):
        t = units[k % 2].copy()
        at = rng.random(4000) < rng.random() * 0.6
        t[at] = rng.choice(list("ACGT"), at.sum())
        texts.append("".join(t[: rng.integers(500, 4000)]))
    docs = [(k, t, "xx", f"s{k}") for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    catalog.QUERIES["record_pairs"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").count()
    assert rows == 900 * 899 // 2
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 14 * rows


@pytest.mark.parametrize(("number", "high"), [(np.uint32, 1 << 28), (np.uint32, (1 << 32) - 1), (np.uint64, (1 << 64) - 1)])
def test_blocks_laid_out_by_word_once_meet_without_sorting_their_words(number, high, monkeypatch):
    rng = np.random.default_rng(11)
    words = np.unique(rng.integers(0, high, 3000, dtype=np.uint64, endpoint=True).astype(number))
    share = rng.random(len(words)) ** 4
    x, y = ([words[rng.random(len(words)) < share] for _ in range(n)] for n in (70, 41))
    x[3] = x[3][:0]
    p, q = spectra._word_lists(x), spectra._word_lists(y)
    monkeypatch.setattr(spectra, "_word_lists", None)
    for dense, most in ((None, 1 << 21), (0, 100), (30, 100), (10**9, 100)):
        shared, m, n = spectra._shared_lists(p, q, number, dense, most)
        assert shared.tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]
        assert m.tolist() == list(map(len, x)) and n.tolist() == list(map(len, y))
    none = [z[:0] for z in y]
    monkeypatch.undo()
    assert not spectra._shared_lists(p, spectra._word_lists(none), number)[0].any()
