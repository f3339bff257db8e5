"""Registered plans read whole records: what each query must return over the smallest tables."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import kernels
from strandline.operators import fractal, graphs, windows
from strandline.plans import catalog, features

from .conftest import SF


@pytest.fixture(scope="module")
def lengths(spark):
    return {r.name: r.n for r in catalog.seqs(spark, SF).select("name", F.length("sequence").alias("n")).collect()}


def test_window_features_read_whole_records(spark, lengths):
    rows = catalog.QUERIES["window_features"](spark, SF).collect()
    assert {s: {r.organism: r.length_bp for r in rows if r.source == s} for s in {r.source for r in rows}} == dict.fromkeys(("observed", "shuffle", "markov1", "revcomp"), lengths)
    for r in rows:
        assert (r.dfa_proxy_alpha_mean is None) == (r.length_bp < 4096)
        assert (r.mi_lag1000 is None) == (r.length_bp <= 1000)
        assert (r.mi_lag3000 is None) == (r.length_bp <= 3000)


def test_controls_of_whole_records(spark, lengths):
    rows = catalog.QUERIES["windows_with_controls"](spark, SF).collect()
    assert len(rows) == 8 * len(lengths)
    assert all(len(r.sequence) == lengths[r.organism] for r in rows)


def test_all_orders_of_the_fluctuation(spark, lengths):
    seqs = {r.name: r.sequence for r in catalog.seqs(spark, SF).collect()}
    got = {}
    for r in catalog.QUERIES["fluctuation_orders"](spark, SF).collect():
        got.setdefault(r.name, {})[r.q] = r.h
    assert got.keys() == lengths.keys() and any(n >= 4096 for n in lengths.values())
    for name, h in got.items():
        assert sorted(h) == [-4, -2, 0, 2, 4]
        assert all((x is None) == (lengths[name] < 4096) for x in h.values())
        if lengths[name] >= 4096 and not re.search("[AG]{15}|[CT]{15}", seqs[name]):
            k = kernels.dfa(seqs[name])
            assert sum(h.values()) / 5 == pytest.approx(k["dfa_proxy_alpha_mean"], abs=1e-5)
            assert max(h.values()) - min(h.values()) == pytest.approx(k["dfa_proxy_width"], abs=1e-5)


def test_straight_segments_have_no_variance(spark):
    steps = "AAAAACAGTC" * 40 + "G" * 320 + "T" * 80
    df = spark.createDataFrame([("s", steps)], "name string, sequence string")
    rows = fractal.fluctuation(catalog._purine_walk(df), F.array(F.lit(16), F.lit(20))).collect()
    x = np.cumsum([1.0 if b in "AG" else -1.0 for b in steps])
    for r in rows:
        y = x[r.seg * r.scale : (r.seg + 1) * r.scale]
        t = np.arange(r.scale)
        assert r["var"] == pytest.approx(np.mean((y - np.polyval(np.polyfit(t, y, 1), t)) ** 2), abs=1e-9)
        assert (r["var"] == 0) == (abs(y[-1] - y[0]) == r.scale - 1)
    assert len(rows) == 50 + 40 and sum(r["var"] == 0 for r in rows) >= 40


def test_controls_of_every_window(spark, lengths):
    """By brute force over all replicates, with the windows that the query reads."""
    seqs = {r.name: r.sequence for r in catalog.seqs(spark, SF).collect()}
    rows = windows.with_controls(windows.observed(catalog.seqs(spark, SF), catalog.WIN, 8, 100), catalog._KINDS[1:]).collect()
    found = {}
    for r in rows:
        found.setdefault((r.organism, r.replicate), {})[r.source] = r
    swap = str.maketrans("ACGT", "TGCA")
    for (name, _), kinds in found.items():
        own = kinds["observed"]
        assert sorted(kinds) == sorted(catalog._KINDS)
        assert own.sequence == seqs[name][own.start : own.end] and len(own.sequence) == min(catalog.WIN, lengths[name])
        assert all(len(r.sequence) == len(own.sequence) and set(r.sequence) <= set("ACGT") for r in kinds.values())
        assert Counter(own.sequence) == Counter(kinds["shuffle"].sequence) == Counter(kinds["block_shuffle"].sequence)
        assert kinds["revcomp"].sequence == own.sequence.translate(swap)[::-1]
    per = Counter(name for name, _ in found)
    assert per == {n: 1 if size <= catalog.WIN else min(8, size - catalog.WIN + 1) for n, size in lengths.items()}
    got = {(r.organism, r.source): (r.n_windows, r.n_unlike) for r in catalog.QUERIES["control_invariants"](spark, SF).collect()}
    assert got == {(n, k): (per[n], 0) for n in lengths for k in catalog._KINDS}


def test_control_invariants_see_a_fault(spark, monkeypatch):
    real = windows.with_controls
    late = (F.col("replicate") == 3) & (F.col("source") == "shuffle")
    monkeypatch.setattr(windows, "with_controls", lambda *a: real(*a).withColumn("sequence", F.when(late, F.translate("sequence", "A", "C")).otherwise(F.col("sequence"))))
    rows = catalog.QUERIES["control_invariants"](spark, SF).collect()
    assert sum(r.n_unlike for r in rows) > 0 and all(r.n_unlike == 0 for r in rows if r.source != "shuffle")


def test_words_that_occur_once(spark):
    seqs = [r.sequence for r in catalog.seqs(spark, SF).collect()]
    want = Counter(s[i : i + 11] for s in seqs for i in range(len(s) - 10))
    assert {r.kmer: r.cnt for r in catalog.QUERIES["kmer_counts_11"](spark, SF).collect()} == want and 1 in want.values()


def test_default_rounds_and_effects(spark):
    ranks = {r.node: r["rank"] for r in catalog.QUERIES["pagerank_frame_20"](spark, SF).collect()}
    want = {r.node: r["rank"] for r in graphs.pagerank(catalog._edges(spark, SF), rounds=20, tol=0).collect()}
    assert ranks == pytest.approx(want, abs=1e-6)
    features = catalog.table(spark, SF, "orders").select("o_orderpriority").distinct().count()
    assert catalog.QUERIES["top_effects_20"](spark, SF).count() == min(20, features) > 3


def test_feature_summary_makes_no_controls(spark, monkeypatch):
    want = {r.organism: r for r in catalog.rounded(features.summary(catalog._features(spark, SF))).collect()}

    def refuse(*_):
        raise AssertionError("a control was made")

    monkeypatch.setattr(windows, "with_controls", refuse)
    assert {r.organism: r for r in catalog.QUERIES["feature_summary"](spark, SF).collect()} == want
