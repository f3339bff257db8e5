import gzip
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import symbols as S
from strandline.operators import graphs, stats, tiles, windows
from strandline.plans import features
from strandline.plans.config import Config
from strandline.sources import records, sinks


def frame(spark, *seqs):
    return spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(seqs)], "name string, sequence string")


def test_clean_and_types(spark):
    r = spark.range(1).select(S.clean(F.lit("aCgTuNxyz")).alias("c"), S.revcomp(F.lit("AACGT")).alias("r"), S.organism_type(F.lit("my_phage")).alias("t"), S.organism_type(F.lit("x"), F.lit("Fungi")).alias("a"), S.organism_type(F.lit("x"), F.lit("odd")).alias("o"), S.organism_type(F.lit("SV40"), F.lit("unknown")).alias("n")).first()
    assert tuple(r) == ("ACGTT", "ACGTT", "phage", "fungus", "odd", "virus")


def test_kmers_of_edge_lengths(spark):
    df = frame(spark, "", "A", "AC", "ACG", "ACGTACGT", "NNNN", "ACNGT" * 900)
    for k in (1, 2, 3, 9):
        got = {(r.name, r.kmer): r.cnt for r in tiles.kmer_counts(df, k).collect()}
        want = {}
        for r in df.collect():
            for i in range(len(r.sequence) - k + 1):
                w = r.sequence[i : i + k]
                if "N" not in w:
                    want[r.name, w] = want.get((r.name, w), 0) + 1
        assert got == want
    assert {r.cnt for r in tiles.kmer_counts(frame(spark, "ACGTACGT"), 2).where("kmer = 'AC'").collect()} == {2}


def test_spans():
    assert windows.spans(1000, 200, 3, 10, random.Random(1))[0] == (0, 200)
    assert windows.spans(5, 200, 3, 10, random.Random(1)) == [(0, 5)]
    assert windows.spans(0, 200, 3, 10, random.Random(1)) == []
    assert len(windows.spans(203, 200, 8, 10, random.Random(1))) == 4
    for n in range(201, 400, 17):
        s = windows.spans(n, 200, 8, 10, random.Random(n))
        assert s[0][0] == 0 and s[-1][1] == n and all(b - a == 200 for a, b in s) and s == sorted(set(s))


def test_controls_keep_what_they_should():
    rng = random.Random(3)
    s = "ACGTTGCA" * 40
    assert sorted(windows.control(s, "shuffle", rng)) == sorted(s)
    assert windows.control("AAAACCCC", "block_shuffle", rng, 4) in ("AAAACCCC", "CCCCAAAA")
    for k in range(4):
        c = windows.control(s, f"markov{k}", rng)
        assert len(c) == len(s) and set(c) <= set("ACGT")
    assert len(windows.control("ACGTACGT", "markov2", rng)) == 8
    assert windows.control("", "markov1", rng) == ""
    assert windows.control_names(["Block-Shuffle", "none", "", "blockshuffle", "observed"]) == ["block_shuffle"]
    with pytest.raises(ValueError):
        windows.control(s, "magic", rng)


def test_shared_and_own_generators_are_reproducible(spark):
    df = frame(spark, "ACGT" * 500, "GGCA" * 700).withColumns({"accession": F.lit("a"), "organism_type": F.lit("t")})
    for shared in (True, False):
        a, b = ([tuple(r) for r in windows.with_controls(windows.observed(df, 300, 5, 10, shared_rng=shared)).orderBy("organism", "replicate", "source").collect()] for _ in range(2))
        assert a == b and len(a) == 2 * 5 * 4


def test_permutation_p_against_all_signs():
    d = np.array([0.5, 1.0, -0.2, 0.8, 0.4, 0.9])
    exact = np.mean([abs((d * s).mean()) >= abs(d.mean()) - 1e-12 for s in itertools.product((-1, 1), repeat=6)])
    assert stats.sign_flip_p(d, 4000, 1) == pytest.approx(exact, abs=0.03)
    assert stats.sign_flip_p(np.array([1.0, 1.0, 1.0]), 31, 1) > 0
    assert stats.sign_flip_p(np.array([1.0]), 31, 1) is None
    assert stats.sign_flip_p(np.array([1.0, -1.0]), 31, 1) == 1.0


def test_pearson_p():
    assert stats.pearson_p(0.5, 10) == pytest.approx(0.1411, abs=1e-4)
    assert stats.pearson_p(0.9, 5) == pytest.approx(0.0374, abs=1e-4)
    assert stats.pearson_p(1.0, 5) == 0.0 and stats.pearson_p(0.1, 2) is None


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 1), ("d", "d", 2), ("x", "y", 1)], "src string, dst string, weight long")
    assert sum(r["rank"] for r in graphs.pagerank(e).collect()) == pytest.approx(1)
    one = {r.node: r["rank"] for r in graphs.pagerank(e, rounds=8, tol=0).collect()}
    two = {r.node: r["rank"] for r in graphs.pagerank_frame(e, rounds=8).collect()}
    assert one == pytest.approx(two)
    assert {r.node: r.component for r in graphs.strong_components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "x": "x", "y": "y"}
    assert {r.node: r.betweenness for r in graphs.betweenness(e).collect()}["c"] == pytest.approx(3 / 20)
    parts, score = graphs.communities(e)
    assert {r.node for r in parts.where("community = 0").collect()} >= {"a", "b", "c"} and 0 < score < 1
    assert isinstance(graphs.clustering_z(e), float)
    whole = graphs.stats(e, 2).first()
    assert (whole.nodes, whole.edges) == (6, 6)
    assert graphs.pagerank(e.limit(0)).count() == 0


def test_fasta_metadata_and_cache(spark, tmp_path):
    (tmp_path / "one.fasta").write_text(">first seq!\r\nACGU\nnnA\n>second\nTT\n")
    with gzip.open(tmp_path / "two.fa.gz", "wt") as f:
        f.write("acgt\n")
    r = records.read_fasta(spark, str(tmp_path / "one.fasta")).first()
    assert (r.name, r.sequence, r.accession, r.raw_length) == ("first_seq_", "ACGTATT", "one.fasta", 9)
    assert [x.sequence for x in records.read_fasta(spark, str(tmp_path / "one.fasta"), split_records=True).orderBy("name").collect()] == ["ACGTA", "TT"]
    assert records.read_fasta(spark, str(tmp_path / "two.fa.gz")).first().name == "two"
    (tmp_path / "m.csv").write_text("path,name,accession,organism_type,extra\nx/one.fasta,Named,acc,plant,1\n,two,,fungi,\n,two,,human,2\n")
    meta = records.read_metadata(spark, str(tmp_path / "m.csv"))
    assert {x.key for x in meta.collect()} == {"x/one.fasta", "Named", "acc", "one.fasta", "one", "two"}
    both = records.read_fasta(spark, str(tmp_path / "one.fasta")).unionByName(records.read_fasta(spark, str(tmp_path / "two.fa.gz")))
    got = {x.name: (x.organism_type, x.metadata.get("extra")) for x in records.apply_metadata(both, meta).collect()}
    assert got == {"Named": ("plant", "1"), "two": ("human", "2")}
    tries = []

    def fetch(accession):
        tries.append(accession)
        if len(tries) < 2:
            raise OSError("away")
        return ">x\nACGT\n"

    cache = records.FetchCache(tmp_path / "cache", fetch, sleep=lambda s: None)
    assert cache.path("n", "ACC").exists() and len(tries) == 2
    assert cache.path("n", "ACC").exists() and len(tries) == 2
    assert cache.records()["ACC"]["downloaded_this_run"] is False
    assert records.FetchCache(tmp_path / "cache").path("n", "other") is None
    (tmp_path / "cache" / "fetch_metadata.json").write_text("broken")
    assert cache.records() == {}
    assert records.catalog(spark, "full").count() == 13 and records.catalog(spark, "mega").count() == 47


def test_sinks(spark, tmp_path):
    assert sinks.json_safe({"a": [float("nan"), np.float64(1)], 2: float("inf")}) == {"a": [None, 1.0], "2": None}
    sinks.write_json(tmp_path / "x.json", {"b": 1, "a": float("nan")})
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": None, "b": 1}
    df = spark.createDataFrame([("x", 1.0, "o")], "z string, feature double, organism string")
    assert sinks.ordered(df).columns == ["organism", "z", "feature"]
    nested = sinks.report(spark.createDataFrame([("f", "c", 1.0), ("f", "d", 2.0)], "feature string, control string, p double")).first()
    assert nested.controls["d"].p == 2.0


def test_whole_run(spark, tmp_path):
    from strandline.__main__ import main

    rng = random.Random(5)
    for n in range(2):
        (tmp_path / f"g{n}.fasta").write_text(f">genome{n}\n" + "".join(rng.choice("ACGT") for _ in range(3000)) + "\n")
    args = ["--fasta", str(tmp_path / "g0.fasta"), str(tmp_path / "g1.fasta"), "--out", str(tmp_path / "out"), "--window", "1000", "--windows-per-genome", "3", "--permutations", "19", "--fast"]
    assert main(args, spark) == 0
    tests = json.loads((tmp_path / "out" / "hypothesis_report.json").read_text())
    assert {t["control"] for t in tests} == {"shuffle", "markov1", "revcomp"} and all(0 < t["p_fdr_bh"] <= 1 for t in tests)
    assert json.loads((tmp_path / "out" / "qc_report.json").read_text())["n_windows_total"] == 2 * 3 * 4
    assert main(["--out", str(tmp_path / "none")], spark) == 2


def test_feature_groups_decide_the_columns(spark):
    df = frame(spark, "ACGT" * 300).withColumns({"accession": F.lit("a"), "organism_type": F.lit("t")})
    w = windows.observed(df, 500, 2, 10)
    assert "mi_lag3" in features.build(w, Config(features=("dependency",), dependency_lags=(1, 3))).columns
    assert features.build(w, Config(features=("basic",))).columns[-1] == "dinu_rho_dev"
