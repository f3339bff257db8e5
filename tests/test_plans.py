import random

import numpy as np
from pyspark.sql import functions as F

from strandline.functions import kernels as K
from strandline.functions import profile
from strandline.operators import fractal, spectra, stats, windows
from strandline.plans import battery
from strandline.plans.config import Config
from strandline.sources import records


def frame(spark):
    rng = random.Random(9)
    seqs = ["", "A", "ACGT", "A" * 700, "ACG" * 400, *("".join(rng.choice("ACGT") for _ in range(n)) for n in (50, 95, 499, 501, 1000, 2047, 7000))]
    return spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(seqs)], "name string, sequence string")


def test_profile_equals_the_relational_forms(spark):
    df, cfg = frame(spark), Config()
    mi = spectra.mutual_information(df, cfg.dependency_lags)
    lags = mi.groupBy("name").agg(*(F.max(F.when(F.col("lag") == k, F.col("mi"))).alias(f"mi_lag{k}") for k in cfg.dependency_lags))
    tables = [
        spectra.rho_summary(df).select("name", "dinu_rho_dev"), fractal.box_dimension(df), spectra.patch_inconsistency(df), spectra.fisher_to_uniform(df), spectra.phase3(df), spectra.gc_skew(df), lags, spectra.dependency_summary(mi),
        spectra.kmer_entropy(df, 7).select("name", F.col("entropy_norm").alias("kmer_entropy_norm"), F.col("occupancy").alias("kmer_occupancy")), spectra.kmer_entropy(df, 4).select("name", F.col("occupancy").alias("debruijn_k4_occupancy")),
    ]
    want = {r.name: {} for r in df.collect()}
    for t in tables:
        for r in t.collect():
            want[r.name] |= {k: v for k, v in r.asDict().items() if k != "name"}
    groups = profile.groups(cfg)
    for r in df.collect():
        got = {k: v for _, fn in groups.values() for k, v in fn(K.encode(r.sequence, drop=False)).items()}
        assert sorted(got) == sorted(n for names, _ in groups.values() for n in names)
        for k, v in got.items():
            w = want[r.name].get(k)
            assert (v is None) == (w is None) and (v is None or abs(v - w) < 1e-9), (r.name, k, v, w)


def test_pairs_over_many_blocks(spark):
    df = frame(spark)
    words = {r.name: {r.sequence[i : i + 3] for i in range(len(r.sequence) - 2)} for r in df.collect()}
    vectors = spectra._vectors(df, lambda a: np.packbits(profile.counts(a, 3) > 0))

    def compare(x, y):
        p, q = (np.stack([np.unpackbits(np.frombuffer(v, np.uint8)) for v in z]).astype(int) for z in (x, y))
        return p @ q.T > 0, {"shared": p @ q.T}

    for rows in (spectra._pair_tiles(vectors, "shared long", compare, 2), spectra.jaccard(df, 3)):
        got = {(r.a, r.b): r.shared for r in rows.collect()}
        assert got == {(a, b): len(words[a] & words[b]) for a in words for b in words if a < b and words[a] & words[b]}


def test_benjamini_hochberg_over_ranges(spark):
    rng = random.Random(2)
    p = [rng.choice([None, 0.01, rng.random() ** 3]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(p)), "k long, p double").repartition(6)
    got = {r.k: r.q for r in stats.benjamini_hochberg(df, "p", ["k"], "q").collect()}
    order = sorted(range(500), key=lambda k: (p[k] is None, p[k] or 0.0, k))
    least, want = 1.0, {}
    for rank in range(500, 0, -1):
        k = order[rank - 1]
        least = min(least, 1.0 if p[k] is None else p[k] * 500 / rank)
        want[k] = 1.0 if p[k] is None else least
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(got) == 500


def test_permutation_sums(spark):
    rng = random.Random(4)
    rows = [(f, "c", k, rng.gauss(m, 1), 0.0) for f, m in (("far", 3.0), ("near", 0.0)) for k in range(60)] + [("one", "c", 1, 1.0, 0.0), ("zero", "c", 1, 1.0, 1.0), ("zero", "c", 2, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "feature string, control string, k long, o double, c double")
    got = {r.feature: r.paired_permutation_p for r in stats.permutation_sums(df, 499).collect()}
    again = {r.feature: r.paired_permutation_p for r in stats.permutation_sums(df.repartition(5), 499).collect()}
    exact = {r.feature: r.paired_permutation_p for r in stats.permutation_tests(df, 499).collect()}
    assert got == again and got["one"] is None and got["zero"] == 1.0
    assert got["far"] == exact["far"] == 1 / 500 and abs(got["near"] - exact["near"]) < 0.1


def test_records_of_one_name_keep_their_windows(spark):
    rows = [("x", "a", "t", "A" * 50), ("x", "b", "t", "C" * 80), ("y", "c", "t", "")]
    df = spark.createDataFrame(rows, "name string, accession string, organism_type string, sequence string")
    out = windows.observed(df, 10, 4, 5).collect()
    assert len(out) == 8 and all(r.sequence == ("A" if r.accession == "a" else "C") * 10 for r in out)


def test_registered_controls_and_groups(spark):
    windows.register_control("flip-ends", lambda s, rng: s[-1:] + s[1:-1] + s[:1])
    windows.register_group("ends", ("same_ends",), lambda s, cfg: {"same_ends": float(s[:1] == s[-1:])})
    try:
        df = spark.createDataFrame([("x", "a", "t", "ACGG")], "name string, accession string, organism_type string, sequence string")
        w = windows.with_controls(windows.observed(df, 10, 4, 2), ("flip_ends",))
        assert {r.source: r.sequence for r in w.collect()} == {"observed": "ACGG", "flip_ends": "GCGA"}
        assert windows.kernel_features(w, ["ends"], Config(), ["source"]).where("same_ends = 0").count() == 2
    finally:
        del windows.CUSTOM["flip_ends"], windows.GROUPS["ends"]


def test_summary_files(spark, tmp_path):
    toy = records.toy(spark).where("name IN ('phiX174', 'T7_phage')").withColumn("organism_type", F.lit("phage"))
    battery.save_summary(battery.summary(toy), str(tmp_path))
    csv = spark.read.csv(f"{tmp_path}/summary_results_csv", header=True)
    js = spark.read.json(f"{tmp_path}/summary_results_json")
    assert len(csv.columns) == 21 and sorted(csv.columns) == sorted(js.columns) and csv.count() == js.count() == 2


def test_self_test(spark):
    from strandline.__main__ import main

    assert main(["--self-test"], spark) == 0


def test_the_battery_reads_records_once(spark):
    from strandline.plans import battery

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    df = spark.createDataFrame([(f"r{k}", "virus", "ACGTTGCA" * (200 + k)) for k in range(3)], "name string, organism_type string, sequence string")
    assert battery.summary(df.mapInPandas(seen, df.schema), 2000).count() == 3
    assert read.value == 3
