"""Command line: python -m strandline --fasta FILES --out FOLDER [options]."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandline.operators import graphs, windows
from strandline.plans import battery, features
from strandline.plans.config import FAST, GROUPS, Config
from strandline.sources import cache, records, sinks


def parse(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="strandline")
    p.add_argument("--fasta", nargs="*", action="extend", default=[], help="FASTA files; can be repeated")
    p.add_argument("--keep-symbols", action="store_true", help="clean case and U only")
    p.add_argument("--split-records", action="store_true", help="every record of a file on its own")
    p.add_argument("--cache", help="folder of cached FASTA files by accession")
    p.add_argument("--email", help="address told to NCBI; without one only cached files are read")
    p.add_argument("--no-fetch", action="store_true", help="cached files only")
    p.add_argument("--ncbi-retries", type=int, default=3)
    p.add_argument("--ncbi-backoff", type=float, default=1.5)
    p.add_argument("--ncbi-api-key", default=os.environ.get("NCBI_API_KEY", ""))
    for level in list(records.LEVELS)[1:]:
        p.add_argument(f"--{level}", action="store_true")
    p.add_argument("--diverse-eukaryotes", action="store_true", help="adds the tier of eukaryotes")
    p.add_argument("--no-bundled", action="store_true")
    p.add_argument("--metadata-csv")
    p.add_argument("--out", default="out")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--shared-rng", action="store_true", help="one generator for the windows of all records")
    p.add_argument("--counter-draws", action="store_true", help="controls by keyed draws of places")
    p.add_argument("--window", type=int, default=200_000)
    p.add_argument("--windows-per-genome", type=int, default=8)
    p.add_argument("--min-window", type=int, default=1000)
    p.add_argument("--jaccard-k", type=int, default=7)
    p.add_argument("--graph-k", type=int, default=4)
    p.add_argument("--controls", default="shuffle,markov1,revcomp")
    p.add_argument("--features", default=",".join(GROUPS))
    p.add_argument("--fast", action="store_true")
    p.add_argument("--permutations", type=int, default=999)
    p.add_argument("--block-size", type=int, default=500)
    p.add_argument("--dependency-lags", "--lags", dest="lags", default="1,2,3,6,9,12,30,100,300,1000,3000,10000")
    p.add_argument("--resonance-max-period", "--max-period", dest="max_period", type=int, default=2048)
    p.add_argument("--grammar-sketch-dim", "--sketch-dim", dest="sketch_dim", type=int, default=512)
    p.add_argument("--grammar-levels", "--levels", dest="levels", type=int, default=4)
    p.add_argument("--no-debruijn", "--no-graph", dest="no_graph", action="store_true")
    p.add_argument("--no-plots", action="store_true", help="leaves out the tables behind the figures")
    p.add_argument("--battery", action="store_true", help="whole-record invariants instead of windows")
    p.add_argument("--self-test", action="store_true", help="the whole plan on the toy corpus, then exit")
    # Spark's own settings take the place of these; they are accepted and have no effect.
    for name, kind in (("--gpu-device", int), ("--workers", int), ("--chunksize", int), ("--progress-every", int)):
        p.add_argument(name, type=kind, help=argparse.SUPPRESS)
    p.add_argument("--gpu", action="store_true", help=argparse.SUPPRESS)
    return p.parse_args(argv)


def self_test(spark: SparkSession) -> int:
    """0 if the toy corpus has its known sizes and every feature column comes out."""
    toy = records.toy(spark).withColumns({"accession": F.col("name"), "organism_type": F.lit("toy")})
    cfg = Config(window=1000, windows_per_genome=2, min_window=100, permutations=31, dependency_lags=(1, 2, 3))
    whole = graphs.stats(graphs.edges(toy.select("name", "sequence"), 3), 3).first()
    feats = features.build(windows.with_controls(windows.observed(toy, cfg.window, cfg.windows_per_genome, cfg.min_window, cfg.seed), cfg.controls, cfg.seed), cfg)
    tests = features.hypothesis(feats, cfg)
    good = toy.agg(F.sum(F.length("sequence"))).first()[0] == 105_000 and (whole.nodes, whole.edges) == (16, 64)
    good = good and tests.where("p_fdr_bh > 0 AND p_fdr_bh <= 1").count() == tests.count() > 0
    print("self-test passed" if good else "self-test failed")
    return 0 if good else 1


def config(a: argparse.Namespace) -> Config:
    split = lambda s: tuple(x.strip() for x in s.split(",") if x.strip())
    return Config(
        seed=a.seed, window=a.window, windows_per_genome=a.windows_per_genome, min_window=a.min_window, jaccard_k=a.jaccard_k, graph_k=a.graph_k, controls=split(a.controls),
        features=FAST if a.fast else split(a.features), permutations=a.permutations, block_size=a.block_size, dependency_lags=tuple(map(int, split(a.lags))),
        resonance_max_period=a.max_period, grammar_sketch_dim=a.sketch_dim, grammar_levels=a.levels, shared_rng=a.shared_rng,
    )


def main(argv=None, spark: SparkSession | None = None) -> int:
    a = parse(argv)
    cfg = config(a)
    spark = spark or SparkSession.builder.appName("strandline").getOrCreate()
    if a.self_test:
        return self_test(spark)
    out = Path(a.out)
    out.mkdir(parents=True, exist_ok=True)
    log = sinks.logger(out)
    if a.gpu or a.workers or a.chunksize or a.gpu_device or a.progress_every:
        log.info("--gpu, --gpu-device, --workers, --chunksize and --progress-every have no effect: Spark deals the work")
    read = lambda path: records.read_fasta(spark, path, a.split_records, a.keep_symbols)
    frames = [read(f) for f in a.fasta]
    if a.cache and not a.no_bundled:
        level = next((x for x in reversed(records.LEVELS) if getattr(a, x, False)), "core")
        bundle = records.catalog(spark, level)
        if a.diverse_eukaryotes:
            bundle = bundle.unionByName(records.catalog(spark, "mega").where(F.col("name").isin(*records.TIERS["diverse"]))).dropDuplicates(["name"])
        named = {r.accession: r.name for r in bundle.collect()}  # at most the catalogue's rows
        cache.register(spark)
        asked = spark.read.format("sequence_cache").options(path=a.cache, accessions=",".join(named), partitions=4, retries=a.ncbi_retries, backoff=a.ncbi_backoff)
        if a.email and not a.no_fetch:
            asked = asked.options(email=a.email, api_key=a.ncbi_api_key)
        # Written by Spark before anything else reads it, so that nothing is fetched twice.
        told = asked.load().drop("sequence").withColumn("catalog_name", F.create_map(*(F.lit(x) for kv in named.items() for x in kv))[F.col("accession")])
        told.write.mode("overwrite").json(str(out / "fetch_metadata"))
        found = [r.cache_path for r in spark.read.schema(told.schema).json(str(out / "fetch_metadata")).where("error IS NULL").orderBy("accession").collect()]
        log.info("%d of %d accessions found in %s", len(found), len(named), a.cache)
        frames += [read(found)] if found else []
    if not frames:
        log.error("no sequences")
        return 2
    recs = records.load_records(spark, frames, records.read_metadata(spark, a.metadata_csv) if a.metadata_csv else None)
    if not recs.head(1):
        log.error("no sequences")
        return 2
    sinks.write_json(out / "manifest.json", [r.asDict() for r in records.manifest(recs).collect()])
    if a.battery:
        table = battery.summary(recs)
        battery.save_summary(table, str(out))
        sinks.write_csv(battery.pairwise(recs, a.jaccard_k), str(out / "pairs"))
        return 0
    wins = windows.with_controls(windows.observed(recs, cfg.window, cfg.windows_per_genome, cfg.min_window, cfg.seed, cfg.shared_rng), cfg.controls, cfg.seed, cfg.block_size, a.counter_draws)
    feats = features.build(wins, cfg)
    sinks.write_csv(feats, str(out / "features"))
    feats = spark.read.csv(str(out / "features"), header=True, schema=feats.select(*sinks.ordered(feats).columns).schema)
    sinks.write_csv(features.summary(feats), str(out / "summary"), one_file=True)
    tests = features.hypothesis(feats, cfg)
    sinks.write_json(out / "hypothesis_report.json", [r.asDict() for r in tests.orderBy("feature", "control").collect()])
    sinks.write_json(out / "qc_report.json", features.quality(recs, wins, feats, cfg))
    if not a.no_plots:
        for name, table in features.figures(feats, tests).items():
            sinks.write_csv(table, str(out / "figures" / name), one_file=True)
    if not a.no_graph:
        per, whole = features.graph_report(recs, cfg)
        e = graphs.edges(recs.select("name", "sequence"), cfg.graph_k)
        sinks.write_json(out / "graph_report.json", {"per_genome": [r.asDict() for r in per.collect()], "aggregate": [r.asDict() for r in whole.collect()], "top_pagerank": [tuple(r) for r in graphs.pagerank(e).orderBy("rank", ascending=False).limit(10).collect()]})
    log.info("done")
    return 0


if __name__ == "__main__":
    sys.exit(main())
