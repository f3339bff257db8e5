"""The feature table of windows: built-in expressions where they can say it, one Arrow pass for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import kernels as K
from strandline.functions import profile
from strandline.operators import graphs, stats, windows
from strandline.plans.config import Config
from strandline.sources.shared import checkpointed

KEY = ["organism", "replicate", "start", "end", "source"]


IDENTITY = ["organism", "accession", "organism_type", "source", "replicate", "start", "end"]


def build(wins: DataFrame, cfg: Config) -> DataFrame:
    """Identity columns, length_bp and a double column for every feature of the enabled groups.

    A window is bounded, so all its figures come from one Arrow pass over its sequence and nothing is
    shuffled. Only the distance to the mean of the observed windows asks for a second look: the pass also
    gives each window's pair shares, the features (not the sequences) are checkpointed, and 16 means come
    back to them."""
    seq = F.col("sequence")
    table = wins.select(*IDENTITY, F.length(seq).cast("long").alias("length_bp"), "sequence")
    keep = [c for c in table.columns if c != "sequence"]
    chosen = [(names, fn) for g, (names, fn) in profile.groups(cfg).items() if cfg.enabled(g)]
    kernels = [windows.GROUPS[g] for g in windows.GROUPS if cfg.enabled(g)]
    base = list(profile.COMPOSITION) if cfg.enabled("basic") else []
    names = base + [n for part, _ in kernels for n in part] + [n for part, _ in chosen for n in part]
    pairs = cfg.enabled("kmer")
    schema = ", ".join([f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} double" for n in names] + ["pairs array<double>"] * pairs)

    def work(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            rows, shares = [], []
            for s in pdf.sequence.fillna(""):
                a = K.encode(s, drop=False)
                row = profile.composition(a) if base else {}
                for _, fn in kernels:
                    row.update(fn(s, cfg))
                for _, fn in chosen:
                    row.update(fn(a))
                rows.append(row)
                shares.append(profile.shares(profile.counts(a, 2)))
            out = pd.DataFrame(rows, columns=names, dtype=float, index=pdf.index)
            out.loc[pdf.sequence.isna(), base] = np.nan
            out = pd.concat([pdf[keep], out.where(np.isfinite(out))], axis=1)
            yield out.assign(pairs=shares) if pairs else out

    feats = table.mapInPandas(work, schema)
    if not pairs:
        return feats
    feats = checkpointed(feats)
    mean = feats.where("source = 'observed'").select(F.posexplode("pairs").alias("i", "p")).groupBy("i").agg(F.avg("p").alias("p"))
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("centre"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    centre = F.transform("centre", lambda x: x / total(F.col("centre")))
    inner = total(F.zip_with("pairs", centre, lambda p, q: F.sqrt(p * q))) / F.sqrt((total(F.col("pairs")) + 1e-15) * (total(centre) + 1e-15))
    distance = F.when(F.col("source") == "observed", 2 * F.acos(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inner))))
    return feats.crossJoin(F.broadcast(mean)).withColumn("fisher_to_observed_centroid", distance).drop("pairs", "centre")


def hypothesis(feats: DataFrame, cfg: Config) -> DataFrame:
    """Paired statistics, permutation p-values and adjusted p-values by feature and control."""
    pairs = stats.paired(stats.long_form(feats, KEY), [k for k in KEY if k != "source"])
    tested = stats.paired_stats(pairs).join(stats.permutation_sums(pairs, cfg.permutations, cfg.seed), ["feature", "control"])
    return stats.benjamini_hochberg(tested, "paired_permutation_p", ["feature", "control"])


def summary(feats: DataFrame) -> DataFrame:
    obs = feats.where("source = 'observed'")
    return stats.summary(obs, "organism", stats.numeric_columns(obs), ["organism_type", "accession"])


def graph_report(records: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """Graph figures per record (over its first window * windows symbols) and over all."""
    cut = records.select("name", F.substring(F.col("sequence"), F.lit(1), F.lit(cfg.window * max(1, cfg.windows_per_genome))).alias("sequence"))
    per = graphs.edges(cut, cfg.graph_k, ("name",))
    whole = per.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return graphs.stats(per, cfg.graph_k, ("name",)), graphs.stats(whole, cfg.graph_k)


def figures(feats: DataFrame, tests: DataFrame) -> dict[str, DataFrame]:
    """The table behind each figure; nothing is drawn."""
    s = summary(feats)
    bars = {c[:-5]: s.select("organism", "organism_type", F.col(c).alias("mean"), F.col(f"{c[:-5]}_ci95").alias("ci95")).orderBy("organism") for c in s.columns if c.endswith("_mean") and f"{c[:-5]}_ci95" in s.columns}
    return bars | {"top_effects": stats.top_effects(tests)}


def quality(records: DataFrame, wins: DataFrame, feats: DataFrame, cfg: Config) -> dict:
    """Figures of a run, of a few rows each."""
    n = records.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sequence")).alias("clean"), F.sum(F.coalesce(F.nullif("raw_length", F.lit(0)), F.length("sequence"))).alias("raw"), F.avg(100.0 * F.length("sequence") / F.coalesce(F.nullif("raw_length", F.lit(0)), F.length("sequence"))).alias("kept")).first()
    by = lambda df, c: {r[0]: r[1] for r in df.groupBy(c).count().collect()}
    cols = stats.numeric_columns(feats)
    bp = wins.agg(F.sum(F.length("sequence"))).first()[0] or 0
    sources = by(wins, "source")
    return {
        "backend": "spark", "n_sequences": n.n, "total_clean_bp": n.clean, "total_raw_bp": n.raw, "mean_retained_pct": n.kept, "organism_type_counts": by(records, "organism_type"),
        "n_windows_total": sum(sources.values()), "window_source_counts": sources, "window_payload_bp_including_controls": bp, "estimated_window_payload_mb": bp / 1e6,
        "feature_columns": cols, "feature_nan_rates": {r.feature: r.nan_rate for r in stats.quality(feats, cols, KEY).collect()}, "controls": list(cfg.controls), "features_enabled": list(cfg.features),
        "dependency_lags": list(cfg.dependency_lags), "resonance_max_period": cfg.resonance_max_period, "grammar_sketch_dim": cfg.grammar_sketch_dim, "grammar_levels": cfg.grammar_levels,
    }
