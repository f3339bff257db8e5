"""The whole-record battery: one wide row per record, and the pairwise tables beside it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import kernels as K
from strandline.functions.symbols import gc_pct
from strandline.operators import fractal, spectra, stats, windows
from strandline.sources.shared import checkpointed, saved

KERNELS = (
    "name string, fft_dominant_freq double, fft_amplitude_ratio double, fft_codon_power_ratio double, lz_complexity double, wavelet_dominant_scale double, wavelet_codon_ratio double, "
    "wavelet_helix_ratio double, mfdfa_alpha_mean double, mfdfa_spectrum_width double, svd_entropy_ratio double, betti_0 double, betti_1 double"
)


def _kernels(seq: str) -> dict:
    f, w, m, h = K.prefix_spectrum(seq), K.wavelet(seq), K.multifractal(seq), K.homology(seq)
    return {
        "fft_dominant_freq": f["dominant_freq"], "fft_amplitude_ratio": f["amplitude_ratio"], "fft_codon_power_ratio": f["codon_power_ratio"], "lz_complexity": K.zlib_ratio(seq),
        "wavelet_dominant_scale": w["dominant_scale_bp"], "wavelet_codon_ratio": w["codon_scale_ratio"], "wavelet_helix_ratio": w["helix_scale_ratio"],
        "mfdfa_alpha_mean": m["alpha_mean"], "mfdfa_spectrum_width": m["spectrum_width"], "svd_entropy_ratio": K.hankel_entropy(seq), "betti_0": h["betti_0"], "betti_1": h["betti_1"],
    }


def summary(df: DataFrame, skew_window: int = 10_000) -> DataFrame:
    """name, organism_type, length_bp and every scalar invariant, rounded as printed."""
    df = saved(df.select("name", "organism_type", "sequence"))  # each part reads the records
    base = df.select("name", "organism_type", F.length("sequence").cast("long").alias("length_bp"), F.round(gc_pct(F.col("sequence")), 2).alias("gc_pct"))
    rho = spectra.rho_summary(df).select("name", F.round("rho_mean_deviation", 4).alias("rho_mean_deviation"), "most_over", "most_under")
    entropy = spectra.kmer_entropy(df, 4).select("name", F.round("entropy_bits", 4).alias("kmer_entropy_bits"), F.round("entropy_norm", 4).alias("kmer_entropy_norm"))
    skew = spectra.skew_analysis(df, skew_window).select("name", *(F.round(c, 4).alias(c) for c in ("gc_skew_mean", "gc_skew_std", "gc_skew_max_abs", "at_skew_mean")))
    parts = [
        windows.per_record(df, KERNELS, _kernels), fractal.walk_dimension(df), rho, entropy, skew, spectra.fisher_to_centroid(df, 3).select("name", F.round("fisher_to_centroid", 4).alias("fisher_centroid_distance")),
        spectra.triple_obstruction(df).select("name", F.round("h1_obstruction", 5).alias("h1_obstruction")), spectra.degree_entropy(df).select("name", F.round("gf4_entropy", 4).alias("gf4_entropy")),
    ]
    return reduce(lambda a, b: a.join(b, "name", "left"), parts, base)


def pairwise(df: DataFrame, jaccard_k: int = 7, millionths: bool = False) -> DataFrame:
    """a, b, jaccard, fisher_rao for every pair with a common word; with `millionths`, to six places."""
    return spectra.pairs_of_records(df, jaccard_k, millionths=millionths)


def gc_correlations(table: DataFrame) -> DataFrame:
    """Pearson r and p of every scalar with the GC share."""
    features = [c for c in stats.numeric_columns(table) if c not in ("gc_pct", "length_bp")]
    return stats.with_pearson_p(stats.correlations(table, "gc_pct", features))


# Columns of the written summary, and the battery's names for them.
SUMMARY = {
    "name": "name", "organism_type": "organism_type", "length_bp": "length_bp", "gc_pct": "gc_pct", "fft_dom_freq": "fft_dominant_freq", "fft_codon_ratio": "fft_codon_power_ratio", "fft_amp_ratio": "fft_amplitude_ratio",
    "fractal_dim": "fractal_dim", "lz_ratio": "lz_complexity", "wavelet_dom_scale": "wavelet_dominant_scale", "wavelet_codon": "wavelet_codon_ratio", "mfdfa_alpha": "mfdfa_alpha_mean", "mfdfa_width": "mfdfa_spectrum_width",
    "svd_entropy_ratio": "svd_entropy_ratio", "fisher_centroid": "fisher_centroid_distance", "sheaf_h1": "h1_obstruction", "gf4_entropy": "gf4_entropy", "dinu_rho_dev": "rho_mean_deviation", "kmer_entropy_norm": "kmer_entropy_norm",
    "gc_skew_mean": "gc_skew_mean", "gc_skew_max_abs": "gc_skew_max_abs",
}


def save_summary(table: DataFrame, folder: str) -> DataFrame:
    """The 21 columns of the written summary, as CSV with a header and as JSON lines under `folder`."""
    out = checkpointed(table.select(*(F.col(c).alias(n) for n, c in SUMMARY.items())).orderBy("name"))
    out.write.mode("overwrite").csv(f"{folder}/summary_results_csv", header=True)
    out.write.mode("overwrite").json(f"{folder}/summary_results_json", ignoreNullFields=False)
    return out
