"""What a run is asked to do."""

from __future__ import annotations

from dataclasses import dataclass

GROUPS = ("basic", "complexity", "kmer", "graph", "fft", "skew", "svd", "mfdfa", "dependency", "resonance", "grammar")
FAST = ("basic", "complexity", "kmer", "graph", "fft", "skew")


@dataclass(frozen=True)
class Config:
    seed: int = 42
    window: int = 200_000
    windows_per_genome: int = 8
    min_window: int = 1_000
    jaccard_k: int = 7
    graph_k: int = 4
    controls: tuple[str, ...] = ("shuffle", "markov1", "revcomp")
    features: tuple[str, ...] = GROUPS
    permutations: int = 999
    block_size: int = 500
    dependency_lags: tuple[int, ...] = (1, 2, 3, 6, 9, 12, 30, 100, 300, 1000, 3000, 10000)
    resonance_max_period: int = 2048
    grammar_sketch_dim: int = 512
    grammar_levels: int = 4
    shared_rng: bool = False

    def enabled(self, group: str) -> bool:
        return group in self.features or "all" in self.features
