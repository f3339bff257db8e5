"""Figures of one window from its codes, for the fused Arrow pass. They equal the relational forms in
operators/spectra.py and operators/fractal.py, which take sequences of any length apart into rows; a window
is bounded, so here each figure is a few vector operations. None or absent: not computable."""

from __future__ import annotations

import numpy as np

from strandline.functions import kernels as K

COMPOSITION = ("gc_pct", "a_count", "c_count", "g_count", "t_count")


def _slope(x: np.ndarray, y: np.ndarray) -> float | None:
    x = x - x.mean()
    size = x @ x
    return float(x @ (y - y.mean()) / size) if size else None


def _entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p @ np.log2(p)))


def counts(a: np.ndarray, k: int) -> np.ndarray:
    c = K.kmer_codes(a, k)
    return np.bincount(c[c >= 0], minlength=4**k)


def shares(n: np.ndarray) -> np.ndarray:
    total = n.sum()
    return n / total if total else np.full(len(n), 1 / len(n))


def rho_deviation(a: np.ndarray) -> dict:
    """Mean distance from 1 of observed over expected pairs, over pairs whose bases both occur."""
    n = len(a)
    single = np.bincount(a, minlength=5)[:4] / max(n, 1)
    expected = np.outer(single, single).ravel()
    seen = expected > 0
    rho = counts(a, 2)[seen] / max(n - 1, 1) / expected[seen]
    return {"dinu_rho_dev": float(np.abs(rho - 1).mean()) if seen.any() else None}


def composition(a: np.ndarray) -> dict:
    n = np.bincount(a, minlength=5).tolist()
    return dict(zip(COMPOSITION, (100.0 * (n[1] + n[2]) / max(len(a), 1), *map(float, n[:4])), strict=True))


def word_entropy(a: np.ndarray, k: int) -> dict:
    n = counts(a, k)
    if not n.any():
        return {"kmer_entropy_norm": None, "kmer_occupancy": None}
    return {"kmer_entropy_norm": _entropy(n / n.sum()) / (2 * k), "kmer_occupancy": float((n > 0).sum() / 4**k)}


def graph_occupancy(a: np.ndarray, k: int) -> dict:
    n = counts(a, k)
    return {"debruijn_k4_occupancy": float((n > 0).sum() / 4**k) if n.any() else None}


def patch_inconsistency(a: np.ndarray, k: int = 3, patch: int = 3000) -> dict:
    """Mean Hellinger distance of the patches' word shares to those of the whole."""
    n = len(a)
    size = max(200, n // 4) if n < 2 * patch else patch
    tiles = n // size
    if not tiles:
        return {"patch_kmer_inconsistency": None}
    c = K.kmer_codes(a, k)
    at = np.arange(len(c))
    own = (c >= 0) & (at % size <= size - k) & (at < tiles * size)
    local = np.bincount(at[own] // size * 4**k + c[own], minlength=tiles * 4**k).reshape(tiles, -1)
    p = np.stack([shares(x) for x in local])
    d = np.sqrt(((np.sqrt(p) - np.sqrt(shares(np.bincount(c[c >= 0], minlength=4**k)))) ** 2).sum(1) / 2)
    return {"patch_kmer_inconsistency": float(d.mean())}


def to_uniform(a: np.ndarray, k: int = 2) -> dict:
    p = shares(counts(a, k))
    inner = np.sqrt(p / len(p)).sum() / np.sqrt((p.sum() + 1e-15) * (1 + 1e-15))
    return {"fisher_to_uniform": float(2 * np.arccos(min(1.0, max(0.0, inner))))}


def phase3(a: np.ndarray) -> dict:
    if len(a) < 90:
        return dict.fromkeys(("phase3_strength", "phase3_entropy", "phase3_gc_delta"))
    strong = (a == 1) | (a == 2)
    m = np.array([strong[k::3].mean() for k in range(3)])
    return {"phase3_strength": float(m.std()), "phase3_entropy": _entropy(m / (m.sum() + 1e-15)) / float(np.log2(3)), "phase3_gc_delta": float(np.ptp(m))}


def gc_skew(a: np.ndarray, bins: int = 32) -> dict:
    n = len(a)
    names = ("gc_skew_mean", "gc_skew_std", "gc_skew_max_abs")
    if n < 1000:
        return dict.fromkeys(names)
    size = max(100, n // bins)
    grid = a[: n // size * size].reshape(-1, size)
    g, c = (grid == 2).sum(1), (grid == 1).sum(1)
    v = (g - c) / np.maximum(g + c, 1)
    return dict(zip(names, (float(v.mean()), float(v.std()), float(np.abs(v).max())), strict=True))


def mutual_information(a: np.ndarray, lags) -> dict[int, float]:
    """Bits by lag, for lags below the length."""
    n = len(a)
    out = {}
    for lag in lags:
        if n <= lag or n < 4:
            continue
        joint = np.bincount(a[: n - lag].astype(np.int64) * 5 + a[lag:], minlength=25).reshape(5, 5) / (n - lag)
        both = np.outer(joint.sum(1), joint.sum(0))
        seen = joint > 0
        out[lag] = float((joint[seen] * np.log2(joint[seen] / both[seen])).sum())
    return out


def dependency(a: np.ndarray, lags) -> dict:
    mi = mutual_information(a, lags)
    out: dict = {f"mi_lag{lag}": mi.get(lag) for lag in lags}
    x, y = np.array(sorted(mi), float), np.array([mi[k] for k in sorted(mi)])
    mean = lambda keep: float(np.mean([v for k, v in mi.items() if keep(k)])) if any(map(keep, mi)) else None
    out["mi_decay_slope"] = _slope(np.log(x), np.log(y + 1e-12)) if len(x) >= 3 else None
    out["mi_decay_auc"] = float(np.trapezoid(y, np.log1p(x))) if len(x) >= 3 else None
    even = mean(lambda k: k in (2, 4, 6))
    out["mi_period3_excess"] = mi[3] - even if 3 in mi and even is not None else None
    out["mi_short_range_mean"], out["mi_long_range_mean"] = mean(lambda k: k <= 12), mean(lambda k: k >= 100)
    return out


def box_dimension(a: np.ndarray) -> dict:
    """Boxes of the walk at sizes 2^3 and up; cells of a size are those of the size below, halved."""
    n, out = len(a), {"chaos_walk_box_dim_proxy": None}
    last = max(4, int(np.log2(n)) - 2) if n else 0
    if n < 500 or last - 3 < 3:
        return out
    x, y = (np.cumsum(step[a]) for step in (np.array([1, -1, 1, -1, -1]), np.array([-1, 1, 1, -1, 0])))
    cells = np.unique((x - x.min() >> 3) << 32 | (y - y.min() >> 3))
    sizes, boxes = [], []
    for e in range(3, last):
        if len(cells) > 1:
            sizes.append(e)
            boxes.append(len(cells))
        cells = np.unique((cells >> 33) << 32 | (cells & 0xFFFFFFFF) >> 1)
    if len(sizes) >= 3:
        out["chaos_walk_box_dim_proxy"] = _slope(-np.array(sizes) * np.log(2.0), np.log(boxes))
    return out


#: Relational groups of the feature table: names of their columns, and figures of a window's codes.
def groups(cfg) -> dict:
    lags = cfg.dependency_lags
    return {
        "basic": (("dinu_rho_dev",), rho_deviation),
        "complexity": (("chaos_walk_box_dim_proxy",), box_dimension),
        "kmer": (
            ("kmer_entropy_norm", "kmer_occupancy", "patch_kmer_inconsistency", "fisher_to_uniform"),
            lambda a: {**word_entropy(a, cfg.jaccard_k), **patch_inconsistency(a), **to_uniform(a)},
        ),
        "graph": (("debruijn_k4_occupancy",), lambda a: graph_occupancy(a, cfg.graph_k)),
        "fft": (("phase3_strength", "phase3_entropy", "phase3_gc_delta"), phase3),
        "skew": (("gc_skew_mean", "gc_skew_std", "gc_skew_max_abs"), gc_skew),
        "dependency": ((*(f"mi_lag{k}" for k in lags), "mi_decay_slope", "mi_decay_auc", "mi_period3_excess", "mi_short_range_mean", "mi_long_range_mean"), lambda a: dependency(a, lags)),
    }
