"""Singular-value entropies and wavelet powers from chunks, against the kernels of whole strings."""

import numpy as np
import pytest

from strandline.functions import kernels as K
from strandline.operators import gram, wavelets


@pytest.fixture(scope="module")
def records():
    rng = np.random.default_rng(7)
    out = {f"r{n}": "".join(rng.choice(list("ACGT"), n, p=[0.4, 0.3, 0.2, 0.1])) for n in (1, 300, 511, 512, 513, 700, 6000, 40_000, 300_000)}
    return out | {"rep": "ACG" * 3000, "odd": "ACGTN" * 900, "none": ""}


@pytest.fixture(scope="module")
def df(spark, records):
    return spark.createDataFrame(list(records.items()), "name string, sequence string")


def test_row_entropy(df, records):
    for r in gram.row_entropy(df).collect():
        want = K.svd_entropy(records[r.name])
        assert r.svd_entropy_ratio == (None if want is None else pytest.approx(want, abs=1e-6)), r.name
        if want is not None:
            a = K.encode(records[r.name])
            x = a[: len(a) // 64 * 64].reshape(-1, 64).astype(float)
            e = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
            assert r.trace == pytest.approx(e.sum()) and r.squares == pytest.approx((e * e).sum())


def test_trajectory_entropy(df, records):
    for arguments in ({}, {"window": 256, "step": 128, "most": 8000, "ratio": False}):
        for r in gram.trajectory_entropy(df, **arguments).collect():
            want = K.hankel_entropy(records[r.name], **arguments)
            assert r.hankel_entropy == (None if want is None else pytest.approx(want, abs=1.1e-4 if arguments else 1.1e-5)), r.name
    small = df.where("length(sequence) <= 700")
    for r in gram.trajectory_entropy(small, whole=True).collect():
        want = K.hankel_entropy(records[r.name], most=10**6)
        assert r.hankel_entropy == (None if want is None else pytest.approx(want, abs=1.1e-5))


def test_wavelet_powers_across_chunks(df, records):
    sizes = wavelets.widths(3, 128, 50)
    got = {}
    for r in wavelets.powers(df, wavelets.PURINE, sizes).collect():
        got.setdefault(r.name, {})[r.width] = r.power
    assert set(got) == {n for n, s in records.items() if s}
    for name, p in got.items():
        x = K.PURINE[K.encode(records[name], drop=False)]
        want = K.morlet_power(x - x.mean(), np.array(sizes))
        assert np.allclose([p[s] for s in sizes], want, rtol=1e-9, atol=1e-9 * len(x)), name


def test_dominant_widths(df, records):
    old = {r.name: r.fixed_scale_bp for r in wavelets.dominant_old(df).collect()}
    for r in wavelets.dominant(df).collect():
        want = K.wavelet(records[r.name])
        assert old[r.name] == K.wavelet_old(records[r.name]) or len(records[r.name]) < 2
        assert all(getattr(r, c) == (None if v is None else pytest.approx(v, abs=1.1e-3)) for c, v in want.items()), r.name
