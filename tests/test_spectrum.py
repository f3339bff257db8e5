"""The transform over tasks against NumPy's, on lengths of any factors and records of several blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import kernels as K
from strandline.operators import spectrum


def records(lengths):
    rng = np.random.default_rng(12)
    return {f"r{n}": "".join(rng.choice(list("ACGT"), n)) for n in lengths}


def frame(spark, recs):
    return spark.createDataFrame(list(recs.items()), "name string, sequence string")


def test_powers_of_any_length(spark):
    recs = records([2, 3, 4, 31, 64, 97, 1000, 4096, 6007]) | {"odd": "ACGTNNA-C", "one": "A", "none": ""}
    got = {}
    for r in spectrum.powers(frame(spark, recs)).collect():
        assert r.n == len(K.encode(recs[r.name]))
        got.setdefault(r.name, {})[r.k] = r.power
    assert set(got) == set(recs) - {"one", "none"}
    for name, p in got.items():
        x = K.COMPLEX[K.encode(recs[name])]
        want = np.abs(np.fft.fft(x)) ** 2
        assert sorted(p) == list(range(1, len(x)))
        assert np.allclose([p[k] for k in range(1, len(x))], want[1:], atol=1e-9 * len(x) ** 2)


def test_figures(spark):
    recs = records([31, 32, 50, 999, 4096, 5000]) | {"codon": "ACG" * 700, "flat": "A" * 300}
    for r in spectrum.record_spectrum(frame(spark, recs)).collect():
        want = K.spectrum(recs[r.name])
        for c in K.FFT:
            if want[c] is None:
                assert r[c] is None
            elif r.name != "flat":  # all powers are rounding there
                assert r[c] == pytest.approx(want[c], rel=1e-6, abs=1e-9), (r.name, c)
    assert spectrum.record_spectrum(frame(spark, recs).limit(0)).count() == 0


def test_a_record_of_several_blocks(spark):
    recs = records([300_007])
    (name, s), = recs.items()
    m1, m2, wide, high = spectrum.shape(len(s))
    assert m2 // wide > 1 and m1 // high > 1  # no task holds it
    x = K.COMPLEX[K.encode(s)]
    want = np.abs(np.fft.fft(x)) ** 2
    p = spectrum.powers(frame(spark, recs)).where((F.col("k") % 1000 == 7) | (F.col("k") < 50))
    for r in p.collect():
        assert r.power == pytest.approx(want[r.k], rel=1e-6, abs=1e-3)
    got = spectrum.record_spectrum(frame(spark, recs)).first()
    for c, v in K.spectrum(s).items():
        assert got[c] == pytest.approx(v, rel=1e-6)


def test_short_records_stay_in_their_rows_and_long_ones_do_not(spark, monkeypatch):
    df = frame(spark, records([5, 31, 97, 1000, 6007]) | {"codon": "ACG" * 700})
    rows = lambda d: {r.name: r.asDict() for r in d.collect()}
    asked = (spectrum.record_power, lambda d: spectrum.record_spectrum(d).fillna(-9))
    whole = [rows(f(df)) for f in asked]
    monkeypatch.setattr(spectrum, "WHOLE", 500)
    for f, one in zip(asked, whole, strict=True):
        two = rows(f(df))
        assert one.keys() == two.keys()
        for name, r in one.items():
            for c, v in r.items():
                assert two[name][c] == (v if isinstance(v, (str, int)) else pytest.approx(v, rel=1e-6, abs=1e-9)), (name, c)


def test_a_record_of_a_row_moves_no_symbols(spark):
    def moved():
        told = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(told.apply(k).totalShuffleWrite() for k in range(told.size()))

    (s,) = records([200_003]).values()
    before = moved()
    assert len(spectrum.record_spectrum(frame(spark, {"a": s})).collect()) == len(spectrum.powers(frame(spark, {"a": s})).where("k = 1").collect()) == 1
    assert moved() - before < len(s)


def test_several_blocks_equal_the_row(spark, monkeypatch):
    df = frame(spark, records([300_007]))
    one = spectrum.record_spectrum(df).first()
    monkeypatch.setattr(spectrum, "WHOLE", 0)
    two = spectrum.record_spectrum(df).first()
    for c in K.FFT:
        assert one[c] == pytest.approx(two[c], rel=1e-6)
