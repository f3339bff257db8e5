"""Walks, boxes and segments from chunks, against plain loops, across chunk ends and on very long records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import fractal


def purine(s):
    return np.cumsum([1 if b in "AG" else -1 for b in s])


def keto(s):
    return np.cumsum([1 if b in "CG" else -1 for b in s])


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(fractal, "CHUNK", 100)


def records(seed=3):
    rng = np.random.default_rng(seed)
    out = {f"r{n}": "".join(rng.choice(list("ACGT"), n)) for n in (1, 15, 16, 99, 100, 101, 200, 1733)}
    return out | {"aaa": "A" * 1000, "mix": "AAAAACAGTC" * 60 + "G" * 430 + "T" * 310, "": ""}


def frame(spark, recs):
    return spark.createDataFrame(list(recs.items()), "name string, sequence string")


def test_walk_across_chunks(spark, small_chunks):
    recs = records()
    got = {}
    for r in fractal.walk(frame(spark, recs), {"x": fractal.PURINE, "y": fractal.KETO}).collect():
        got.setdefault(r.name, {})[r.pos] = (r.x, r.y)
    assert set(got) == {n for n, s in recs.items() if s}
    for name, at in got.items():
        s = recs[name]
        assert [at[k] for k in range(len(s))] == list(zip(purine(s).tolist(), keto(s).tolist(), strict=True))
    low = {(r.name, r.x_low, r.y_low) for r in fractal.walk_chunks(frame(spark, recs), {"x": fractal.PURINE, "y": fractal.KETO}).collect()}
    assert low == {(n, purine(s).min(), keto(s).min()) for n, s in recs.items() if s}


def variance(y):
    """By exact fractions."""
    from fractions import Fraction as Q

    n = len(y)
    t = range(n)
    mt, my = Q(n - 1, 2), Q(sum(y), n)
    stt = sum((k - mt) ** 2 for k in t)
    sty = sum((k - mt) * (int(v) - my) for k, v in zip(t, y, strict=True))
    return float((sum((int(v) - my) ** 2 for v in y) - (sty * sty / stt if stt else 0)) / n)


def test_variances_across_chunks(spark, small_chunks):
    recs, scales = records(), [1, 2, 16, 33, 100, 150, 430]
    df = frame(spark, recs).withColumn("scales", F.array(*map(F.lit, scales)))
    got = {(r.name, r.scale, r.seg): r["var"] for r in fractal.segment_variances(df, "scales").collect()}
    want = {}
    for name, s in recs.items():
        x = purine(s)
        for c in scales:
            for seg in range(len(s) // c):
                want[name, c, seg] = variance(x[seg * c : (seg + 1) * c].tolist())
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-12) and (got[k] == 0) == (v == 0), k
    # Rows of a walk give the same.
    walk = fractal.walk(df.withColumn("len", F.length("sequence").cast("long")), {"x": fractal.PURINE}, ("name", "len", "scales"))
    rows = {(r.name, r.scale, r.seg): r["var"] for r in fractal.fluctuation(walk, F.col("scales")).collect()}
    assert rows.keys() == want.keys() and all(rows[k] == pytest.approx(v, rel=1e-9, abs=1e-12) for k, v in want.items())


def slope(boxes):
    x = np.log([1 / 2.0**e for e, _ in boxes])
    return np.polyfit(x, np.log([n for _, n in boxes]), 1)[0]


def test_boxes_across_chunks(spark, small_chunks):
    recs = {n: s for n, s in records().items() if n in ("r1733", "r101", "aaa", "mix")}
    got = {r.name: r.chaos_walk_box_dim_proxy for r in fractal.box_dimension(frame(spark, recs)).collect()}
    whole = {r.name: r.fractal_dim for r in fractal.walk_dimension(frame(spark, recs), whole=True).collect()}
    assert got["r101"] is None and whole["r101"] is None
    for name in ("r1733", "aaa", "mix"):
        s = recs[name]
        x, y = purine(s), keto(s)
        top = int(np.log2(len(s))) - 2
        boxes = [(e, len(set(zip((x - x.min()) // 2**e, (y - y.min()) // 2**e, strict=True)))) for e in range(3, max(4, top))]
        boxes = [b for b in boxes if b[1] >= 2]
        assert got[name] == (pytest.approx(slope(boxes), abs=1e-9) if len(boxes) >= 3 else None)
        w = np.cumsum([1 if b in "AT" else -1 for b in s])
        boxes = [(e, len(set(zip(np.trunc(x / 2**e), np.trunc(w / 2**e), strict=True)))) for e in range(3, top)]
        assert whole[name] == (pytest.approx(slope(boxes), abs=6e-5) if len(boxes) > 1 else None)


def test_a_record_of_five_million_symbols(spark):
    rng = np.random.default_rng(9)
    head = np.frombuffer(b"ACGT", np.uint8)[rng.integers(0, 4, 3_800_000)].tobytes().decode()
    s = head + "A" * 1_200_000  # the last segments climb straight
    df = spark.createDataFrame([("long", s)], "name string, sequence string").withColumn("scales", fractal.scales_of(F.length("sequence")))
    scales = fractal.log_scales(len(s))
    assert 600_000 < scales[-1] <= len(s) // 8
    v = fractal.segment_variances(df, "scales")
    rows = {(r.scale, r.seg): r["var"] for r in v.where(F.col("scale") >= scales[-3]).collect()}
    assert len(rows) == sum(len(s) // c for c in scales[-3:])
    x = np.cumsum(np.where(np.isin(np.frombuffer(s.encode(), np.uint8), list(b"AG")), 1, -1))
    for (c, seg), got in rows.items():
        y = (x[seg * c : (seg + 1) * c] - x[seg * c]).astype(np.longdouble)
        t = np.arange(c, dtype=np.longdouble) - np.longdouble(c - 1) / 2
        y -= y.mean()
        assert got == pytest.approx(float((y * y).mean() - (y * t).mean() ** 2 / (t * t).mean()), rel=1e-7, abs=1e-6)
        assert (got == 0) == (seg * c >= 3_800_000)
    h = {r.q: r.h for r in fractal.generalised_hurst(v, [0.0, 2.0], 1e-12).collect()}
    assert all(np.isfinite(x) for x in h.values())
    # The same segments from rows of a walk, where the sums alone pass 64 bits.
    walk = fractal.walk(spark.createDataFrame([("a", "A" * 400_000, 400_000)], "name string, sequence string, len long"), {"x": fractal.PURINE}, ("name", "len"))
    assert [r["var"] for r in fractal.fluctuation(walk, F.array(F.lit(200_000))).collect()] == [0.0, 0.0]
