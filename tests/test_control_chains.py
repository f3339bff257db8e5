"""Windows that draw side by side against each by itself."""

import random
from collections import namedtuple

from strandline.operators import windows

Row = namedtuple("Row", "organism replicate sequence")
KINDS = ["markov1", "markov2", "markov3"]


def test_chains_side_by_side_equal_each_alone(monkeypatch):
    monkeypatch.setattr(windows, "TOGETHER", 1000)  # several parts of one length
    rng = random.Random(5)
    rows = [Row(f"o{i % 7}", i, "".join(rng.choices("ACGTN" if i % 5 == 0 else "ACGT", k=rng.choice([0, 1, 3, 4, 50, 200])))) for i in range(200)]
    got = windows.counter_chains(rows, ["shuffle", *KINDS], 42)
    assert got == {(i, k): windows.counter_control(rows[i].sequence, k, 500, 42, rows[i].organism, rows[i].replicate) for i, k in got}
    assert {k for _, k in got} == set(KINDS) and len(got) > 300


def test_few_long_windows_stay_alone():
    assert windows.counter_chains([Row("a", k, "ACGT" * 100) for k in range(3)], KINDS, 42) == {}


def test_controls_of_many_windows(spark):
    rng = random.Random(6)
    rows = [("a", "x", "t", "observed", i, 0, 60, "".join(rng.choices("ACGT", k=60 + i % 2))) for i in range(60)]
    got = windows.with_controls(spark.createDataFrame(rows, windows.WINDOW), ["shuffle", *KINDS], counter=True).collect()
    assert len(got) == 5 * len(rows)
    for r in got:
        seq = rows[r.replicate][7]
        assert r.sequence == (seq if r.source == "observed" else windows.counter_control(seq, r.source, 500, 42, "a", r.replicate))
