"""Controls by keyed draws against plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strandline.operators import windows

M = 0xFFFFFFFF


def mix(h):
    h ^= h >> 16
    h = h * 0x85EBCA6B & M
    h ^= h >> 13
    h = h * 0xC2B2AE35 & M
    return h ^ h >> 16


def draw(place, *parts):
    return mix(mix(place) + int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) & M)


def pick(weights, r):
    at, total = r * sum(weights) >> 32, 0
    for k, w in enumerate(weights):
        total += w
        if at < total:
            return k


def markov(s, order, *parts):
    s = "".join(c for c in s if c in "ACGT")
    r = [draw(p, *parts, f"markov{order}") for p in range(len(s))]
    if order == 0 or len(s) <= order:
        return "".join("ACGT"[pick([s.count(b) for b in "ACGT"], x)] for x in r)
    words = Counter(s[i : i + order] for i in range(len(s) - order + 1))
    after = Counter((s[i : i + order], s[i + order]) for i in range(len(s) - order))
    known = sorted(words)
    out = known[pick([words[w] + 1 for w in known], r[0])]
    for p in range(order, len(s)):
        out += "ACGT"[pick([1 + after[out[-order:], b] for b in "ACGT"], r[p])]
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 17, 100, 1003])
def test_every_symbol(n):
    rng = random.Random(n)
    for s in ("".join(rng.choices("ACGT", (5, 2, 2, 1), k=n)), "".join(rng.choices("ACGTN", k=n)), "A" * n):
        key = (42, "some name", 3)
        r = [draw(p, *key, "shuffle") for p in range(n)]
        assert windows.counter_control(s, "shuffle", 7, *key) == "".join(s[p] for p in sorted(range(n), key=lambda p: (r[p], p)))
        blocks = [s[k : k + 7] for k in range(0, n, 7)]
        r = [draw(p, *key, "block_shuffle") for p in range(len(blocks))]
        assert windows.counter_control(s, "block_shuffle", 7, *key) == (s if n <= 7 else "".join(blocks[b] for b in sorted(range(len(blocks)), key=lambda b: (r[b], b))))
        for order in range(4):
            assert windows.counter_control(s, f"markov{order}", 7, *key) == markov(s, order, *key), (order, s)


def test_draws_are_spread():
    a, b = (windows.draws(np.arange(200_000), 42, name, 0, "markov1") for name in ("x", "y"))
    for d in (a, b):
        assert abs(d.astype(float).mean() / 2**32 - 0.5) < 0.005
        assert np.bincount(d >> 28, minlength=16).min() > 12_000 * 0.95
        assert abs(np.corrcoef(d[1:].astype(float), d[:-1].astype(float))[0, 1]) < 0.01
    assert abs(np.corrcoef(a.astype(float), b.astype(float))[0, 1]) < 0.01


def test_a_surrogate_keeps_the_words(spark):
    rng = random.Random(2)
    s = "".join(rng.choices(["ACG", "TTA", "GGC", "A"], k=20_000))
    got = windows.counter_control(s, "markov2", 500, 1, "w", 0)
    assert len(got) == len(s)
    own, drawn = (Counter(x[i : i + 3] for i in range(len(x) - 2)) for x in (s, got))
    assert all(abs(own[w] - drawn[w]) < 0.1 * max(own[w], 500) for w in own | drawn)


def test_a_control_does_not_depend_on_the_others(spark):
    df = spark.createDataFrame([("o", "a", "t", "observed", 0, 0, 40, "ACGTTGCA" * 5), ("o", "a", "t", "observed", 1, 9, 9, "")], windows.WINDOW)
    one = {(r.replicate, r.source): r.sequence for r in windows.with_controls(df, ("markov1",), counter=True).collect()}
    many = {(r.replicate, r.source): r.sequence for r in windows.with_controls(df, ("shuffle", "markov3", "markov1", "revcomp"), counter=True).collect()}
    assert len(many) == 10 and all(many[k] == v for k, v in one.items()) and many[1, "shuffle"] == ""


def test_controls_leave_in_slices():
    from collections import namedtuple

    row = namedtuple("row", "source sequence")
    taken = []

    def rows():
        for k in range(100):
            taken.append(k)
            yield row(str(k), "A" * 1000)

    frames = []
    for f in windows.sliced(rows(), ["source", "sequence"], 5000):
        assert len(f) == 5 and len(taken) <= 5 * (len(frames) + 1)  # no row is made before it is needed
        frames.append(f)
    assert [s for f in frames for s in f.source] == [str(k) for k in range(100)]
    assert list(windows.sliced(iter(()), ["source", "sequence"])) == []
