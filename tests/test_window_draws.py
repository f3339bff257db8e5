"""Controls of the parity mode against the standard generator, a call a symbol; and how windows are dealt."""

import random
from bisect import bisect
from collections import Counter
from itertools import accumulate

import pytest

from strandline.operators import windows
from strandline.plans import catalog

from .conftest import SF


def chain(s, order, rng):
    """The Markov surrogate in plain steps."""
    if order == 0 or len(s) <= order:
        sums = list(accumulate(s.count(b) / len(s) for b in "ACGT"))
        return "".join("ACGT"[min(3, bisect(sums, rng.random() * sums[3]))] for _ in s) if sums[3] else ""
    after = Counter((s[i : i + order], s[i + order]) for i in range(len(s) - order))
    words = Counter(s[i : i + order] for i in range(len(s) - order))
    found = list(words)
    times = [words[w] + 1 + (k == 0) for k, w in enumerate(found)]
    sums = list(accumulate(times))
    out = found[min(bisect(sums, rng.random() * sums[-1]), len(sums) - 1)]
    for _ in range(len(s) - order):
        sums = list(accumulate(1 + after[out[len(out) - order :], b] for b in "ACGT"))
        out += "ACGT"[bisect(sums, rng.random() * sums[3], 0, 3)]
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 63, 64, 65, 1000, 5000])
def test_controls_take_the_generator_as_single_calls_do(n):
    rng = random.Random(n)
    for s in ("".join(rng.choices("ACGT", (5, 2, 1, 8), k=n)), "".join(rng.choices("ACGTNR", k=n)), "A" * n, "N" * n):
        one, two = random.Random(n + 7), random.Random(n + 7)
        want = list(s)
        one.shuffle(want)
        assert windows.control(s, "shuffle", two) == "".join(want) and one.getstate() == two.getstate()
        for order in range(4):
            assert windows.control(s, f"markov{order}", two) == chain(s, order, one), (order, s)
            assert one.random() == two.random()
        parts = [s[k : k + 7] for k in range(0, n, 7)]
        if n > 7:
            one.shuffle(parts)
        assert windows.control(s, "block_shuffle", two, 7) == "".join(parts) and one.getstate() == two.getstate()


def test_draws_come_many_at_once():
    class Counted(random.Random):
        calls = 0

        def getrandbits(self, k):
            Counted.calls += 1
            return super().getrandbits(k)

        def random(self):
            Counted.calls += 1
            return super().random()

    s = "".join(random.Random(3).choices("ACGT", k=20_000))
    for kind in ("shuffle", "markov0", "markov1", "markov3"):
        windows.control(s, kind, Counted(5))
    assert Counted.calls < 200


def test_windows_are_dealt_to_many_tasks(spark):
    wins = catalog._windows(spark, SF)
    assert wins.rdd.getNumPartitions() == windows.TASKS * spark.sparkContext.defaultParallelism
