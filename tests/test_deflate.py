"""Lengths figured in place of zlib's level 9, against zlib."""

import random
import zlib

import pytest

from strandline.functions import deflate, kernels


def strings(seed):
    rng = random.Random(seed)
    for n in (1, 2, 3, 4, 5, 10, 257, 258, 259, 1000, 16_382, 16_383, 16_384, 32_506, 32_507, 32_768, 65_274, 65_536, 66_000, 131_100):
        n += rng.choice((0, 0, 1, 2, rng.randrange(3000)))
        weights = rng.choice(((1, 1, 1, 1), (5, 2, 1, 8), (1, 0, 0, 20), (30, 1, 2, 50), (1, 1, 0, 0)))
        s = "".join(rng.choices("ACGT", weights, k=n))
        yield s
        for _ in range(rng.randrange(1, 30)):  # copies, near and far
            size, at, to = rng.randrange(3, 3000), rng.randrange(n), rng.randrange(n)
            s = s[:to] + s[at : at + size] + s[to:]
        yield s
        unit = s[: rng.randrange(1, 400)]
        yield (unit * (n // len(unit) + 1))[:n]
        yield s + "A" * rng.randrange(1, 9000) + s[:5000]


@pytest.mark.parametrize("seed", range(3))
def test_lengths_equal_those_of_zlib(seed):
    own = 0
    for s in strings(seed):
        raw = s.encode()
        got = deflate._length(raw)
        own += got is not None
        assert got in (None, len(zlib.compress(raw, 9))), (seed, len(raw))
        assert deflate.compressed_length(raw) == len(zlib.compress(raw, 9))
    assert own > 60


def test_deep_trees():
    rng = random.Random(1)
    for longest, fixed in ((15, 286), (7, 19)):
        fib = [1, 1]
        while len(fib) < 19:
            fib.append(fib[-1] + fib[-2])
        rng.shuffle(fib)
        count = fib + [0] * (fixed - 19)
        lens, bits = deflate._huffman(count, longest, [0] * fixed)
        assert max(lens) == longest and sum(2.0**-k for k in lens if k) == 1 and bits == sum(c * k for c, k in zip(count, lens, strict=False))


def test_other_symbols_and_other_libraries_go_to_zlib(monkeypatch):
    s = "".join(random.Random(4).choices("ACGTN", k=20_000))
    assert kernels.zlib_ratio(s) == len(zlib.compress(s.encode(), 9)) / len(s)
    monkeypatch.setattr(deflate, "_known", lambda: False)
    monkeypatch.setattr(deflate, "_length", lambda raw: 1)
    s = s.replace("N", "A")
    assert kernels.zlib_ratio(s) == len(zlib.compress(s.encode(), 9)) / len(s)


def test_long_strings_do_without_chains(monkeypatch):
    s = "".join(random.Random(6).choices("ACGT", (5, 2, 1, 8), k=200_000))
    want = len(zlib.compress(s.encode(), 9)) / len(s)
    assert deflate._known()

    def refuse(*_):
        raise AssertionError("zlib was called")

    monkeypatch.setattr(zlib, "compress", refuse)
    assert kernels.zlib_ratio(s) == want
