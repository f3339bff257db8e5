"""The discrete Fourier transform of a record of any length, over tasks.

A record of n symbols has n frequencies, whatever the factors of n, so its transform is a convolution with a chirp
of a power of two m >= 2n - 1 places, and that is done in four steps: m places are a matrix of m1 rows and m2
columns, place j in row j // m2. Blocks of columns are transformed along their rows and turned by twiddle
factors; blocks of rows along their columns, where they meet the chirp's own transform, go back the same way,
and blocks of columns end it. Between the steps the matrix is transposed by a shuffle. The first moves
symbols, the other two complex numbers; a block has about `BLOCK` of them, so no task holds a record.

A record of up to `WHOLE` symbols is transformed in its own row, and nothing of it moves but its figures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.symbols import codes
from strandline.operators import tiles as T
from strandline.sources.shared import saved

CHUNK, BLOCK = 1 << 16, 1 << 18
WHOLE = 1 << 20  # 16 MB of complex numbers, and a few times that while they are transformed
SIGNAL = np.array([1, 1j, -1, -1j, 0])
_TABLE = np.full(256, 4, np.uint8)
_TABLE[list(b"0123")] = range(4)


def shape(n: int) -> tuple[int, int, int, int]:
    """Rows and columns of the matrix of a record, and how many columns and rows a block has."""
    bits = max(2, int(2 * n - 2).bit_length())
    m1, m2 = 1 << (bits + 1) // 2, 1 << bits // 2
    return m1, m2, max(1, min(m2, BLOCK // m1)), max(1, min(m1, BLOCK // m2))


def _chirp(j: np.ndarray, n: int) -> np.ndarray:
    """exp(-pi i j^2 / n), by whole numbers modulo 2n."""
    return np.exp((-1j * np.pi / n) * (j.astype(np.int64) ** 2 % (2 * n)))


def _dealt(batches):
    """Chunks (name, n, base, chunk) to the blocks of columns that their places lie in."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            symbols = np.frombuffer(r.chunk.encode(), np.uint8)
            _, m2, wide, _ = shape(r.n)
            block = (r.base + np.arange(len(symbols))) % m2 // wide
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                rows.append((r.name, r.n, int(block[order[a]]), r.base + order[a:b].astype(np.int64).min(), (r.base + order[a:b]).astype(np.int64).tobytes(), symbols[order[a:b]].tobytes()))
        yield pd.DataFrame(rows, columns=["name", "n", "g", "first", "places", "symbols"])


def _columns(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step one: a block of columns of the signal and of the chirp, along their rows; dealt to blocks of rows."""
    n, g = int(pdf.n.iloc[0]), int(pdf.g.iloc[0])
    m1, m2, wide, high = shape(n)
    m = m1 * m2
    j = np.arange(m1)[:, None] * m2 + g * wide + np.arange(wide)
    x = np.zeros((m1, wide), complex)
    for places, symbols in zip(pdf.places, pdf.symbols, strict=True):
        if symbols is not None:
            at = np.frombuffer(places, np.int64)
            x[at // m2, at % m2 - g * wide] = SIGNAL[_TABLE[np.frombuffer(symbols, np.uint8)]] * _chirp(at, n)
    back = np.minimum(j, m - j)  # the filter is even
    filt = np.where(back < n, np.conj(_chirp(np.minimum(back, n), n)), 0)
    turn = np.exp((-2j * np.pi / m) * (np.arange(m1)[:, None] * (g * wide + np.arange(wide)) % m))
    x, filt = np.fft.fft(x, axis=0) * turn, np.fft.fft(filt, axis=0) * turn
    return pd.DataFrame([(pdf.name.iloc[0], n, h, g, x[h * high : (h + 1) * high].tobytes(), filt[h * high : (h + 1) * high].tobytes()) for h in range(m1 // high)], columns=["name", "n", "h", "g", "x", "f"])


def _rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Steps two and three: a block of rows along its columns, times the chirp's transform, and back."""
    n, h = int(pdf.n.iloc[0]), int(pdf.h.iloc[0])
    m1, m2, wide, high = shape(n)
    m = m1 * m2
    x, f = np.empty((high, m2), complex), np.empty((high, m2), complex)
    for g, a, b in zip(pdf.g, pdf.x, pdf.f, strict=True):
        x[:, g * wide : (g + 1) * wide] = np.frombuffer(a, complex).reshape(high, wide)
        f[:, g * wide : (g + 1) * wide] = np.frombuffer(b, complex).reshape(high, wide)
    y = np.fft.ifft(np.fft.fft(x, axis=1) * np.fft.fft(f, axis=1), axis=1)
    y *= np.exp((2j * np.pi / m) * ((h * high + np.arange(high))[:, None] * np.arange(m2) % m))
    return pd.DataFrame([(pdf.name.iloc[0], n, g, h, y[:, g * wide : (g + 1) * wide].tobytes()) for g in range(m2 // wide)], columns=["name", "n", "g", "h", "y"])


def _powers(pdf: pd.DataFrame) -> tuple[str, int, np.ndarray, np.ndarray]:
    """Step four: name, n, frequencies below n of a block of columns, and their powers."""
    n, g = int(pdf.n.iloc[0]), int(pdf.g.iloc[0])
    m1, m2, wide, high = shape(n)
    y = np.empty((m1, wide), complex)
    for h, part in zip(pdf.h, pdf.y, strict=True):
        y[h * high : (h + 1) * high] = np.frombuffer(part, complex).reshape(high, wide)
    y = np.fft.ifft(y, axis=0)
    k = np.arange(m1)[:, None] * m2 + g * wide + np.arange(wide)
    ok = (k < n) & (k > 0)  # without the mean
    return pdf.name.iloc[0], n, k[ok], np.abs(y[ok]) ** 2


def _digits(df: DataFrame) -> DataFrame:
    """name, sequence, n: records of two symbols or more; others than A, C, G, T go."""
    return df.select("name", codes(F.col("sequence")).alias("sequence")).withColumn("n", F.length("sequence").cast("long")).where("n >= 2")


def transformed(digits: DataFrame) -> DataFrame:
    """name, n, g, h, y: what `_powers` takes by (name, g)."""
    chunks = T.chunks(digits, 0, keep=("name", "n"), size=CHUNK).select("name", "n", F.col("base").cast("long").alias("base"), "chunk")
    dealt = chunks.mapInPandas(_dealt, "name string, n long, g long, first long, places binary, symbols binary")
    # Blocks of columns that no symbol falls into still have the chirp.
    one = digits.select("name", "n").mapInPandas(_every_block, "name string, n long, g long, first long, places binary, symbols binary")
    first = dealt.unionByName(one).groupBy("name", "n", "g").applyInPandas(_columns, "name string, n long, h long, g long, x binary, f binary")
    return first.groupBy("name", "n", "h").applyInPandas(_rows, "name string, n long, g long, h long, y binary")


def _every_block(batches):
    for pdf in batches:
        rows = [(r.name, r.n, g, None, None, None) for r in pdf.itertuples(index=False) for g in range(shape(r.n)[1] // shape(r.n)[2])]
        yield pd.DataFrame(rows, columns=["name", "n", "g", "first", "places", "symbols"])


def blocks(df: DataFrame, schema: str, work) -> DataFrame:
    """What `work(name, n, k, power)` makes of frequencies k, 0 < k < n, and their powers: of all of a record of up to
    `WHOLE` symbols, else of a block of columns at a time."""
    digits = saved(_digits(df))

    def own(batches):
        for pdf in batches:
            for name, s, n in zip(pdf.name, pdf.sequence, pdf.n, strict=True):
                p = np.abs(np.fft.fft(SIGNAL[_TABLE[np.frombuffer(s.encode(), np.uint8)]])[1:]) ** 2
                yield work(name, n, np.arange(1, n), p)

    short = digits.where(F.col("n") <= WHOLE).select("name", "sequence", "n").mapInPandas(own, schema)
    long = transformed(digits.where(F.col("n") > WHOLE)).groupBy("name", "n", "g").applyInPandas(lambda pdf: work(*_powers(pdf)), schema)
    return short.unionByName(long)


def powers(df: DataFrame) -> DataFrame:
    """name, n, k, power of every frequency k / n, 0 < k < n: a row a frequency."""
    return blocks(df, "name string, n long, k long, power double", lambda name, n, k, p: pd.DataFrame({"name": name, "n": n, "k": k, "power": p}))


def record_power(df: DataFrame) -> DataFrame:
    """name, n, total (all power over n^2), first and third (power over n at the frequencies 1 / n and about 1 / 3)."""

    def work(name, n, k, p):
        return pd.DataFrame([(name, n, p.sum() / float(n) ** 2, p[k == 1].sum() / n, p[k == n // 3].sum() / n)], columns=["name", "n", "total", "first", "third"])

    rows = blocks(df, "name string, n long, total double, first double, third double", work)
    return rows.groupBy("name", "n").agg(*(F.sum(c).alias(c) for c in ("total", "first", "third")))


def record_spectrum(df: DataFrame, band: float = 0.015) -> DataFrame:
    """name, n and the figures of the frequencies below a half: the peak (of equal ones the lowest), its ratio to the
    mean, the share of the band around 1/3, its mean against mean and deviation of the others; and the dominant
    frequency of all. A block gives one row of sums. NULL below 32 symbols."""
    df = saved(df.select("name", "sequence"))  # records are made once

    def work(name, n, k, p):
        low = k < n // 2
        inside = low & (np.abs(k / n - 1 / 3) < band)
        out = low & ~inside
        row = {"name": name, "n": n, "total": p[low].sum(), "band": p[inside].sum(), "in_band": inside.sum(), "others": p[out].sum(), "squares": (p[out] ** 2).sum(), "low": low.sum()}
        for which, use in (("top", low), ("all", np.ones(len(k), bool))):
            best = p[use].max(initial=-1.0)
            row[which], row[f"{which}_k"] = best, np.where(use & (p >= best * (1 - 1e-9)), np.minimum(k, n - k) if which == "all" else k, n).min(initial=n)
        return pd.DataFrame([row])

    sums = "name string, n long, total double, band double, in_band long, others double, squares double, low long, top double, top_k long, all double, all_k long"
    rows = blocks(df, sums, work)
    rows = rows.groupBy("name", "n").agg(*(F.sum(c).alias(c) for c in ("total", "band", "in_band", "others", "squares")), *(F.max(c).alias(c) for c in ("top", "all")), F.collect_list(F.struct("top", "top_k", F.col("all"), "all_k")).alias("peaks"))
    lowest = lambda p: F.array_min(F.transform(F.filter("peaks", lambda x: x[p] >= F.col(p) * (1 - 1e-9)), lambda x: x[f"{p}_k"]))
    half = F.floor(F.col("n") / 2)
    mean = F.col("others") / (half - F.col("in_band"))
    # The frequency 0 counts among the others, with power 0.
    sd = F.sqrt(F.greatest(F.col("squares") / (half - F.col("in_band")) - mean * mean, F.lit(0.0)))
    enough = F.col("n") >= 32
    z = F.when(enough & (F.col("in_band") > 0) & (half - F.col("in_band") > 2), (F.col("band") / F.nullif("in_band", F.lit(0)) - mean) / (sd + 1e-15))
    got = rows.select(
        "name", "n", F.when(enough, lowest("top") / F.col("n")).alias("fft_peak_freq"), F.when(enough, F.col("top") * half / (F.col("total") + half * 1e-15)).alias("fft_peak_ratio"),
        F.when(enough, F.col("band") / (F.col("total") + 1e-15)).alias("fft_codon_band"), z.alias("fft_codon_z"), F.round(lowest("all") / F.col("n"), 4).alias("dominant_freq"),
    )
    return df.select("name").join(got, "name", "left")
