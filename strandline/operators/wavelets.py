"""Morlet powers of records of any length, by overlapping chunks.

A chunk carries a margin on both sides as wide as half the longest wavelet, so that the transform at its own places
is that of the whole record, whose ends are followed by zeros. Chunks give a sum of powers a width, and these add
up: one row a width, chunk's task and record is moved."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import kernels as K
from strandline.functions.symbols import adaptive_length
from strandline.operators import tiles as T

CHUNK = 1 << 15
#: Values of A, C, G, T and of any other symbol.
PURINE, CODE = tuple(K.PURINE.tolist()), tuple(K.CODE.tolist())
PAD = "-"


def widths(low: float, high: float, count: int) -> list[int]:
    return np.unique(np.round(np.logspace(np.log10(low), np.log10(high), count)).astype(int)).tolist()


def _wavelet(s: int, old: bool) -> np.ndarray:
    t = np.arange(-4 * s, 4 * s + 1) / s
    return np.exp(6j * t - t * t / 2) / (np.sqrt(2 * np.pi) * s if old else np.pi**0.25 * np.sqrt(s))


def powers(df: DataFrame, values: tuple[float, ...], sizes: list[int], old: bool = False) -> DataFrame:
    """name, width, power: summed power of the record's values, without their mean, at each width."""
    margin = 4 * max(sizes)
    s = F.col("sequence")
    n = F.length(s)
    known = F.length(F.regexp_replace(s, "[^ACGT]", ""))
    total = sum(F.lit(v) * (n - F.length(F.replace(s, F.lit(b), F.lit("")))) for b, v in zip("ACGT", values, strict=False)) + F.lit(values[4]) * (n - known)
    d = df.where(n > 0).select("name", n.alias("n"), (total / n).alias("mean"), F.concat(F.repeat(F.lit(PAD), margin), s, F.repeat(F.lit(PAD), margin)).alias("sequence"))
    chunks = T.chunks(d, 2 * margin, keep=("name", "n", "mean"), size=CHUNK).where("base < n")
    table = np.full(256, values[4])
    table[list(b"ACGT")] = values[:4]

    def work(batches):
        waves: dict = {}
        for batch in batches:
            for name, n, mean, base, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                symbols = np.frombuffer(chunk.encode("latin-1", "replace"), np.uint8)
                x = np.where(symbols == ord(PAD), 0.0, table[symbols] - mean)
                own = min(CHUNK, n - base)
                size = 1 << int(len(x) + margin * 2).bit_length()
                f, out = np.fft.fft(x, size), []
                for k in sizes:
                    if (k, size) not in waves:
                        waves[k, size] = np.fft.fft(np.conj(_wavelet(k, old)[::-1]), size)
                    y = np.fft.ifft(f * waves[k, size])
                    y = y[margin + 4 * k : margin + 4 * k + own]  # a wavelet's middle lies 4 k behind its begin
                    out.append(float((y.real**2 + y.imag**2).sum()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(sizes), pa.string()), pa.array(sizes, pa.int32()), pa.array(out)], ["name", "width", "power"])

    sums = chunks.mapInArrow(work, "name string, width int, power double")
    return sums.groupBy("name", "width").agg(F.sum("power").alias("power"))


def dominant(df: DataFrame, whole: bool = False) -> DataFrame:
    """name, dominant_scale_bp, codon_scale_ratio, helix_scale_ratio over 50 widths from 3 to 128 of the purine signal, of an
    adaptive prefix or the whole record. Power is by width; ties go to the smaller width."""
    s = F.col("sequence")
    d = df.select("name", (s if whole else F.substring(s, F.lit(1), adaptive_length(s))).alias("sequence"))
    sizes = widths(3, 128, 50)
    near = lambda k: min(sizes, key=lambda w: abs(w - k))
    p = powers(d, PURINE, sizes).withColumn("power", F.col("power") / (F.col("width") + 1e-10))
    at = lambda k: F.round(F.max(F.when(F.col("width") == near(k), F.col("power"))) / (F.avg("power") + 1e-10), 3)
    got = p.groupBy("name").agg(F.min_by("width", F.struct(-F.col("power"), "width")).cast("long").alias("dominant_scale_bp"), at(3).alias("codon_scale_ratio"), at(10).alias("helix_scale_ratio"))
    return df.select("name").join(got, "name", "left")


def dominant_old(df: DataFrame, most: int = 10_000) -> DataFrame:
    """name, fixed_scale_bp over 40 widths from 2 to 64 of the codes of the first `most` symbols."""
    d = df.select("name", F.substring(F.col("sequence"), F.lit(1), F.lit(most)).alias("sequence"))
    p = powers(d, CODE, widths(2, 64, 40), old=True).withColumn("power", F.col("power") / F.col("width"))
    got = p.groupBy("name").agg(F.min_by("width", F.struct(-F.col("power"), "width")).cast("long").alias("fixed_scale_bp"))
    return df.select("name").join(got, "name", "left")
