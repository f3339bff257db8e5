"""Singular values from Gram matrices that add up over tiles, and of windows that are rows of their own."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import kernels as K
from strandline.functions.symbols import adaptive_length, codes
from strandline.operators import tiles as T

ROWS = 4096


def _upper(width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(width)


def gram_sums(df: DataFrame, width: int = 64) -> DataFrame:
    """name, rows, g, s: a record cut to rows of `width` codes, as the number of whole rows, the upper triangle of X'X
    by row, and the column sums. Chunks of whole rows give their sums, in whole numbers; what moves is one row a
    slot, chunk's task and record, however long the record."""
    digits = df.select("name", codes(F.col("sequence")).alias("sequence"))
    chunks = T.chunks(digits, 0, size=width * ROWS)
    at = _upper(width)

    def work(batches):
        for batch in batches:
            for name, chunk in zip(batch.column(0), batch.column(2), strict=True):
                x = np.frombuffer(chunk.as_buffer(), np.uint8).astype(np.float64) - 48
                x = x[: len(x) // width * width].reshape(-1, width)
                if len(x):
                    values = np.concatenate(([len(x)], (x.T @ x)[at], x.sum(0))).astype(np.int64)  # exact: below 2^53
                    n = len(values)
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), pa.array(values)], ["name", "slot", "value"])

    sums = chunks.select("name", "base", "chunk").mapInArrow(work, "name string, slot int, value long").groupBy("name", "slot").agg(F.sum("value").alias("value"))
    whole = sums.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "value"))), lambda z: z["value"]).alias("v"))
    n = len(at[0])
    return whole.select("name", F.get("v", F.lit(0)).alias("rows"), F.slice("v", 2, n).alias("g"), F.slice("v", n + 2, width).alias("s"))


def row_entropy(df: DataFrame, width: int = 64, least: int = 8) -> DataFrame:
    """name, svd_entropy_ratio: entropy of the squared singular values of a record's rows about their mean, over its
    maximum; trace and squares: sum of the eigenvalues and of their squares. NULL below `least` rows."""
    at = _upper(width)

    def work(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                g = np.zeros((width, width))
                g[at] = r.g
                g = g + np.triu(g, 1).T
                s = np.asarray(r.s, float)
                e = np.maximum(np.linalg.eigvalsh(g - np.outer(s, s) / r.rows), 0.0)
                total = e.sum()
                p = e / (total + K.TINY)
                p = p[p > 0]
                out.append((r.name, float(-(p @ np.log2(p)) / np.log2(min(r.rows, width))), float(total), float(e @ e)))
            yield pd.DataFrame(out, columns=["name", "svd_entropy_ratio", "trace", "squares"])

    got = gram_sums(df, width).where(F.col("rows") >= least).mapInPandas(work, "name string, svd_entropy_ratio double, trace double, squares double")
    return df.select("name").join(got, "name", "left")


def trajectory_entropy(df: DataFrame, window: int = 512, step: int = 256, most: int | None = None, ratio: bool = True, whole: bool = False) -> DataFrame:
    """name, hankel_entropy: mean entropy of the singular values of the windows' trajectory matrices, over its maximum
    if `ratio`. A window is a row: records of any length spread over tasks. Over an adaptive prefix, the first `most`
    symbols, or the `whole` record."""
    s = F.col("sequence")
    cut = s if whole else F.substring(s, F.lit(1), adaptive_length(s) if most is None else F.lit(most))
    d = df.select("name", cut.alias("sequence"))
    # Codes of A, C, G, T; others have 1.5.
    total = sum(F.lit(v) * (F.length("sequence") - F.length(F.replace("sequence", F.lit(b), F.lit("")))) for b, v in zip("ACGT", K.CODE, strict=False))
    known = F.length(F.regexp_replace("sequence", "[^ACGT]", ""))
    mean = (total + F.lit(float(K.CODE[4])) * (F.length("sequence") - known)) / F.length("sequence")
    d = d.withColumn("mid", F.lit(2.0) if ratio else mean).withColumn("n", F.length("sequence")).where(F.col("n") > window)
    pieces = T.tiles(d, window, step, keep=("name", "mid", "n")).where(F.col("start") < F.col("n") - window)
    rows = window // 2

    def work(batches):
        for pdf in batches:
            out = []
            for name, mid, piece in zip(pdf.name, pdf.mid, pdf.piece, strict=True):
                x = K.CODE[K.encode(piece, drop=False)] - mid
                v = np.linalg.svd(np.lib.stride_tricks.sliding_window_view(x, window - rows + 1)[:rows], compute_uv=False)
                v = v[v > 1e-12]
                if len(v):
                    p = v / v.sum()
                    e = float(-(p @ np.log2(p + K.TINY)))
                    out.append((name, e / (np.log2(min(rows, window - rows + 1)) + 1e-10) if ratio else e))
            yield pd.DataFrame(out, columns=["name", "e"])

    got = pieces.select("name", "mid", "piece").mapInPandas(work, "name string, e double").groupBy("name").agg(F.round(F.avg("e"), 5 if ratio else 4).alias("hankel_entropy"))
    return df.select("name").join(got, "name", "left")
