"""Counts that add up over micro-batches: k-mers of a stream of symbol strings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandline.operators import tiles as T


def streaming_kmer_counts(stream: DataFrame, k: int, seq: str = "sequence", keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """Running counts in update or complete mode. Sums of counts need no window and no watermark; the
    state has at most 4^k rows per key. A string must arrive whole, since k-mers do not cross rows."""
    return T.kmer_counts(stream, k, seq, keep)
