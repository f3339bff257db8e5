"""Windows, tiles and k-mers of symbol strings as rows.

A long string is cut into overlapping chunks before anything is taken at every place, since a
substring of a UTF-8 string is found from its start."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import kernels as K

CHUNK, CELL = 1024, 64
COUNTED, PART, LONGEST = 1 << 16, 1 << 20, 12


def starts(length: Column, size: Column | int, step: Column | int) -> Column:
    """0, step, 2 step, ... as long as a tile of `size` fits; an empty array if none does."""
    size, step = (F.lit(x) if isinstance(x, int) else x for x in (size, step))
    fits = (length >= size) & (size > 0) & (step > 0)
    return F.when(fits, F.sequence(F.lit(0), (length - size).cast("int"), F.greatest(step, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))


def tiles(df: DataFrame, size: Column | int, step: Column | int | None = None, seq: str = "sequence", keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """keep..., tile (from 0), start, piece."""
    step = size if step is None else step
    size_c = F.lit(size) if isinstance(size, int) else size
    out = df.select(*keep, F.col(seq).alias("_s"), size_c.cast("int").alias("_w"), F.posexplode(starts(F.length(seq), size, step)).alias("tile", "start"))
    return out.select(*keep, "tile", F.col("start").cast("long").alias("start"), F.substring("_s", F.col("start") + 1, F.col("_w")).alias("piece"))


def chunks(df: DataFrame, overlap: int, seq: str = "sequence", keep: tuple[str, ...] = ("name",), size: int = CHUNK) -> DataFrame:
    """keep..., base, chunk. Pieces are sliced from bytes (symbols are single ones), each found at once, and
    exploded alone, so that no row carries the whole string."""
    raw = F.col(seq).cast("binary")
    at = F.sequence(F.lit(0), F.greatest(F.length(raw) - 1, F.lit(0)), F.lit(size))
    pieces = F.transform(at, lambda b: F.struct(b.alias("base"), F.substring(raw, b + 1, F.lit(size + overlap)).cast("string").alias("chunk")))
    return df.where(F.length(seq) > 0).select(*keep, F.inline(pieces))


def kmers(df: DataFrame, k: int, seq: str = "sequence", keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """keep..., pos (from 0), kmer: every place, words with other symbols than A, C, G, T left out."""
    cells = chunks(df, k - 1, seq, keep).where(F.length("chunk") >= k)
    at = F.explode(F.sequence(F.lit(0), F.least(F.length("chunk") - k, F.lit(CHUNK - 1)), F.lit(CELL))).alias("at")
    cells = cells.select(*keep, "base", "chunk", at).select(*keep, (F.col("base") + F.col("at")).alias("base"), F.substring("chunk", F.col("at") + 1, F.lit(CELL + k - 1)).alias("cell"))
    n = F.least(F.length("cell") - (k - 1), F.lit(CELL))
    words = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col("cell"), i, F.lit(k)))
    out = cells.select(*keep, "base", F.posexplode(words).alias("i", "kmer"))
    return out.where(F.col("kmer").rlike("^[ACGT]+$")).select(*keep, (F.col("base") + F.col("i")).cast("long").alias("pos"), "kmer")


def kmer_counts(df: DataFrame, k: int, seq: str = "sequence", keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """keep..., kmer, cnt. Counts add up before the shuffle, so a key moves 4^k rows a task at most."""
    if k > LONGEST:
        return kmers(df, k, seq, keep).groupBy(*keep, "kmer").agg(F.count(F.lit(1)).alias("cnt"))
    return word_counts(df, (k,), seq, keep).select(*keep, "kmer", "cnt")


def word_counts(df: DataFrame, ks: tuple[int, ...], seq: str = "sequence", keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """keep..., k, kmer, cnt for words of several lengths up to `LONGEST`, in one pass. Chunks go to Arrow, where about
    `PART` symbols at a time become counts by key, in place of a row a place."""
    if not ks or max(ks) > LONGEST or min(ks) < 1:
        raise ValueError(f"words of 1 to {LONGEST} symbols, not {ks}")
    cells = chunks(df, max(ks) - 1, seq, keep, COUNTED).drop("base")
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "k int", "kmer string", "cnt long"])

    def counted(batches):
        for batch in batches:
            size = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column(len(keep))).to_numpy(zero_copy_only=False))))
            cuts = np.unique(np.searchsorted(size, np.arange(0, size[-1], PART)))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
                yield from _counts_of(batch.slice(a, b - a), ks)

    counts = cells.mapInArrow(counted, schema)
    return counts.groupBy(*keep, "k", "kmer").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("cnt"))


def _counts_of(rows: pa.RecordBatch, ks: tuple[int, ...]):
    """Batches of keys, k, word and count, from rows of keys and a chunk. Keys are numbered, and a key's words are
    numbers beside its own; words don't reach over chunks, and those that begin in a chunk's overlap are the next one's."""
    *keys, text = rows.columns
    group = np.zeros(rows.num_rows, np.int64)
    for c in keys:
        coded = pc.dictionary_encode(c, null_encoding="encode")
        group = np.unique(group * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    first = np.unique(group, return_index=True)[1]
    size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    a = K.TABLE[np.frombuffer(b"".join(text.cast(pa.binary()).to_pylist()), np.uint8)]
    owner, inside = np.repeat(group, size), np.arange(len(a)) - np.repeat(end - size, size)
    left = np.repeat(size, size) - inside
    for k in ks:
        c = K.kmer_codes(a, k)
        n = len(c)
        own = (c >= 0) & (left[:n] >= k) & (inside[:n] < COUNTED)
        key = owner[:n][own] * 4**k + c[own]
        if len(first) * 4**k <= 4 * PART:
            times = np.bincount(key)
            key = np.flatnonzero(times)
            times = times[key]
        else:
            key, times = np.unique(key, return_counts=True)
        at = pa.array(first[key // 4**k])
        letters = np.frombuffer(b"ACGT", np.uint8)[key[:, None] >> 2 * np.arange(k - 1, -1, -1) & 3]
        words = pa.StringArray.from_buffers(len(key), pa.py_buffer(np.arange(len(key) + 1, dtype=np.int32) * k), pa.py_buffer(letters.tobytes()))
        columns = [*(x.take(at) for x in keys), pa.array(np.full(len(key), k, np.int32)), words, pa.array(times.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, [*rows.schema.names[:-1], "k", "kmer", "cnt"])


def symbols(df: DataFrame, seq: str = "sequence", keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """keep..., pos, base."""
    out = chunks(df, 0, seq, keep).select(*keep, F.col("base").alias("_b"), F.posexplode(F.split("chunk", "")).alias("i", "base"))
    return out.where(F.col("base") != "").select(*keep, (F.col("_b") + F.col("i")).cast("long").alias("pos"), "base")


def all_kmers(spark, k: int) -> DataFrame:
    from strandline.functions.symbols import code_to_kmer

    return spark.range(4**k).select(code_to_kmer(F.col("id"), k).alias("kmer"))


def patch_size(length: Column, patch: int = 3000) -> Column:
    return F.when(length < 2 * patch, F.greatest(F.lit(200), F.floor(length / 4))).otherwise(F.lit(patch)).cast("int")


def skew_size(length: Column, bins: int = 32) -> Column:
    return F.greatest(F.lit(100), F.floor(length / bins)).cast("int")


def grammar_blocks(df: DataFrame, levels: int = 4, seq: str = "sequence", keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """keep..., block, piece: blocks of max(64, length / levels) symbols, 32 at least; else two halves."""
    n = F.length(seq)
    size = F.greatest(F.lit(64), F.floor(n / levels)).cast("int")
    cut = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), size), lambda s: F.substring(F.col(seq), s + 1, size)), lambda p: F.length(p) >= 32)
    half = F.floor(n / 2).cast("int")
    halves = F.array(F.substring(F.col(seq), F.lit(1), half), F.substring(F.col(seq), half + 1, n))
    return df.select(*keep, F.posexplode(F.when(F.size(cut) < 2, halves).otherwise(cut)).alias("block", "piece"))


def phase_blocks(df: DataFrame, blocks: int = 4, seq: str = "sequence", keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """keep..., block, piece: [b n / blocks, (b + 1) n / blocks)."""
    n = F.length(seq)
    lo = lambda b: F.floor(b * n / blocks).cast("int")
    out = df.select(*keep, F.col(seq).alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    n = F.length("_s")
    return out.select(*keep, "block", F.substring(F.col("_s"), lo(F.col("block")) + 1, F.floor((F.col("block") + 1) * n / blocks).cast("int") - F.floor(F.col("block") * n / blocks).cast("int")).alias("piece"))
