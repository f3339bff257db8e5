"""Exact dedup by a tree merge of sorted digest runs.

Rows are read in stretches of `rows_per_run` where they lie, and each stretch makes a sorted run with one
entry per text: digest, length, smallest identifier, number of copies. Runs are dealt to 2^k buckets by
stretch, not by digest, so that a hot text is spread. Binomial rounds follow: in each, the buckets that
differ in the next few bits of their number exchange runs. A run is sorted, so it is cut at the bounds of
the digests' bits; every bucket gets the cuts whose bits it has and merges them. The merge is multiway and
streams: runs travel in segments in order of their first digest, and what is below the next segment's
first digest is final, so a worker holds one segment of each run that it merges. An entry meets at most
2^`fan_bits` runs' equals in a round, however hot it is. Entries are one only if the whole SHA-256 and the
length agree, which is verified at every level, and the smallest identifier is retained there.

Null and empty texts are equal. Very long texts are hashed whole in the JVM and never move. Rows without
an identifier come after all others; ties (rows with one identifier and text) go to the row read first, so
exactly one stays. An empty table gives an empty table. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import vectext as V
from strandline.llm.storage import Scratch

DIGEST = ["d0", "d1", "d2", "d3", "size"]
ENTRY = np.dtype([*((d, np.uint64) for d in DIGEST[:4]), ("size", np.int64), ("none", np.int64), ("id", np.int64), ("uid", np.int64), ("copies", np.int64)])
SEGMENT = 1 << 14
RUN = "bucket int, low long, entries binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def entries_of(batch: pa.RecordBatch) -> np.ndarray:
    """An entry per row of (id, uid, sha, n_bytes), in order of their digests."""
    out = np.zeros(batch.num_rows, ENTRY)
    data, _ = V.column_bytes(batch.column(2))
    for k, d in enumerate(DIGEST[:4]):
        out[d] = data.reshape(-1, 4, 8)[:, k].copy().view(">u8").ravel()
    out["size"], out["uid"], out["copies"] = np.asarray(batch.column(3)), np.asarray(batch.column(1)), 1
    out["none"] = np.asarray(batch.column(0).is_null())
    out["id"] = np.asarray(batch.column(0).fill_null(0))
    return united(out[np.argsort(out["d0"], kind="stable")])


def united(run: np.ndarray) -> np.ndarray:
    """Entries in order of their first digest word, one for each digest and length."""
    if len(run) < 2:
        return run
    tied = run["d0"][1:] == run["d0"][:-1]
    if not tied.any():
        return run
    member = np.zeros(len(run), bool)
    member[1:] |= tied
    member[:-1] |= tied
    at = np.flatnonzero(member)
    # Only entries that agree in the first word are ordered any further.
    some = run[at]
    order = np.lexsort((some["uid"], some["id"], some["none"], *(some[d] for d in reversed(DIGEST))))
    some = some[order]
    new = np.ones(len(some), bool)
    new[1:] = np.logical_or.reduce([some[d][1:] != some[d][:-1] for d in DIGEST])
    first = np.flatnonzero(new)
    some["copies"][first] = np.add.reduceat(some["copies"], first)
    run = run.copy()
    run[at] = some
    keep = np.ones(len(run), bool)
    keep[at[~new]] = False
    return run[keep]


def merged_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted runs as one, by places of one in the other."""
    out = np.empty(len(a) + len(b), ENTRY)
    at = np.searchsorted(a["d0"], b["d0"], "right") + np.arange(len(b))
    rest = np.ones(len(out), bool)
    rest[at] = False
    out[at], out[rest] = b, a
    return united(out)


def _segments(bucket: int, run: np.ndarray, low: int, width: int, bits: int):
    """Segments of a run for the buckets that the digests' bits `low` to `low + width` name."""
    if not len(run):
        return
    bounds = [0, len(run)]
    if width:
        digit = (run["d0"] >> np.uint64(64 - low - width)) & np.uint64((1 << width) - 1)
        bounds = [0, *(np.flatnonzero(np.diff(digit)) + 1).tolist(), len(run)]
    place = bits - low - width
    for a, b in zip(bounds, bounds[1:], strict=False):
        to = bucket if not width else bucket & ~(((1 << width) - 1) << place) | int(digit[a]) << place
        for k in range(a, b, SEGMENT):
            part = run[k : min(b, k + SEGMENT)]
            first = int(part["d0"][0]) - (1 << 63)  # in the order of signed numbers
            yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([first], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["bucket", "low", "entries"])


def merge_segments(rows):
    """(bucket, sorted part) of segments in order of bucket and first digest; parts of a bucket follow each other."""
    own, held = None, np.zeros(0, ENTRY)
    for bucket, entries in rows:
        part = np.frombuffer(entries, ENTRY)
        if bucket != own:
            if len(held):
                yield own, held
            own, held = bucket, np.zeros(0, ENTRY)
        done = int(np.searchsorted(held["d0"], part["d0"][0], "left"))
        if done:
            yield own, held[:done]
        held = merged_pair(held[done:], part)
    if len(held):
        yield own, held


def _gathered(parts, least: int):
    """Parts of a bucket joined to stretches of `least` entries, so that segments stay long."""
    own, held, n = None, [], 0
    for bucket, part in parts:
        if held and (bucket != own or n >= least):
            yield own, np.concatenate(held)
            held, n = [], 0
        own = bucket
        held.append(part)
        n += len(part)
    if held:
        yield own, np.concatenate(held)


def exchanged(runs: DataFrame, low: int, width: int, bits: int) -> DataFrame:
    """Every bucket's merged run, cut and dealt by the next bits for the round that follows."""

    def work(batches):
        rows = ((b, x.as_buffer()) for batch in batches for b, x in zip(batch.column(0).to_pylist(), batch.column(2), strict=True))
        for bucket, part in _gathered(merge_segments(rows), SEGMENT << width):
            yield from _segments(bucket, part, low, width, bits)

    return runs.repartition("bucket").sortWithinPartitions("bucket", "low").mapInArrow(work, RUN)


def _unpacked(runs: DataFrame) -> DataFrame:
    names = ["bucket", "sha", "size", "none", "id", "uid", "copies"]

    def work(batches):
        for batch in batches:
            for bucket, entries in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                x = np.frombuffer(entries.as_buffer(), ENTRY)
                sha = np.stack([x[d] for d in DIGEST[:4]], 1).astype(">u8").tobytes()
                sha = pa.Array.from_buffers(pa.binary(32), len(x), [None, pa.py_buffer(sha)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), bucket, np.int32)), sha, *(pa.array(x[c]) for c in names[2:])], names)

    return runs.mapInArrow(work, "bucket int, sha binary, size long, none long, id long, uid long, copies long")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", rows_per_run: int = 1 << 18, fan_bits: int = 2) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    tmp = Scratch(df.sparkSession, "exact-dedup")
    norm = df.select(F.col(f"`{key}`").cast("long").alias("id"), normalised(F.col(f"`{text}`")).alias("t"))
    rows = tmp.save(norm.select("id", F.monotonically_increasing_id().alias("uid"), F.unhex(F.sha2("t", 256)).alias("sha"), F.octet_length("t").cast("long").alias("n_bytes")), "rows")
    bits = max(2 * fan_bits, math.ceil(math.log2(max(2, rows.count() / rows_per_run))))
    # The upper bits of `uid` are the partition that a row was read in, the lower ones its number there.
    stretch = F.xxhash64(F.shiftright("uid", 33), F.floor(F.col("uid").bitwiseAND(F.lit((1 << 33) - 1)) / rows_per_run))
    rows = rows.withColumn("bucket", F.pmod(stretch, F.lit(1 << bits)).cast("int"))

    def leaves_of(batches):
        held: dict[int, list] = {}
        for batch in batches:
            buckets = np.asarray(batch.column(4))
            for bucket in np.unique(buckets).tolist():
                part = entries_of(batch.filter(pa.array(buckets == bucket)))
                run = held.setdefault(bucket, [])
                run.append(part)
                while len(run) > 1 and len(run[-1]) * 2 >= len(run[-2]):
                    run[-2:] = [merged_pair(run[-2], run[-1])]
                if sum(map(len, run)) >= rows_per_run:
                    for x in held.pop(bucket):
                        yield from _segments(bucket, x, 0, 0, bits)
        for bucket, run in held.items():
            for x in run:
                yield from _segments(bucket, x, 0, 0, bits)

    leaves = tmp.save(exchanged(rows.select("id", "uid", "sha", "n_bytes", "bucket").mapInArrow(leaves_of, RUN), 0, 0, bits), "leaves")
    runs = leaves
    for low in range(0, bits, fan_bits):
        dealt = exchanged(runs, low, min(fan_bits, bits - low), bits)
        runs = tmp.save(dealt, f"round{low}")
    whole = _unpacked(exchanged(runs, 0, 0, bits)).select("sha", "size", F.when(F.col("none") == 0, F.col("id")).alias("keep_id"), F.col("uid").alias("keep_uid"), F.col("copies").alias("group_size"))
    whole = tmp.save(whole, "whole")
    told = _unpacked(leaves).select("bucket", "sha", "size").join(whole, ["sha", "size"])
    out = rows.withColumnRenamed("n_bytes", "size").join(told, ["bucket", "sha", "size"])
    return out.select(F.col("id").alias(key), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""
