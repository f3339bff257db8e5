"""Walks, box counts and detrended fluctuation from chunks of symbols.

A sequence is cut into chunks of bounded length. A chunk is one row: the walk inside it is summed there, in
an Arrow batch; only a chunk's totals are added up along the sequence, by a window over one row a chunk. What
leaves a chunk are its distinct cells or its segments' variances, never a row a symbol, except from `walk`."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from strandline.functions.symbols import adaptive_length
from strandline.operators import tiles as T

CHUNK = 1 << 14
#: Steps of A, C, G, T and of any other symbol.
PURINE, KETO, WEAK = (1, -1, 1, -1, -1), (-1, 1, 1, -1, 0), (1, -1, -1, 1, -1)


def _table(step: tuple[int, ...]) -> np.ndarray:
    out = np.full(256, step[4], np.int64)
    out[list(b"ACGT")] = step[:4]
    return out


def _mapped(rows: DataFrame, keep: tuple[str, ...], steps: dict[str, tuple[int, ...]], schema: str, work) -> DataFrame:
    """keep... and the columns that `work` gives for each chunk: it takes the chunk's place, its walks and the
    rest of its row. `rows` has keep..., base, chunk, and for each step where its walk begins."""
    tables = {n: _table(s) for n, s in steps.items()}
    out = ST.StructType([*(rows.schema[k] for k in keep), *ST._parse_datatype_string(schema).fields])
    types = [f.dataType for f in out.fields[len(keep) :]]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}

    def run(batches):
        for batch in batches:
            base, chunk = (batch.column(batch.schema.get_field_index(c)) for c in ("base", "chunk"))
            begin = {n: np.asarray(batch.column(batch.schema.get_field_index(n))) for n in steps if n in batch.schema.names}
            for r in range(batch.num_rows):
                symbols = np.frombuffer(chunk[r].as_buffer(), np.uint8)
                walks = [np.cumsum(t[symbols]) + (begin[n][r] if n in begin else 0) for n, t in tables.items()]
                columns = work(base[r].as_py(), walks, lambda c, batch=batch, r=r: batch.column(batch.schema.get_field_index(c))[r].as_py())
                if not len(columns[0]):
                    continue
                same = pa.array(np.full(len(columns[0]), r))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(same) for k in range(len(keep))), *(pa.array(c, kinds[t.simpleString()]) for c, t in zip(columns, types, strict=True))], out.names)

    return rows.mapInArrow(run, out)


def walk_chunks(df: DataFrame, steps: dict[str, tuple[int, ...]], keep: tuple[str, ...] = ("name",), extra: tuple[str, ...] = ()) -> DataFrame:
    """keep..., base, chunk, and for each step its sum before the chunk (under its own name) and the least value of
    its walk along the whole sequence (`<step>_low`). `extra` are further columns of `df`."""
    c = T.chunks(df, 0, keep=(*keep, *extra), size=CHUNK).select(*keep, "base", "chunk", *extra)
    totals = ", ".join(f"{n}_sum long, {n}_min long" for n in steps)
    sums = _mapped(c.select(*keep, "base", "chunk"), (*keep, "base"), steps, totals, lambda base, walks, _: [x for w in walks for x in ([w[-1]], [w.min()])])
    before = Window.partitionBy(*keep).orderBy("base").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("*", *(F.coalesce(F.sum(f"{n}_sum").over(before), F.lit(0)).alias(n) for n in steps))
    sums = sums.select(*keep, "base", *steps, *(F.min(F.col(n) + F.col(f"{n}_min")).over(Window.partitionBy(*keep)).alias(f"{n}_low") for n in steps))
    return c.join(sums, [*keep, "base"])


def walk(df: DataFrame, steps: dict[str, tuple[int, ...]], keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """keep..., pos and the running sum of every step: a row a symbol."""
    schema = ", ".join(("pos long", *(f"{n} long" for n in steps)))
    return _mapped(walk_chunks(df, steps, keep), keep, steps, schema, lambda base, walks, _: [np.arange(base, base + len(walks[0])), *walks])


def _box_counts(df: DataFrame, steps: dict[str, tuple[int, ...]], keep: tuple[str, ...], shifted: bool) -> DataFrame:
    """keep..., e, n: boxes of 2^e that the walk of two steps meets, for 3 <= e < `last`, a column of `df`. Boxes begin at
    the walk's least values, or are cut towards zero.

    A chunk packs its boxes of 2^3 by tiles of 64 x 64: two bytes a box and one row a tile. Boxes of up to 2^9 lie in one
    tile, whose lists are united and halved in place; only larger ones are told apart by rows, as tiles are."""
    x, y = steps

    def packed(base, walks, row):
        if shifted:
            cut = [(w - row(f"{n}_low")) // 8 for n, w in zip(steps, walks, strict=True)]
        else:
            cut = [_towards_zero(w, 8) for w in walks]
        both = np.unique(np.stack(cut), axis=1)
        tile = _towards_zero(both, 64)
        inner = both - 64 * tile + 63
        order = np.lexsort((tile[1], tile[0]))
        tile, code = tile[:, order], (inner[0] * 128 + inner[1])[order].astype(np.uint16)
        first = np.flatnonzero(np.append(True, (tile[:, 1:] != tile[:, :-1]).any(0)))
        return [tile[0, first], tile[1, first], [code[i:j].tobytes() for i, j in zip(first, [*first[1:], len(code)], strict=True)]]

    rows = walk_chunks(df, steps, (*keep, "last"))
    tiles = _mapped(rows, (*keep, "last"), steps, "tx long, ty long, boxes binary", packed)
    tiles = tiles.groupBy(*keep, "last", "tx", "ty").agg(F.collect_list("boxes").alias("boxes"))
    at = len(keep)
    out = ST.StructType([*(tiles.schema[k] for k in keep), *ST._parse_datatype_string("e int, bx long, by long, n long").fields])

    def halved(batches):
        for batch in batches:
            which, found = [], []
            for r, (last, tx, ty, lists) in enumerate(zip(*(batch.column(at + c).to_pylist() for c in range(4)), strict=True)):
                code = np.unique(np.frombuffer(b"".join(lists), np.uint16)).astype(np.int64)
                bx, by = code // 128 - 63 + 64 * tx, code % 128 - 63 + 64 * ty
                for e in range(3, last):
                    if e <= 9:
                        # Boxes of a tile stay in it; their pair is one number.
                        n = len(np.unique(_towards_zero(bx, 1 << e - 3) * (1 << 32) + _towards_zero(by, 1 << e - 3)))
                        found.append((e, 0, 0, n))
                    else:
                        found.append((e, *(int(_towards_zero(np.int64(t), 1 << e - 9)) for t in (tx, ty)), 1))
                which += [r] * (last - 3)
            if which:
                columns = zip(*found, strict=True)
                own = pa.array(which)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in range(at)), *(pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], out.names)

    sums = tiles.mapInArrow(halved, out).groupBy(*keep, "e", "bx", "by").agg(F.sum("n").alias("n"))
    return sums.groupBy(*keep, "e").agg(F.when(F.col("e") <= 9, F.sum("n")).otherwise(F.count(F.lit(1))).alias("n"))


def _towards_zero(v: np.ndarray, by: int) -> np.ndarray:
    return np.sign(v) * (np.abs(v) // by)


def _slope(boxes: DataFrame, keep, least: int, at_least: int) -> DataFrame:
    ok = boxes.where(F.col("n") >= at_least)
    x = F.log(1.0 / F.pow(F.lit(2.0), F.col("e")))
    return ok.groupBy(*keep).agg(F.when(F.count(F.lit(1)) >= least, F.regr_slope(F.log(F.col("n").cast("double")), x)).alias("dim"))


def box_dimension(df: DataFrame, keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """Box-counting dimension of the purine and strong/weak walk; NULL below 500 symbols."""
    last = F.greatest(F.lit(4), F.floor(F.log2(F.length("sequence").cast("double"))).cast("int") - 2)
    d = df.where(F.length("sequence") >= 500).withColumn("last", last).where("last >= 6")
    n = _box_counts(d, {"x": PURINE, "y": KETO}, keep, True)
    return df.select(*keep).join(_slope(n, keep, 3, 2).withColumnRenamed("dim", "chaos_walk_box_dim_proxy"), list(keep), "left")


def walk_dimension(df: DataFrame, most: int = 200_000, whole: bool = False) -> DataFrame:
    """The same over an adaptive prefix of `most` symbols at most, or the whole sequence, with boxes cut towards
    zero and no shift of the walk."""
    p = df.where(F.length("sequence") >= 500)
    p = p if whole else p.withColumn("sequence", F.substring(F.col("sequence"), F.lit(1), adaptive_length(F.col("sequence"), most)))
    p = p.withColumn("last", F.floor(F.log2(F.length("sequence").cast("double"))).cast("int") - 2)
    got = _slope(_box_counts(p.where("last > 3"), {"x": PURINE, "y": WEAK}, ("name",), False), ("name",), 1, 1)
    return df.select("name").join(got.select("name", F.round("dim", 4).alias("fractal_dim")), "name", "left")


def log_scales(n: int) -> list[int]:
    """Up to ten scales from 16 to n / 8, as kernels.dfa_scales; the C library's power is the same on every processor."""
    low, high = math.log10(16), math.log10(max(32, n // 8))
    return sorted({int(math.pow(10, high if i == 9 else low + i * ((high - low) / 9))) for i in range(10)})


def scales_of(length: Column) -> Column:
    """`log_scales` of each length."""

    def scales(n: pd.Series) -> pd.Series:
        return n.map(log_scales)

    return F.pandas_udf(scales, "array<int>")(length)


def _variance(n: Column, sx: Column, sxx: Column, stx: Column) -> Column:
    """Variance around the straight line of n values at 0, 1, ..., n - 1, from exact sums of whole numbers.

    With q near the slope, n^2 var = (n syy - q^2 stt - 2 q r) - r^2 / stt, where r = sty - q stt: whole numbers
    of 38 digits but for the last term, so that a straight segment of slope q has variance 0."""
    n, sx, sxx, stx = (c.cast("decimal(38,0)") for c in (n, sx, sxx, stx))
    whole = lambda c: F.floor(c).cast("decimal(38,0)")
    st, stt = whole(n * (n - 1) / 2), whole(n * n * (n * n - 1) / 12)
    syy, sty = n * sxx - sx * sx, n * stx - st * sx
    q = F.rint(sty.cast("double") / F.nullif(stt, F.lit(0)).cast("double")).cast("decimal(38,0)")
    r = sty - q * stt
    rest = (syy - q * q * stt - q * r * 2).cast("double") - r.cast("double") * r.cast("double") / F.nullif(stt, F.lit(0)).cast("double")
    return F.greatest(F.coalesce(rest, F.lit(0.0)), F.lit(0.0)) / (n * n).cast("double")


def fluctuation(walk: DataFrame, scales: Column, keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """keep..., scale, seg, var: variance around the straight line of every whole segment, for a walk of any
    whole numbers given as rows (keep..., pos, len, x); `scales` is an array.

    The straight lines that make a profile of a walk vanish with a segment's own, so the walk itself is taken.
    For walks of symbols `segment_variances` moves far fewer rows."""
    s = walk.withColumn("scale", F.explode(scales)).where(F.col("len") >= F.col("scale"))
    s = s.withColumn("seg", F.floor(F.col("pos") / F.col("scale"))).where((F.col("seg") + 1) * F.col("scale") <= F.col("len"))
    x, t = F.col("x").cast("decimal(19,0)"), (F.col("pos") % F.col("scale")).cast("decimal(10,0)")
    sums = s.groupBy(*keep, "scale", "seg").agg(F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(t * x).alias("stx"))
    return sums.select(*keep, "scale", "seg", _variance(*(F.col(c) for c in ("scale", "sx", "sxx", "stx"))).alias("var"))


def _inside(base: int, x: np.ndarray, length: int, scale: int) -> list[np.ndarray]:
    """seg and var of the segments of a scale that lie whole in a chunk; as `_variance`, in 64 bits, which sums
    of a chunk's length fit once they are centred."""
    a = -(-base // scale)
    b = min(base + len(x), length) // scale
    if b <= a:
        return [np.zeros(0, np.int64), np.zeros(0)]
    y = x[a * scale - base : b * scale - base].reshape(-1, scale)
    y = y - y[:, :1]
    t = np.arange(scale)
    st, stt = scale * (scale - 1) // 2, scale * scale * (scale * scale - 1) // 12
    sx = y.sum(1)
    syy, sty = scale * (y * y).sum(1) - sx * sx, scale * (y @ t) - st * sx
    q = np.rint(sty / max(stt, 1)).astype(np.int64)
    r = sty - q * stt
    rest = (syy - q * q * stt - 2 * q * r) - r.astype(np.float64) ** 2 / max(stt, 1)
    return [np.arange(a, b), np.maximum(rest, 0) / scale**2]


def _across(base: int, x: np.ndarray, length: int, scale: int) -> list[tuple[int, ...]]:
    """seg, n, value at its begin, and sums of the pieces of segments that reach beyond a chunk."""
    out = []
    end = min(base + len(x), length // scale * scale)
    for seg in sorted({base // scale, (end - 1) // scale}) if end > base else []:
        a, b = max(base, seg * scale), min(end, (seg + 1) * scale)
        if (seg * scale >= base and (seg + 1) * scale <= base + len(x)) or b <= a:
            continue
        y, t = x[a - base : b - base], np.arange(a - seg * scale, b - seg * scale)
        c = int(y[0])
        y = y - c
        out.append((seg, b - a, c, int(y.sum()), int((y * y).sum()), int((y * t).sum()), int(t.sum())))
    return out


def segment_variances(df: DataFrame, scales: str, step: tuple[int, ...] = PURINE, keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """keep..., scale, seg, var of the walk of a step, as `fluctuation`; `scales` is an array column of `df`.

    Segments whole in a chunk are finished there. Of one that reaches over chunks, a row of sums a chunk is
    added up: two rows a scale and chunk at most. All sums are exact."""
    rows = walk_chunks(df.withColumn("_n", F.length("sequence")), {"x": step}, keep, (scales, "_n"))

    def inside(base, walks, row):
        n = row("_n")
        got = [(s, *_inside(base, walks[0], n, s)) for s in row(scales) if s <= n]
        empty = np.zeros(0, np.int64)
        return [np.concatenate([empty, *(np.full(len(g), s) for s, g, _ in got)]), np.concatenate([empty, *(g for _, g, _ in got)]), np.concatenate([np.zeros(0), *(v for _, _, v in got)])]

    def across(base, walks, row):
        n = row("_n")
        got = [(s, *p) for s in row(scales) if s <= n for p in _across(base, walks[0], n, s)]
        return [np.array(c, np.int64) for c in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 8

    whole = _mapped(rows, keep, {"x": step}, "scale int, seg long, var double", inside)
    parts = _mapped(rows, keep, {"x": step}, "scale int, seg long, n long, c long, s1 long, s2 long, st long, t long", across)
    n, c, s1, s2, st, t = (F.col(k).cast("decimal(19,0)") for k in ("n", "c", "s1", "s2", "st", "t"))
    sums = parts.groupBy(*keep, "scale", "seg").agg(F.sum(s1 + n * c).alias("sx"), F.sum(s2 + c * s1 * 2 + n * c * c).alias("sxx"), F.sum(st + c * t).alias("stx"))
    return whole.unionByName(sums.select(*keep, "scale", "seg", _variance(*(F.col(k) for k in ("scale", "sx", "sxx", "stx"))).alias("var")))


def generalised_hurst(var: DataFrame, qs: list[float], floor: float, keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """keep..., q, h: log-log slope of the q-th order fluctuation over the scales."""
    v = F.greatest(F.col("var"), F.lit(0.0))
    rms = F.sqrt(v) + floor
    rows = var.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in qs)))).groupBy(*keep, "scale", "q").agg(
        F.when(F.first("q") == 0, F.exp(F.avg(F.log(rms)))).otherwise(F.pow(F.avg(F.pow(rms, F.col("q"))), 1 / F.nullif(F.first("q"), F.lit(0.0)))).alias("f")
    )
    return rows.groupBy(*keep, "q").agg(F.when(F.count(F.lit(1)) >= 4, F.regr_slope(F.log("f"), F.log(F.col("scale").cast("double")))).alias("h"))
