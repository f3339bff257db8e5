"""Near points of sampled walks: a distance join on a grid, its components and independent loops.

A record's walk is sampled at `points` places inside its chunks. Squared distances of whole coordinates are whole
numbers. Up to `FEW` points of a record meet in one Arrow row, by a matrix; more meet by joins: the percentile of their
distances comes from counts by value, one row a value, and points meet only those of their own and the eight
neighbouring cells of a grid as wide as the percentile."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import fractal, graphs
from strandline.sources.shared import saved

FEW = 2048  # a matrix of 2,048 x 2,048 whole numbers is 34 MB


def sampled(df: DataFrame, points: int = 400) -> DataFrame:
    """name, i, x, y: the purine and weak/strong walk at evenly spaced places; places repeat in short records."""
    rows = fractal.walk_chunks(df.withColumn("_n", F.length("sequence")), {"x": fractal.PURINE, "y": fractal.WEAK}, ("name",), ("_n",))

    def work(base, walks, row):
        at = np.round(np.linspace(0, row("_n") - 1, points)).astype(np.int64)
        i = np.flatnonzero((at >= base) & (at < base + len(walks[0])))
        return [i, *(w[at[i] - base] for w in walks)]

    return fractal._mapped(rows, ("name",), {"x": fractal.PURINE, "y": fractal.WEAK}, "i long, x long, y long", work)


def epsilon(at: DataFrame, share: float = 0.1, positive: bool = True) -> DataFrame:
    """name, eps: the percentile (linear between ranks) of a record's distances, each pair counted both ways; of those
    above zero, or of all, a point's to itself included. Points alike are one row with their number."""
    spots = at.groupBy("name", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    p, q = (spots.select("name", *(F.col(c).alias(f"{c}{k}") for c in ("x", "y", "c"))) for k in "12")
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    far = p.join(q, "name").groupBy("name", (dx * dx + dy * dy).alias("d2")).agg(F.sum(F.col("c1") * F.col("c2")).alias("c"))
    far = far.where("d2 > 0") if positive else far
    order = Window.partitionBy("name").orderBy("d2")
    far = far.select("name", "d2", "c", F.sum("c").over(order).alias("upto"), F.sum("c").over(Window.partitionBy("name")).alias("n"))
    place = F.lit(share) * (F.col("n") - 1)
    holds = lambda r: (F.col("upto") - F.col("c") <= r) & (r < F.col("upto"))
    d = F.sqrt(F.col("d2").cast("double"))
    low, high = F.max(F.when(holds(F.floor(place)), d)), F.max(F.when(holds(F.ceil(place)), d))
    part = F.max(place - F.floor(place))
    return far.groupBy("name").agg((low + (high - low) * part).alias("eps"))


def near_pairs(at: DataFrame, eps: DataFrame) -> DataFrame:
    """name, a, b for a < b: different points nearer than eps."""
    own = at.join(eps.where("eps > 0"), "name").select("name", "i", "x", "y", "eps", *(F.floor(F.col(c) / F.col("eps")).alias(f"c{c}") for c in "xy"))
    around = F.explode(F.array(*(F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u in (-1, 0, 1) for v in (-1, 0, 1))))
    other = own.select("name", F.col("i").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), around.alias("z"), "cx", "cy")
    other = other.select("name", "b", "x2", "y2", (F.col("cx") + F.col("z.u")).alias("cx"), (F.col("cy") + F.col("z.v")).alias("cy"))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    d = F.sqrt((dx * dx + dy * dy).cast("double"))
    return own.join(other, ["name", "cx", "cy"]).where((F.col("i") < F.col("b")) & (d > 0) & (d < F.col("eps"))).select("name", F.col("i").alias("a"), "b")


def _figures(x: np.ndarray, y: np.ndarray, share: float, positive: bool) -> tuple[float | None, int, int]:
    """eps, edges and how many points their components are short of, of one record's points."""
    n = len(x)
    i, j = np.triu_indices(n, 1)
    d2 = (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2
    pool = d2[d2 > 0] if positive else d2
    own = 0 if positive else n  # distances of points to themselves come first
    total = own + 2 * len(pool)
    if not total:
        return None, 0, 0
    place = share * (total - 1)
    ranks = [int(np.floor(place)), int(np.ceil(place))]
    at = [max(0, r - own) // 2 for r in ranks]
    held = np.partition(pool, at) if len(pool) else pool
    low, high = (0.0 if r < own else float(np.sqrt(float(held[k]))) for r, k in zip(ranks, at, strict=True))
    eps = low + (high - low) * (place - ranks[0])
    near = (d2 > 0) & (np.sqrt(d2.astype(float)) < eps)
    meets = np.zeros((n, n), bool)
    meets[i[near], j[near]] = meets[j[near], i[near]] = True
    left, parts = np.ones(n, bool), 0
    while left.any():
        fresh = np.zeros(n, bool)
        fresh[left.argmax()] = True
        parts += 1
        while fresh.any():
            left &= ~fresh
            fresh = meets[fresh].any(0) & left
    return eps, int(near.sum()), n - parts


def figures(at: DataFrame, share: float = 0.1, positive: bool = True) -> DataFrame:
    """name, n, eps, edges, less: points, percentile, pairs nearer than it, and points less components. A record's
    points, `FEW` at most, are one row."""

    def work(batches):
        for pdf in batches:
            rows = [(name, len(x), *_figures(np.asarray(x, np.int64), np.asarray(y, np.int64), share, positive)) for name, x, y in zip(pdf.name, pdf.x, pdf.y, strict=True)]
            yield pd.DataFrame(rows, columns=["name", "n", "eps", "edges", "less"])

    held = at.groupBy("name").agg(F.collect_list(F.struct("x", "y")).alias("p")).select("name", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return held.mapInPandas(work, "name string, n long, eps double, edges long, less long")


def joined_figures(at: DataFrame, share: float = 0.1, positive: bool = True) -> DataFrame:
    """The same by joins, for any number of points."""
    at = saved(at)
    eps = epsilon(at, share, positive)
    pairs = saved(near_pairs(at, eps))
    ends = graphs.weak_components(pairs.select(F.concat_ws("\x1f", "name", "a").alias("src"), F.concat_ws("\x1f", "name", "b").alias("dst")))
    less = ends.where("node <> component").groupBy(F.substring_index("component", "\x1f", 1).alias("name")).agg(F.count(F.lit(1)).alias("less"))
    counts = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("edges"))
    got = at.groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(eps, "name", "left").join(counts, "name", "left").join(less, "name", "left")
    return got.select("name", "n", "eps", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("less", F.lit(0)).alias("less"))


def homology(df: DataFrame, points: int = 400, share: float = 0.1, positive: bool = True) -> DataFrame:
    """name, epsilon, edges, betti_0 (components of the graph of near points), betti_1 (its independent loops; -1 unless
    `positive`). A record whose points are all alike has as many components as points and no loop; an empty one NULLs."""
    df = saved(df.select("name", "sequence"))  # records are made once
    got = (figures if points <= FEW else joined_figures)(sampled(df, points), share, positive)
    parts = F.col("n") - F.col("less")
    loops = F.greatest(F.col("edges") - F.col("n") + parts, F.lit(0)) if positive else F.lit(-1).cast("long")
    return df.select("name").join(got.select("name", F.col("eps").alias("epsilon"), "edges", parts.alias("betti_0"), loops.alias("betti_1")), "name", "left")
