"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.storage import Scratch


def _mark(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def components(edges: DataFrame, tmp: Scratch) -> DataFrame:
    """(id, root) of every end of `edges` (a, b); root is the smallest id of the component.

    Every round at least merges what meets at a node. Minima are aggregated before they are shuffled and
    saved before they are joined, so that adaptive execution can split a node with very many neighbours.
    Rounds go on until one changes nothing. An edge with a null end or between equal ones is none; repeated
    edges count once; no edges give no rows."""
    edges = tmp.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, mark = None, _mark(edges)
    while mark != before:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = tmp.save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = tmp.save(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        lower = tmp.save(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = tmp.save(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        tmp.drop(edges, least, large, lower)
        edges, before, mark = new, mark, _mark(new)
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots.join(edges.select(F.col("a").alias("id")), "id", "left_anti"))
