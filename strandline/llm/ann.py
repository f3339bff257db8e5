"""Nearest neighbours by a block matrix join.

Vectors are scaled to length one and rounded to int8; each keeps its scale and the length of its
rounding error. Candidates and queries are packed into blocks with their codes, and every block of
candidates meets every block of queries in one tile: a product of the code matrices gives all cosines of
the tile, and the error lengths bound how far each can be off. The product is taken in float32 over
slices of 1,024 components, in which sums of int8 products are exact, and slices add up in double
precision. Pairs whose upper bound reaches the k-th best lower bound survive and are computed anew in
double precision from the original values. A worker keeps a heap of k results per query over its tiles;
the heaps are merged per query.

Blocks are dealt to a grid of shards, each block of queries to one row of it and each block of candidates
to one column, so that both sides are copied about as much; nothing is broadcast, and a tile holds two
blocks, whatever the size of the table.

Vectors that are null, empty, zero, of another dimension than most or that hold null or non-finite
components take no part, nor do rows with a null identifier. A query is an identifier: rows that share
one ask together, and the result is the k best pairs of one of these rows and a row of another
identifier; as a candidate every row counts on its own. Ties go to the smaller identifier. Queries with
fewer candidates than k get all of them; an empty table gives an empty table. Extra columns, whatever
their names, are ignored. A vector of very many components makes blocks of fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUANTUM = 127
#: Products of int8 codes add up exactly in float32 over so many components: 1,024 x 127 x 127 < 2^24.
SLICE, BLOCK_BYTES = 1024, 8 << 20
BLOCK = "shard int, block long, ids binary, vectors binary, codes binary, bounds binary"
BEST = "query_id long, vec_id long, score double"


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (doubles) of the vectors that take part; all have the table's commonest dimension."""
    v = F.col(vector).cast("array<double>")
    ok = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.where(ok).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


def _pack(dim: int, block_rows: int, shards):
    """Rows into blocks; `shards` takes a block's number and gives the shards that it goes to."""

    def work(batches):
        ids, vecs, n, number = [], [], 0, 0
        part = 0

        def blocks():
            nonlocal ids, vecs, n, number
            a, v = np.concatenate(ids), np.concatenate(vecs)
            for k in range(0, len(a), block_rows):
                x = v[k : k + block_rows]
                code, bounds = quantised(x)
                one = (a[k : k + block_rows].tobytes(), x.tobytes(), code.tobytes(), bounds.tobytes())
                for s in shards(number + part):
                    yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, (s, part << 32 | number, *one), strict=True))], schema=SCHEMA)
                number += 1
            ids, vecs, n = [], [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            ids.append(np.asarray(batch.column(0)))
            vecs.append(np.asarray(batch.column(1).flatten()).reshape(-1, dim))
            n += batch.num_rows
            if n >= block_rows:
                yield from blocks()
        if n:
            yield from blocks()

    return work


SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary()), ("bounds", pa.binary())])


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors; scale, error length and length of what the codes stand for."""
    safe = x / np.abs(x).max(1, keepdims=True)  # squares of very small or large components stay finite
    unit = safe / np.sqrt((safe * safe).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / QUANTUM
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    back = code * scale[:, None]
    error = np.sqrt(((unit - back) ** 2).sum(1)) + 1e-12
    return code, np.stack((scale, error, np.sqrt((back * back).sum(1))))


class Side:
    """A block: original vectors, codes, and their bounds."""

    def __init__(self, ids, vectors, codes, bounds, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(vectors, np.float64).reshape(-1, dim)
        self.code = np.frombuffer(codes, np.int8).reshape(-1, dim)
        self.scale, self.error, self.size = np.frombuffer(bounds, np.float64).reshape(3, -1)
        with np.errstate(over="ignore"):
            self.norm = np.sqrt(dot(self.x, self.x))
        self.plain = np.isfinite(self.norm) & (self.norm >= 1e-150)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b' of int8 matrices, exactly."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], SLICE):
        out += a[:, k : k + SLICE].astype(np.float32) @ b[:, k : k + SLICE].astype(np.float32).T
    return out


def cosines(q: Side, c: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for a in range(0, len(i), 1 << 17):
        s, t = i[a : a + (1 << 17)], j[a : a + (1 << 17)]
        ok = q.plain[s] & c.plain[t]
        x, y = q.x[s], c.x[t]
        with np.errstate(all="ignore"):
            got = dot(x, y) / (q.norm[s] * c.norm[t])
        if not ok.all():
            x, y = (z / np.abs(z).max(1, keepdims=True) for z in (x, y))
            got = np.where(ok, got, dot(x, y) / np.sqrt(dot(x, x)) / np.sqrt(dot(y, y)))
        out[a : a + (1 << 17)] = got
    return out


def tile(q: Side, c: Side, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, cosine) of pairs that may be among the k best, above `floor`."""
    found = []
    for a in range(0, len(q.ids), 256):
        b = slice(a, a + 256)
        near = products(q.code[b], c.code) * (q.scale[b, None] * c.scale)
        slack = q.size[b, None] * c.error + q.error[b, None] * (c.size + c.error) + 1e-9
        own = q.ids[b, None] == c.ids
        low = np.where(own, -np.inf, near - slack)
        least = floor[b]
        if low.shape[1] >= k:
            least = np.maximum(least, np.partition(low, -k, axis=1)[:, -k])
        i, j = np.nonzero(~own & (near + slack >= least[:, None]))
        found.append((i + a, j))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j, cosines(q, c, i, j)


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k best, nearest first, ties to the smaller identifier."""
    order = np.lexsort((vec, -score, query))
    query = query[order]
    first = np.searchsorted(query, query, "left")
    return order[np.arange(len(order)) - first < k]


def nearest(df: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", block_rows: int = 4096, shards: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of every row that `is_query` picks.

    `is_query` takes the column of identifiers and returns a condition."""
    spark = df.sparkSession
    good = usable(df, key, vector)
    dims = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query(F.col("id"))).alias("asked")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims["d"]
    block_rows = max(64, min(block_rows, BLOCK_BYTES // (8 * dim)))
    shards = shards or max(8, -(-dims["n"] // (8 * block_rows)))
    # Columns and rows of the grid: candidates over `across`, queries over `down` shards.
    across = max(1, min(shards, round((shards * dims["n"] / max(1, dims["asked"])) ** 0.5)))
    down = -(-shards // across)
    good = good.where(F.size("v") == dim).withColumn("part", F.spark_partition_id().cast("long"))
    cand = good.mapInArrow(_pack(dim, block_rows, lambda k: [k % across + across * y for y in range(down)]), BLOCK)
    asked = good.where(is_query(F.col("id"))).repartition(max(1, min(1024, dims["asked"] // block_rows)), "id").withColumn("part", F.spark_partition_id().cast("long"))
    asked = asked.mapInArrow(_pack(dim, max(16, block_rows // 4), lambda k: [k % down * across + x for x in range(across)]), BLOCK)
    right = asked.select("shard", *(F.col(c).alias(f"q_{c}") for c in ("block", "ids", "vectors", "codes", "bounds")))
    tiles = cand.join(right.hint("merge"), "shard").select(*(f"q_{c}" for c in ("block", "ids", "vectors", "codes", "bounds")), "ids", "vectors", "codes", "bounds")

    def work(batches):
        heaps: dict[int, tuple] = {}
        held = 0

        def flush():
            nonlocal heaps, held
            for q_ids, query, vec, score in heaps.values():
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[query]), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])
            heaps, held = {}, 0

        for batch in batches:
            for r in range(batch.num_rows):
                number = batch.column(0)[r].as_py()
                q, c = (Side(*(batch.column(x)[r].as_buffer() for x in range(y, y + 4)), dim) for y in (1, 5))
                floor = np.full(len(q.ids), -np.inf)
                old = heaps.get(number)
                if old and len(old[1]):
                    full = np.bincount(old[1], minlength=len(q.ids)) == k
                    last = np.flatnonzero(np.append(old[1][1:] != old[1][:-1], True))
                    floor[old[1][last]] = old[3][last]
                    floor[~full] = -np.inf
                i, j, s = tile(q, c, k, floor - 1e-12)
                query, vec, score = (i, c.ids[j], s) if not old else (np.concatenate((old[1], i)), np.concatenate((old[2], c.ids[j])), np.concatenate((old[3], s)))
                at = _best(query, vec, score, k)
                held += len(at) - (len(old[1]) if old else 0)
                heaps[number] = (q.ids, query[at], vec[at], score[at])
                if held > 1_000_000:
                    yield from flush()
        yield from flush()

    found = tiles.mapInArrow(work, BEST)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
     n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.size * c.size) AS score
           FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
