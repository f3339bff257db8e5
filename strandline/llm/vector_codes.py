"""Vector codes by product quantisation, with codebooks from Lloyd's rounds over partition-local heaps.

Components become integers, floor(scale * x), and a vector is cut into `parts` equal consecutive parts. Every
part position has a codebook. A partition packs its rows into blocks; a block keeps, for each part position
and each entry, a heap of the parts assigned to that entry, keyed by their slack: the distance to the second
nearest entry minus that to the nearest, plus the drift that the entry's heap had seen by then. When entries
move, an entry's drift grows by its own movement and the longest movement of any other; only parts whose key
does not exceed it can have changed sides, and only these are popped, scanned anew against the whole codebook
and pushed again. A heap is an ascending array, so that pops are its head. Distances of integers are exact,
keys are rounded down: the assignment is that of a full scan, ties to the lower index.

Blocks are rows of a written table, which a round reads and writes without a shuffle, so a lost executor costs
a reread. A block also holds the changes of the sums and counts of its entries; only these are added up across
blocks, by slot: parts x entries x (1 + width) numbers, whatever the size of the table, reach the driver.

Vectors that are null or hold null or non-finite components are dropped. So are those of another dimension
than most (ties: the smaller dimension): their parts cannot be compared. Where `parts` does not divide the dimension
each vector is filled up with zeros. A dropped row is in no sum. Rows with a null key are kept; as starting
entries they come last. Repeated rows each count; rows with equal keys start in order of their components.
Fewer rows than `entries` give as many entries. An empty table gives an empty table. Null labels are one
label. Extra columns, whatever their names, are ignored. Components so large that a squared distance
does not fit 64 bits are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.storage import Scratch

PARTS, ENTRIES, SCALE, BLOCK_ROWS, BLOCK_BYTES = 16, 64, 256, 8192, 4 << 20
STATE = ("x", "at", "key", "size", "delta")


def integers(df: DataFrame, key: str, vector: str, label: str | None, scale: int) -> DataFrame:
    """k, l and v (floor(scale * x) of each component, as doubles) of the rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # rint(y) - 1 where that lies above y: a floor that stays a double, whatever its size.
    floor = F.transform(v, lambda x: F.rint(x * scale) - F.when(F.rint(x * scale) > x * scale, 1.0).otherwise(0.0))
    return df.where(ok).select(F.col(f"`{key}`").alias("k"), (F.col(f"`{label}`") if label else F.lit(None).cast("int")).alias("l"), floor.alias("v"))


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row, and how much farther the second nearest is, rounded down."""
    d = (book * book).sum(1) - 2 * (x @ book.T)
    near, rows = d.argmin(1), np.arange(len(x))
    own = (x * x).sum(1)
    first = np.sqrt((d[rows, near] + own).astype(np.float64))
    if len(book) == 1:
        return near, np.full(len(x), np.inf)
    d[rows, near] = np.iinfo(np.int64).max if d.dtype == np.int64 else np.inf
    second = np.sqrt((d.min(1) + own).astype(np.float64))
    return near, second - first - 1e-14 * (second + first)


class Heaps:
    """The heaps of one part position in a block. `at` holds rows, entry after entry; `key` ascends within
    an entry; `size` counts the rows of each."""

    def __init__(self, at: np.ndarray, key: np.ndarray, size: np.ndarray):
        self.at, self.key, self.size = at, key, size

    def violated(self, drift: np.ndarray) -> np.ndarray:
        """Places in `at` to pop: the head of each heap whose keys the entry's drift has reached."""
        starts = np.cumsum(self.size) - self.size
        full = np.flatnonzero(self.size)
        hit = full[self.key[starts[full]] <= drift[full]]
        return np.concatenate([np.zeros(0, np.int64), *(np.arange(starts[e], starts[e] + np.searchsorted(self.key[starts[e] : starts[e] + self.size[e]], drift[e], "right")) for e in hit.tolist())])

    def entries(self) -> np.ndarray:
        """The entry of each place in `at`."""
        return np.repeat(np.arange(len(self.size)), self.size)

    def replace(self, places: np.ndarray, entry: np.ndarray, key: np.ndarray) -> None:
        """Takes the rows at `places` out and pushes them into the heaps of `entry`."""
        if not len(places):
            return
        rows = self.at[places]
        keep = np.ones(len(self.at), bool)
        keep[places] = False
        e = np.concatenate((self.entries()[keep], entry))
        k = np.concatenate((self.key[keep], key))
        order = np.lexsort((k, e))
        self.at, self.key = np.concatenate((self.at[keep], rows))[order], k[order]
        self.size = np.bincount(e, minlength=len(self.size))


class Block:
    """Rows of a partition: their parts, the heaps of each part position, and what the last step changed."""

    def __init__(self, x: np.ndarray, heaps: list[Heaps], books: np.ndarray, small: bool):
        self.x, self.heaps, self.books = x, heaps, books.astype(np.float64 if small else np.int64)
        self.delta = np.zeros((*books.shape[:2], 1 + books.shape[2]), np.int64)

    @classmethod
    def fresh(cls, x: np.ndarray, books: np.ndarray, small: bool) -> Block:
        out = cls(x, [], books, small)
        for p in range(len(books)):
            near, slack = scan(x[:, p].astype(out.books.dtype), out.books[p])
            order = np.lexsort((slack, near))
            out.heaps.append(Heaps(order, _down(slack[order]), np.bincount(near, minlength=books.shape[1])))
            out._moved(p, near, x[:, p], 1)
        return out

    @classmethod
    def read(cls, row: list[bytes], books: np.ndarray, small: bool) -> Block:
        parts, entries, width = books.shape
        x = np.frombuffer(row[0], np.int32).reshape(-1, parts, width)
        at, key, size = (np.frombuffer(b, t).reshape(parts, -1) for b, t in zip(row[1:4], (np.uint16, np.float32, np.int32), strict=True))
        return cls(x, [Heaps(at[p].astype(np.int64), key[p], size[p].astype(np.int64)) for p in range(parts)], books, small)

    def step(self, drift: np.ndarray) -> int:
        """Pops, rescans and pushes what `drift` has reached; returns how many parts that were."""
        n = 0
        for p, heap in enumerate(self.heaps):
            places = heap.violated(drift[p])
            n += len(places)
            if not len(places):
                continue
            part, was = self.x[heap.at[places], p], heap.entries()[places]
            near, slack = scan(part.astype(self.books.dtype), self.books[p])
            heap.replace(places, near, _down(slack + drift[p][near]))
            moved = near != was
            self._moved(p, was[moved], part[moved], -1)
            self._moved(p, near[moved], part[moved], 1)
        return n

    def _moved(self, p: int, entry: np.ndarray, part: np.ndarray, sign: int) -> None:
        for c in range(self.delta.shape[2]):
            w = None if c == 0 else part[:, c - 1].astype(np.float64)  # sums of a block stay below 2^53
            self.delta[p, :, c] += sign * np.rint(np.bincount(entry, weights=w, minlength=self.delta.shape[1])).astype(np.int64)

    def assigned(self) -> np.ndarray:
        """rows x parts: the entry of each part."""
        out = np.empty(self.x.shape[:2], np.int64)
        for p, heap in enumerate(self.heaps):
            out[heap.at, p] = heap.entries()
        return out

    def errors(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.x), np.int64)
        for p in range(code.shape[1]):
            d = self.x[:, p].astype(np.int64) - self.books[p].astype(np.int64)[code[:, p]]
            out += (d * d).sum(1)
        return out

    def columns(self) -> list[bytes]:
        return [
            self.x.astype(np.int32).tobytes(),
            np.concatenate([h.at for h in self.heaps]).astype(np.uint16).tobytes(),
            np.concatenate([h.key for h in self.heaps]).astype(np.float32).tobytes(),
            np.concatenate([h.size for h in self.heaps]).astype(np.int32).tobytes(),
            self.delta.tobytes(),
        ]


def _down(key: np.ndarray) -> np.ndarray:
    """Keys as float32, never above their value."""
    return np.nextafter(key.astype(np.float32), np.float32(-np.inf))


def _hex(code: np.ndarray) -> pa.Array:
    """Rows of small numbers as strings of two hexadecimal digits each."""
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    text = np.stack((digits[code >> 4], digits[code & 15]), 2).reshape(len(code), -1)
    at = np.arange(len(code) + 1, dtype=np.int32) * text.shape[1]
    return pa.StringArray.from_buffers(len(code), pa.py_buffer(at.tobytes()), pa.py_buffer(text.tobytes()))


def _sums(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """The changes of all blocks, added up: counts first, then component sums."""

    def work(batches):
        total = np.zeros(int(np.prod(shape)), np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += np.frombuffer(b.as_buffer(), np.int64)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], ["slot", "value"])

    rows = state.select("delta").mapInArrow(work, "slot int, value long").groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    out = np.zeros(int(np.prod(shape)), object)
    for r in rows:
        out[r.slot] = int(r.value)
    return out.reshape(shape)


def _update(books: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries as floored means of their parts, and how far the bound of each entry's heap drifts."""
    new = books.copy()
    for p, e in zip(*np.nonzero(sums[:, :, 0]), strict=True):
        new[p, e] = [s // sums[p, e, 0] for s in sums[p, e, 1:]]
    moved = np.sqrt(((new - books).astype(np.float64) ** 2).sum(2))
    order = np.sort(moved, axis=1)
    longest = np.repeat(order[:, -1:], moved.shape[1], axis=1)
    if moved.shape[1] > 1:  # the farthest one drifts against the second farthest
        longest[np.arange(len(moved)), moved.argmax(1)] = order[:, -2]
    return new, (moved + longest) * (1 + 1e-12)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE, rounds: int = 2, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """k (the key), l (the label), code and error of every row that takes part, in a written table; and the
    codebooks (parts x entries x width)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hexadecimal digits names 1 to 256 entries")
    spark = df.sparkSession
    good = integers(df, key, vector, label, scale)
    tmp = Scratch(spark, "vector-codes")
    dims = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).orderBy(F.desc("n"), "d").first()
    out_schema = T.StructType([T.StructField("k", good.schema["k"].dataType), T.StructField("l", good.schema["l"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if dims is None:
        return spark.createDataFrame([], out_schema), np.zeros((parts, 0, 0), np.int64)
    dim, most = dims["d"], dims["most"] or 0.0
    width = max(1, -(-dim // parts))
    bound = 4.0 * (most + 1) ** 2 * width * parts
    if bound >= 2**62 or most >= 2**30:
        raise ValueError("components are too large for exact squared distances of 64 bits")
    small = bound < 2**52
    good = good.where(F.size("v") == dim)

    def cut(flat: np.ndarray) -> np.ndarray:
        x = np.zeros((len(flat), parts * width), np.int32)
        x[:, :dim] = flat
        return x.reshape(-1, parts, width)

    start = good.select("k", "v").orderBy(F.asc_nulls_last("k"), "v").limit(entries).collect()
    books = cut(np.array([r.v for r in start], np.float64).reshape(len(start), dim)).transpose(1, 0, 2).astype(np.int64)
    shape = (parts, len(start), 1 + width)
    block_rows = max(16, min(block_rows, 1 << 16, BLOCK_BYTES // (4 * parts * width)))
    carried = [T.StructField(c, T.ArrayType(good.schema[c].dataType)) for c in ("k", "l")]
    state_schema = T.StructType([*carried, *(T.StructField(c, T.BinaryType()) for c in STATE)])
    names = state_schema.names

    def first(batches):
        def block(table: pa.Table, books=books):
            flat = np.asarray(table.column("v").combine_chunks().flatten()).reshape(len(table), dim)
            b = Block.fresh(cut(flat), books, small)
            at = pa.array([0, len(table)], pa.int32())
            lists = [pa.ListArray.from_arrays(at, table.column(c).combine_chunks()) for c in ("k", "l")]
            return pa.RecordBatch.from_arrays([*lists, *(pa.array([c], pa.binary()) for c in b.columns())], names)

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, block_rows - n)
                held.append(take)
                n += take.num_rows
                batch = batch.slice(take.num_rows)
                if n == block_rows:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    def stepped(books: np.ndarray, drift: np.ndarray, last: bool):
        def work(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    b = Block.read([batch.column(c)[r].as_buffer() for c in range(2, 6)], books, small)
                    b.step(drift)
                    if last:
                        code = b.assigned()
                        yield pa.RecordBatch.from_arrays([*(batch.column(c)[r].values for c in (0, 1)), _hex(code), pa.array(b.errors(code))], out_schema.names)
                    else:
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), batch.column(1).slice(r, 1), *(pa.array([c], pa.binary()) for c in b.columns())], names)

        return work

    state = tmp.save(good.mapInArrow(first, state_schema), "blocks")
    sums, drift = np.zeros(shape, object), np.zeros(shape[:2])
    for k in range(rounds):
        sums = sums + _sums(state, shape)
        books, moved = _update(books, sums)
        drift = drift + moved
        last = k + 1 == rounds
        new = tmp.save(state.mapInArrow(stepped(books, drift, last), out_schema if last else state_schema), "codes" if last else "blocks")
        tmp.drop(state)
        state = new
    if not rounds:
        state = tmp.save(state.mapInArrow(stepped(books, drift - 1, True), out_schema), "codes")
    return state, books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def digest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256. The errors of a label are added up before they
    are shuffled and saved before they meet the rows, so that a hot label can be split."""
    rows, books = compress(df, key, vector, label)
    tmp = Scratch(df.sparkSession, "label-errors")
    by_label = tmp.save(rows.groupBy(F.col("l").alias("m")).agg(F.sum("error").alias("label_error")), "labels")
    return rows.join(by_label, F.col("l").eqNullSafe(F.col("m"))).select(F.col("k").alias(key), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql_round(k: int) -> str:
    """One assignment and one update after codebook `b{k}`."""
    return f"""
     d{k} AS (SELECT q.id, q.p, arg_min(b.e, list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 64 + b.e) AS e FROM q JOIN b{k} b USING (p) GROUP BY ALL),
     m{k} AS MATERIALIZED (SELECT p, e, c, CAST(floor(sum(q.x[c]) / count(*)) AS BIGINT) AS y FROM d{k} JOIN q USING (id, p), unnest(range(1, len(q.x) + 1)) AS t(c) GROUP BY ALL),
     b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT p, e, list(y ORDER BY c) AS x FROM m{k} GROUP BY ALL) m USING (p, e))"""


ORACLE = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
     q AS MATERIALIZED (SELECT id, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM v, range(16) AS t(p)),
     b0 AS MATERIALIZED (SELECT p, id AS e, x FROM q WHERE id < 64),{_sql_round(0)},{_sql_round(1)},
     f AS (SELECT q.id, q.p, arg_min(b.e, dist * 64 + b.e) AS e, min(dist) AS dist FROM (SELECT q.id, q.p, b.e, list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS dist FROM q JOIN b2 b USING (p)) q JOIN b2 b ON b.p = q.p AND b.e = q.e GROUP BY ALL),
     r AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM f GROUP BY id),
     s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN r USING (id), s
"""
