"""k-mer spectra and what is computed from them: entropy, occupancy, distances, skews, dependency."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from strandline.functions import kernels as K
from strandline.functions import profile
from strandline.functions.symbols import count_of
from strandline.operators import tiles as T
from strandline.sources.shared import saved

BLOCK_BYTES, LIST_BYTES = 1 << 25, 1 << 26  # of the vectors of a block of records; of lists of words
LEAST_ROWS, LEAST_BLOCKS = 32, 12  # few records make blocks of fewer rows, down to these
OUT_ROWS = 1 << 16  # of a batch of pairs
MEETING = 2048  # rows of a block at most, so a meeting has some 4 million pairs
PAGE, KINDS, CELL = 20_000, 131_000, 12_000  # rows of a page, doubles of a dictionary, and those that pay in a page
LAGS = (1, 2, 3, 6, 9, 12, 30, 100, 300, 1000, 3000, 10000)


def log2(x: Column) -> Column:
    return F.log2(x)


def entropy(counts: DataFrame, *keys: str, cnt: str = "cnt") -> DataFrame:
    """keys..., entropy in bits and the number of distinct words; from -sum p log2 p, in one pass."""
    c = F.col(cnt).cast("double")
    s = F.sum(c)
    return counts.where(F.col(cnt) > 0).groupBy(*keys).agg((log2(s) - F.sum(c * log2(c)) / s).alias("entropy"), F.count(F.lit(1)).alias("distinct"))


def kmer_entropy(df: DataFrame, k: int, keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """keep..., entropy_bits, entropy_norm (over 2k), occupancy (distinct over 4^k)."""
    e = entropy(T.kmer_counts(df, k, keep=keep), *keep)
    return e.select(*keep, F.col("entropy").alias("entropy_bits"), (F.col("entropy") / (2 * k)).alias("entropy_norm"), (F.col("distinct") / F.lit(float(4**k))).alias("occupancy"))


def kmer_vectors(df: DataFrame, k: int, keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """keep..., kmer, p: dense, every word of every key; uniform where there is no word."""
    counts = T.kmer_counts(df, k, keep=keep)
    words = F.array_sort(F.array(*(F.lit(w) for w in _words(k))))
    keys = df.select(*keep).distinct().withColumn("kmer", F.explode(words))
    total = F.sum(F.coalesce("cnt", F.lit(0))).over(Window.partitionBy(*keep))
    return keys.join(counts, [*keep, "kmer"], "left").select(*keep, "kmer", F.when(total > 0, F.coalesce("cnt", F.lit(0)) / F.nullif(total, F.lit(0))).otherwise(F.lit(1.0 / 4**k)).alias("p"))


def _words(k: int) -> list[str]:
    out = [""]
    for _ in range(k):
        out = [w + b for w in out for b in "ACGT"]
    return out


def fisher_rao(p: Column, q: Column) -> Column:
    """An aggregate over the words of two distributions."""
    inner = F.sum(F.sqrt(p * q)) / F.sqrt((F.sum(p) + 1e-15) * (F.sum(q) + 1e-15))
    return 2 * F.acos(F.greatest(F.lit(0.0), F.least(F.lit(1.0), inner)))


def hellinger(p: Column, q: Column) -> Column:
    return F.sqrt(F.sum(F.pow(F.sqrt(p) - F.sqrt(q), 2)) / 2)


def fisher_to_uniform(df: DataFrame, k: int = 2, keep: tuple[str, ...] = ("name",)) -> DataFrame:
    v = kmer_vectors(df, k, keep)
    return v.groupBy(*keep).agg(fisher_rao(F.col("p"), F.lit(1.0 / 4**k)).alias("fisher_to_uniform"))


def fisher_to_centroid(df: DataFrame, k: int = 2, keep: tuple[str, ...] = ("name",), by: tuple[str, ...] = ()) -> DataFrame:
    """Distance of each key to the renormalised mean vector; the centroid has 4^k rows. With `by`, columns of
    `keep`, a key is held against the mean of its own group; there may be many groups, so nothing is broadcast."""
    v = kmer_vectors(df, k, keep)
    if by:
        mean = v.groupBy(*by, "kmer").agg(F.avg("p").alias("q"))
        mean = mean.withColumn("q", F.col("q") / F.sum("q").over(Window.partitionBy(*by)))
        return v.join(mean, [*by, "kmer"]).groupBy(*keep).agg(fisher_rao(F.col("p"), F.col("q")).alias("fisher_to_centroid"))
    mean = v.groupBy("kmer").agg(F.avg("p").alias("q"))
    mean = mean.crossJoin(F.broadcast(mean.agg(F.sum("q").alias("t")))).select("kmer", (F.col("q") / F.col("t")).alias("q"))
    return v.join(F.broadcast(mean), "kmer").groupBy(*keep).agg(fisher_rao(F.col("p"), F.col("q")).alias("fisher_to_centroid"))


def _pair_tiles(vectors: DataFrame, schema: str, compare, block: int = 512, pack=list, room: int = BLOCK_BYTES, millionths: bool = False, together: int = 1) -> DataFrame:
    """What `compare(x, y)` gives, as columns, for the pairs a < b of names: the rows (name, v) are dealt to ranges of
    their kind, size and name, as far as they have them, cut into blocks of about `block` rows and `room` bytes and at
    most half as much again, and written once as one row a block. Every two block rows meet in a task, one after the
    other; where there are many, a task reads up to `together` blocks of one side. All pairs are the result; those of a
    meeting are alike, and leave it in the order of `_dealt`. `compare` gets the bytes that `pack` makes, once, of the
    vectors of a block, and gives a mask and columns; with `millionths`, doubles are rounded to six places."""
    vectors = saved(vectors)
    told = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("v")), F.lit(0)).alias("bytes")).first()
    block = min(block, max(LEAST_ROWS, -(-told.n // LEAST_BLOCKS)))
    blocks = max(1, -(-told.n // block), -(-told.bytes // room))
    most_rows, most_bytes = block + block // 2, room + room // 2

    def cut(batches):
        part, done, names, held, size = TaskContext.get().partitionId() << 32, 0, [], [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([part + done]), pa.array([names], pa.list_(pa.string())), pa.array([pack(held)], pa.list_(pa.binary()))], ["t", "n", "v"])
        for batch in batches:
            for name, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if names and (len(names) == most_rows or size + len(v) > most_bytes):
                    yield row()
                    done, names, held, size = done + 1, [], [], 0
                names.append(name)
                held.append(v)
                size += len(v)
        if names:
            yield row()

    ranges = vectors.repartitionByRange(int(blocks), *(c for c in ("kind", "size", "name") if c in vectors.columns)).sortWithinPartitions("name")
    held = saved(ranges.select("name", "v").mapInArrow(cut, "t long, n array<string>, v array<binary>"))
    n = max(1, held.count())
    together = max(1, min(together, n // LEAST_BLOCKS * 2))
    side = lambda k, parts: held.repartitionByRange(parts, "t").select(*(F.col(c).alias(f"{c}{k}") for c in "tnv"))
    # of the two orders in which two blocks meet, one is drawn, so that all tasks have about as many
    drawn = F.pmod(F.xxhash64("t1").bitwiseXOR(F.xxhash64("t2")), F.lit(2)) == 0
    pairs = side(1, -(-n // together)).join(side(2, n).hint("shuffle_replicate_nl"), (F.col("t1") == F.col("t2")) | ((F.col("t1") < F.col("t2")) == drawn))
    out = ST._parse_datatype_string("a string, b string, " + schema)
    kinds = {"bigint": pa.int64(), "double": pa.float64()}

    def tile(batches):
        for batch in batches:
            t1, n1, v1, t2, n2, v2 = batch.columns
            for r in range(batch.num_rows):
                meet = [(n1[r].values, v1[r].as_py()), (n2[r].values, v2[r].as_py())]
                (low, x), (high, y) = meet if t1[r].as_py() <= t2[r].as_py() else meet[::-1]
                mask, columns = compare(x, y)
                names = pa.concat_arrays([low, high])
                rank = np.unique(names.to_numpy(zero_copy_only=False), return_inverse=True)[1]
                before = rank[: len(low), None] < rank[None, len(low) :]
                after = mask & (rank[: len(low), None] > rank[None, len(low) :]) if t1[r] != t2[r] else None
                exact = [f.name for f in out.fields[2:] if millionths and f.dataType == ST.DoubleType()]
                columns = {c: (_millionths(v) if c in exact else v).ravel() for c, v in columns.items()}
                at, first = _dealt(mask & before, after, [columns[c] for c in exact])
                for lo in range(0, len(at), OUT_ROWS):
                    k, near = at[lo : lo + OUT_ROWS], first[lo : lo + OUT_ROWS]
                    i, j = k // len(high), k % len(high) + len(low)
                    values = [columns[f.name][k] / 1e6 if f.name in exact else columns[f.name][k] for f in out.fields[2:]]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.where(near, i, j))), names.take(pa.array(np.where(near, j, i))), *map(pa.array, values, (kinds[f.dataType.simpleString()] for f in out.fields[2:]))], out.names)

    return pairs.select("t1", "n1", "v1", "t2", "n2", "v2").mapInArrow(tile, out)


def _millionths(x: np.ndarray) -> np.ndarray:
    """Whole millionths that Spark's round(x, 6) gives, which goes by way of decimal text, for x from 0 to 1000; only
    near ties go that way."""
    at = x * 1e6
    low = np.floor(at)
    at -= low
    out = (low + (at >= 0.5)).astype(np.int32)
    at -= 0.5
    near = np.flatnonzero(np.abs(at, out=at) <= 1e-6)
    out.ravel()[near] = [int(Decimal(repr(v)).scaleb(6).to_integral_value(ROUND_HALF_UP)) for v in x.ravel()[near].tolist()]
    return out


def _dealt(before: np.ndarray, after: np.ndarray | None, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places (row by row) of a meeting's pairs in the order of writing, and whether the row's name is the a of it.
    `values` are whole numbers at all places. The one of most kinds is sorted, so that equal ones make runs; a Parquet
    column of another keeps its dictionary if that pays in its first page, of `PAGE` rows, and up to `KINDS` doubles, so
    pairs of its commonest values lead, and those of values too many come last. Without values, a stays over runs."""
    at, first = np.flatnonzero(before), np.ones(np.count_nonzero(before), bool)
    if after is not None:
        turned = np.flatnonzero(after.T)
        at = np.concatenate((at, turned % len(after) * after.shape[1] + turned // len(after)))
        first = np.concatenate((first, np.zeros(len(turned), bool)))
    if not values or not len(at):
        return at, first
    kinds = [np.count_nonzero(np.bincount(v[at])) for v in values]
    lead = kinds.index(max(kinds))
    key = values[lead][at].astype(np.int64) << 40 | np.arange(len(at))
    key.sort()
    key &= (1 << 40) - 1
    at, first = at[key], first[key]
    turn = np.ones(len(at), np.uint8)
    for v in (v[at] for k, v in enumerate(values) if k != lead):
        n = np.bincount(v)
        some = np.flatnonzero(n)
        if len(some) > KINDS:
            c = np.concatenate(([0], np.cumsum(n[some])))
            k = np.argmax(c[KINDS:] - c[:-KINDS])
            turn[(v < some[k]) | (v > some[k + KINDS - 1])] = 2
        cell = np.add.reduceat(n, np.arange(0, len(n), CELL))
        turn[np.flatnonzero(v // CELL == cell.argmax())[: PAGE + PAGE // 4]] = 0
    order = np.argsort(turn, kind="stable")
    return at[order], first[order]


def _vectors(df: DataFrame, make, size=len) -> DataFrame:
    """name, kind (the type, if there is one), the bytes that `make` gives for a sequence's codes, and their `size`."""

    def work(batches):
        for pdf in batches:
            made = [make(K.encode(s, drop=False)) for s in pdf.sequence.fillna("")]
            yield pd.DataFrame({"name": pdf.name, "kind": pdf.kind, "size": [int(size(v)) for v in made], "v": [v.tobytes() for v in made]})

    kind = F.col("organism_type").cast("string") if "organism_type" in df.columns else F.lit(None).cast("string")
    return df.select("name", kind.alias("kind"), "sequence").mapInPandas(work, "name string, kind string, size int, v binary")


def _ones(bits: np.ndarray) -> int:
    return np.bitwise_count(bits).sum(dtype=np.int64)


def _roots(a: np.ndarray, k: int) -> np.ndarray:
    n = profile.counts(a, k)
    return np.sqrt(n / max(1, n.sum()))


def _angles(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which two rows of roots of shares have a common word, and their distance."""
    s = x @ y.T
    mask = s > 0
    s = np.arccos(np.clip(s, -1, 1, out=s), out=s)
    s *= 2
    return mask, s


def fisher_matrix(df: DataFrame, k: int = 3, millionths: bool = False) -> DataFrame:
    """a, b, distance for a < b over the names, for pairs with a common word; with `millionths`, to six places."""

    def compare(x, y):
        mask, distance = _angles(*(np.frombuffer(z[0]).reshape(-1, 4**k) for z in (x, y)))
        return mask, {"distance": distance}

    return _pair_tiles(_vectors(df, lambda a: _roots(a, k)), "distance double", compare, MEETING, lambda z: [b"".join(z)], millionths=millionths)


def pairs_of_records(df: DataFrame, jaccard_k: int = 7, k: int = 3, millionths: bool = False) -> DataFrame:
    """a, b, jaccard, fisher_rao for every pair with a common word of `k`: both in one meeting of two blocks.
    `jaccard_k` is ten at most. With `millionths`, both are to six places."""
    if jaccard_k > 10:
        raise ValueError("sets of bits are of words of ten symbols at most")
    size = 8 * 4**k

    def make(a: np.ndarray) -> np.ndarray:
        return np.concatenate((_roots(a, k).view(np.uint8), np.packbits(profile.counts(a, jaccard_k) > 0)))

    def pack(z):
        return [b"".join(v[:size] for v in z), *_word_rows([v[size:] for v in z])]

    def compare(x, y):
        mask, distance = _angles(*(np.frombuffer(z[0]).reshape(-1, 4**k) for z in (x, y)))
        shared, m, n = _shared(x[1:], y[1:])
        return mask, {"jaccard": _over_union(shared, m, n), "fisher_rao": distance}

    return _pair_tiles(_vectors(df, make, lambda v: _ones(v[size:])), "jaccard double, fisher_rao double", compare, _bit_block(jaccard_k), pack, millionths=millionths)


def _over_union(shared: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    union = x[:, None] + y
    union -= shared
    return shared / np.maximum(union, 1, out=union)


def _bit_block(k: int) -> int:
    return max(8, min(MEETING, (1 << 24) // 4**k * 8))


def _word_rows(sets: list[bytes]) -> list[bytes]:
    """Of sets of bits: a row of packed bits for each word, and how many words each set has."""
    bits = np.unpackbits(np.stack([np.frombuffer(v, np.uint8) for v in sets]), axis=1)
    return [np.packbits(bits, axis=0).T.tobytes(), bits.sum(1, dtype=np.int64).tobytes()]


def _shared(x: list[bytes], y: list[bytes], dense: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common elements of every two sets of two blocks of `_word_rows`, and their sizes. A word of up to `dense` pairs
    counts them; one of more is a column of a 0/1 matrix, whose sums, up to 2^24, are exact in single precision."""
    m, n = (np.frombuffer(z[1], np.int64) for z in (x, y))
    p, q = (np.frombuffer(z[0], np.uint8).reshape(-1, -(-len(size) // 8)) for z, size in ((x, m), (y, n)))
    nx, ny = (np.bitwise_count(z).sum(1, dtype=np.int64) for z in (p, q))
    pairs = nx * ny
    dense = max(300, len(m) * len(n) // 384) if dense is None else dense
    shared, many = np.zeros((len(m), len(n)), np.float32), np.flatnonzero(pairs > dense)
    bits = lambda w: (np.unpackbits(z[w], axis=1, count=len(size)) for z, size in ((p, m), (q, n)))
    for a in range(0, len(many), 1 << 11):
        left, right = (z.astype(np.float32) for z in bits(many[a : a + (1 << 11)]))
        shared += left.T @ right
    shared, few = shared.astype(np.int64), np.flatnonzero((pairs > 0) & (pairs <= dense))
    for a in range(0, len(few), 1 << 13):
        w = few[a : a + (1 << 13)]
        (word, ox), (_, oy) = (np.nonzero(z) for z in bits(w))
        times = ny[w][word]
        at = np.repeat(ox * len(n), times) + oy[_runs((np.cumsum(ny[w]) - ny[w])[word], times)]
        shared += np.bincount(at, minlength=shared.size).reshape(shared.shape)
    return shared, m, n


def _word_set(a: np.ndarray, k: int) -> np.ndarray:
    """Distinct words of a sequence as numbers: up to 31 symbols in base 4, longer ones by a hash of 64 bits."""
    n = len(a) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, odd = np.zeros(n, np.uint64), np.zeros(n, bool)
    base = np.uint64(4 if k <= 31 else 0x9E3779B97F4A7C15)
    for j in range(k):
        part = a[j : j + n]
        out = out * base + (part + np.uint64(k > 31))
        odd |= part > 3
    return np.unique(out[~odd])


def _word_lists(sets: list[np.ndarray]) -> list[bytes]:
    """Of sorted sets of words, below 2^16 of them: the distinct words, how many sets have each, the numbers of these
    sets, word by word, the same as rows of bits for words of so many sets that these are shorter, and how many words
    each set has."""
    size = np.array([len(w) for w in sets], np.int64)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16), size)
    words = np.concatenate(sets)
    if words.itemsize <= 4:
        both = words.astype(np.uint64) << np.uint64(16) | owner
        both.sort()
        words, owner = (both >> np.uint64(16)).astype(words.dtype), both.astype(np.uint16)
    else:
        order = np.argsort(words, kind="stable")
        words, owner = words[order], owner[order]
    first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(words)))
    many = np.flatnonzero(count > len(sets) // 16)
    bits = []
    for a in range(0, len(many), 1 << 13):
        w = many[a : a + (1 << 13)]
        row = np.zeros((len(w), len(sets)), np.uint8)
        row[np.repeat(np.arange(len(w)), count[w]), owner[_runs(first[w], count[w])]] = 1
        bits.append(np.packbits(row, axis=1).tobytes())
    few = np.repeat(count <= len(sets) // 16, count)
    return [words[first].tobytes(), count.astype(np.uint16).tobytes(), owner[few].tobytes(), b"".join(bits), size.tobytes()]


class _Owners:
    """Which sets of a block of `_word_lists` have its words that stand at `at`."""

    def __init__(self, count: np.ndarray, lists: np.ndarray, bits: np.ndarray, sets: int, at: np.ndarray):
        many = count > sets // 16
        listed = np.where(many, 0, count).astype(np.int64)
        self.sets, self.lists, self.bits = sets, lists, bits.reshape(-1, -(-sets // 8))
        self.count, self.many = count[at].astype(np.int64), many[at]
        self.first = np.where(self.many, (np.cumsum(many) - many)[at], (np.cumsum(listed) - listed)[at])

    def _parts(self, w: np.ndarray):
        many = np.flatnonzero(self.many[w])
        few = np.flatnonzero(~self.many[w])
        rows = np.unpackbits(self.bits[self.first[w[many]]], axis=1, count=self.sets)
        return many, rows, few, self.lists[_runs(self.first[w[few]], self.count[w[few]])]

    def matrix(self, w: np.ndarray) -> np.ndarray:
        """A row of 0/1 for each word."""
        many, rows, few, lists = self._parts(w)
        out = np.zeros((len(w), self.sets), np.float32)
        out[many] = rows
        out[np.repeat(few, self.count[w[few]]), lists] = 1
        return out

    def numbers(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the sets, word by word, and where each word's begin."""
        many, rows, few, lists = self._parts(w)
        size = self.count[w]
        first = np.cumsum(size) - size
        out = np.empty(size.sum(), np.int64)
        out[_runs(first[few], size[few])] = lists
        out[_runs(first[many], size[many])] = np.flatnonzero(rows.view(bool)) % self.sets
        return out, first


def _met(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in two sorted lists of distinct words their common ones stand. Two runs are merged by a stable sort."""
    both = np.concatenate((x, y))
    if both.itemsize <= 4 and (not len(both) or both.max() < 1 << 31):
        both <<= np.uint32(1)
        both[len(x) :] |= np.uint32(1)
        both.sort(kind="stable")
        at = np.flatnonzero((both[1:] ^ both[:-1]) == 1)
        right = np.cumsum(both & np.uint32(1), dtype=np.int64)[at]
        return at - right, right
    order = np.argsort(both, kind="stable")
    at = np.flatnonzero(both[order[1:]] == both[order[:-1]])
    return order[at], order[at + 1] - len(x)


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., `size` of them, one run after the other."""
    out = np.repeat(first - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def _shared_words(x: list[np.ndarray], y: list[np.ndarray], dense: int | None = None, most: int = 1 << 21) -> np.ndarray:
    """Common elements of every two of two lists of sorted sets."""
    return _shared_lists(_word_lists(x), _word_lists(y), x[0].dtype, dense, most)[0]


def _shared_lists(x: list[bytes], y: list[bytes], number=np.uint32, dense: int | None = None, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common elements of every two sets of two blocks of `_word_lists`, and their sizes. Only words that both blocks
    have are looked at: one of few sets counts its pairs, at most about `most` at once; one of more than `dense` pairs
    is a column of a 0/1 matrix, whose sums, up to 2^24, are exact in single precision."""
    kinds = (number, np.uint16, np.uint16, np.uint8, np.int64)
    (ux, cx, lx, bx, m), (uy, cy, ly, by, n) = ([np.frombuffer(v, t) for v, t in zip(z, kinds, strict=True)] for z in (x, y))
    i, j = _met(ux, uy)
    p, q = _Owners(cx, lx, bx, len(m), i), _Owners(cy, ly, by, len(n), j)
    dense = len(m) * len(n) // 384 if dense is None else dense
    pairs = p.count * q.count
    shared, many = np.zeros((len(m), len(n)), np.float32), np.flatnonzero(pairs > dense)
    for a in range(0, len(many), 1 << 11):
        w = many[a : a + (1 << 11)]
        shared += p.matrix(w).T @ q.matrix(w)
    shared, few = shared.astype(np.int64), np.flatnonzero(pairs <= dense)
    cuts = np.unique(np.searchsorted(np.cumsum(pairs[few]), np.arange(0, pairs[few].sum(), most), "left"))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(few)], strict=True) if len(few) else ():
        w = few[a:b]
        (ox, _), (oy, first) = p.numbers(w), q.numbers(w)
        times = np.repeat(q.count[w], p.count[w])
        at = np.repeat(ox * len(n), times)
        at += oy[_runs(np.repeat(first, p.count[w]), times)]
        shared += np.bincount(at, minlength=shared.size).reshape(shared.shape)
    return shared, m, n


def jaccard(df: DataFrame, k: int = 7, millionths: bool = False) -> DataFrame:
    """a, b, shared, jaccard for a < b, pairs without a shared word left out (their value is 0). Up to ten symbols
    a sequence is a set of bits, one for each of the 4^k words; beyond, it is the sorted list of its words, and a block
    is laid out by word once. With `millionths`, jaccard is to six places."""
    schema = "shared long, jaccard double"

    def result(shared, x, y):
        return shared > 0, {"shared": shared, "jaccard": _over_union(shared, x, y)}

    def bits(x, y):
        return result(*_shared(x, y))

    number = np.uint32 if k <= 16 else np.uint64

    def pack(z):
        return _word_lists([np.frombuffer(v, number) for v in z])

    def lists(x, y):
        return result(*_shared_lists(x, y, number))

    if k <= 10:
        return _pair_tiles(_vectors(df, lambda a: np.packbits(profile.counts(a, k) > 0), _ones), schema, bits, _bit_block(k), _word_rows, millionths=millionths)
    return _pair_tiles(_vectors(df, lambda a: _word_set(a, k).astype(number)), schema, lists, 1024, pack, LIST_BYTES, millionths, 4)


def dinucleotide_rho(df: DataFrame, keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """keep..., pair, rho, present: all 16 pairs, with guards of 1e-15 against empty counts."""
    mono = df.select(*keep, *(count_of(F.col("sequence"), b).alias(b) for b in "ACGT"), F.length("sequence").alias("n"))
    pairs = T.kmer_counts(df, 2, keep=keep)
    grid = mono.withColumn("pair", F.explode(F.array(*(F.lit(w) for w in _words(2)))))
    total = F.sum(F.coalesce("cnt", F.lit(0))).over(Window.partitionBy(*keep))
    of = lambda i: F.element_at(F.create_map(*[x for b in "ACGT" for x in (F.lit(b), F.col(b))]), F.substring("pair", i, 1))
    s = F.col("A") + F.col("C") + F.col("G") + F.col("T") + F.lit(1e-15)
    g = grid.join(pairs.withColumnRenamed("kmer", "pair"), [*keep, "pair"], "left")
    g = g.select(*keep, "pair", "n", of(1).alias("x"), of(2).alias("y"), s.alias("s"), F.coalesce("cnt", F.lit(0)).alias("cnt"), total.alias("total"))
    f = F.col("cnt") / (F.col("total") + 1e-15)
    exact = F.try_divide(F.col("cnt") / F.greatest(F.col("n") - 1, F.lit(1)), (F.col("x") / F.greatest(F.col("n"), F.lit(1))) * (F.col("y") / F.greatest(F.col("n"), F.lit(1))))
    return g.select(*keep, "pair", (f / ((F.col("x") / F.col("s")) * (F.col("y") / F.col("s")) + 1e-15)).alias("rho"), exact.alias("rho_exact"), ((F.col("x") > 0) & (F.col("y") > 0)).alias("present"))


def rho_summary(df: DataFrame, keep: tuple[str, ...] = ("name",)) -> DataFrame:
    r = dinucleotide_rho(df, keep)
    first = lambda sign: F.struct(F.col("rho") * sign, F.col("pair"))  # noqa: E731  ties: the first pair in order
    return r.groupBy(*keep).agg(
        F.avg(F.when(F.col("present"), F.abs(F.col("rho_exact") - 1))).alias("dinu_rho_dev"), F.avg(F.abs(F.col("rho") - 1)).alias("rho_mean_deviation"),
        F.min(first(-1)).getField("pair").alias("most_over"), F.min(first(1)).getField("pair").alias("most_under"),
    )


def gc_skew(df: DataFrame, keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """Means over max(100, n / 32)-symbol tiles; keys shorter than 1000 are NULL."""
    t = T.tiles(df.where(F.length("sequence") >= 1000), T.skew_size(F.length("sequence")), T.skew_size(F.length("sequence")), keep=keep)
    g, c = count_of(F.col("piece"), "G"), count_of(F.col("piece"), "C")
    v = t.select(*keep, ((g - c) / F.greatest(g + c, F.lit(1))).alias("v"))
    got = v.groupBy(*keep).agg(F.avg("v").alias("gc_skew_mean"), F.stddev_pop("v").alias("gc_skew_std"), F.max(F.abs("v")).alias("gc_skew_max_abs"))
    return df.select(*keep).join(got, list(keep), "left")


def skew_analysis(df: DataFrame, window: int = 10_000) -> DataFrame:
    """GC and AT skew over half-overlapping windows; windows without the bases are left out."""
    t = T.tiles(df, window, window // 2)
    a, c, g, t_ = (count_of(F.col("piece"), b) for b in "ACGT")
    v = t.select("name", F.try_divide((g - c).cast("double"), (g + c).cast("double")).alias("gc"), F.try_divide((a - t_).cast("double"), (a + t_).cast("double")).alias("at"))
    got = v.groupBy("name").agg(F.avg("gc").alias("gc_skew_mean"), F.stddev_pop("gc").alias("gc_skew_std"), F.max(F.abs("gc")).alias("gc_skew_max_abs"), F.avg("at").alias("at_skew_mean"))
    return df.select("name").join(got, "name", "left")


def phase3(df: DataFrame, keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """GC share at every third place: spread, entropy and range of the three phases."""
    s = T.symbols(df.where(F.length("sequence") >= 90), keep=keep)
    means = s.groupBy(*keep, (F.col("pos") % 3).alias("phase")).agg(F.avg(F.when(F.col("base").isin("C", "G"), 1.0).otherwise(0.0)).alias("m"))
    p = F.col("m") / (F.sum("m").over(Window.partitionBy(*keep)) + 1e-15)
    e = means.select(*keep, "m", F.when(p > 0, -p * F.log2(F.nullif(p, F.lit(0.0)))).alias("h"))
    got = e.groupBy(*keep).agg(F.stddev_pop("m").alias("phase3_strength"), (F.coalesce(F.sum("h"), F.lit(0.0)) / F.log2(F.lit(3.0))).alias("phase3_entropy"), (F.max("m") - F.min("m")).alias("phase3_gc_delta"))
    return df.select(*keep).join(got, list(keep), "left")


def patch_inconsistency(df: DataFrame, k: int = 3) -> DataFrame:
    """Mean Hellinger distance of each patch's word vector to that of its whole sequence."""
    patches = T.tiles(df, T.patch_size(F.length("sequence"))).select(F.concat_ws("\x1f", "name", "tile").alias("patch"), "name", F.col("piece").alias("sequence"))
    local = kmer_vectors(patches, k, ("name", "patch"))
    whole = kmer_vectors(df, k).select("name", "kmer", F.col("p").alias("q"))
    d = local.join(whole, ["name", "kmer"]).groupBy("name", "patch").agg(hellinger(F.col("p"), F.col("q")).alias("d"))
    return df.select("name").join(d.groupBy("name").agg(F.avg("d").alias("patch_kmer_inconsistency")), "name", "left")


def triple_obstruction(df: DataFrame, size: Column | int | None = None, step: Column | int | None = None) -> DataFrame:
    """Mean |cos(a,b) cos(b,c) - cos(a,c)| over consecutive patches. A patch's vector holds its 3-mer
    shares in order of first appearance, cut to the shortest of the three."""
    size = F.least(F.lit(200), F.floor(F.length("sequence") / 50)).cast("int") if size is None else size
    step = size - F.floor(size / 2).cast("int") if step is None else step
    rows = df.select("name", "sequence", (F.lit(size) if isinstance(size, int) else size).cast("int").alias("size"), (F.lit(step) if isinstance(step, int) else step).cast("int").alias("step"))

    def work(batches):
        for pdf in batches:
            found = [_triples(K.encode(s, drop=False), int(w), int(d)) if s is not None else None for s, w, d in zip(pdf.sequence, pdf["size"].fillna(0), pdf.step.fillna(0), strict=True)]
            yield pd.DataFrame({"name": pdf.name, "h1_obstruction": pd.Series(found, dtype=float, index=pdf.index)})

    return rows.mapInPandas(work, "name string, h1_obstruction double")


def _triples(a: np.ndarray, size: int, step: int, slab: int = 2048) -> float | None:
    """triple_obstruction of one sequence's codes, `slab` patches at a time."""
    if size < 3 or step < 1 or len(a) < size:
        return None
    words = np.lib.stride_tricks.sliding_window_view(K.kmer_codes(a, 3), size - 2)[::step]
    total, count = 0.0, 0
    for lo in range(0, len(words) - 2, slab):
        w = words[lo : lo + slab + 2]
        row, at = np.nonzero(w >= 0)
        word = w[row, at]
        n = np.bincount(row * 64 + word, minlength=64 * len(w)).reshape(-1, 64).astype(float)
        first = np.full((len(w), 64), size)
        np.minimum.at(first, (row, word), at)
        n = np.take_along_axis(n, np.argsort(first, axis=1), axis=1)  # words that do not occur stand last, as zeros
        kinds = (n > 0).sum(1)
        least = np.minimum(np.minimum(kinds[:-2], kinds[1:-1]), kinds[2:])
        x, y, z = (np.where(np.arange(64) < least[:, None], v, 0.0) for v in (n[:-2], n[1:-1], n[2:]))
        cos = lambda p, q: (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1)) + 1e-15)
        own = np.abs(cos(x, y) * cos(y, z) - cos(x, z))[least > 0]
        total, count = total + own.sum(), count + len(own)
    return total / count if count else None


def degree_entropy(df: DataFrame, window: int = 60) -> DataFrame:
    """Entropy of the last place that isn't A over windows, as degrees of polynomials."""
    t = T.tiles(df, window).select("name", (F.length(F.rtrim(F.col("piece"), F.lit("A"))) - 1).alias("degree")).where("degree >= 0")
    e = entropy(t.groupBy("name", "degree").agg(F.count(F.lit(1)).alias("cnt")), "name")
    return df.select("name").join(e.select("name", F.col("entropy").alias("gf4_entropy")), "name", "left")


def mutual_information(df: DataFrame, lags: tuple[int, ...] = LAGS, keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """keep..., lag, mi in bits for every lag below the length. Each chunk meets the bytes that lie a lag
    further on, for all lags in one scan, so no sequence is sorted or joined with itself."""
    raw = F.col("sequence").cast("binary")
    n = F.length(raw)
    at = F.sequence(F.lit(0), n - 1, F.lit(T.CHUNK))
    slots = F.flatten(F.transform(F.array(*map(F.lit, lags)), lambda lag: F.transform(F.filter(at, lambda b: b + lag < n), lambda b: F.struct(
        lag.alias("lag"), F.substring(raw, b + 1, F.least(F.lit(T.CHUNK), n - lag - b)).cast("string").alias("near"), F.substring(raw, b + lag + 1, F.lit(T.CHUNK)).cast("string").alias("far")))))
    both = df.where(F.length("sequence") >= 4).select(*keep, F.inline(slots))

    def joint(batches):
        # Joint counts of a chunk at a lag in one step: a row for each pair of symbols that occurs.
        for batch in batches:
            rows, a, b, n = [], [], [], []
            for r, (near, far) in enumerate(zip(batch.column(len(keep) + 1).to_pylist(), batch.column(len(keep) + 2).to_pylist(), strict=True)):
                x, y = (np.frombuffer(z.encode("latin-1", "replace"), np.uint8).astype(np.int64) for z in (near, far))
                m = min(len(x), len(y))
                found = np.bincount(x[:m] << 8 | y[:m], minlength=1)
                k = np.flatnonzero(found)
                rows.append(np.full(len(k), r))
                a.append(k >> 8)
                b.append(k & 255)
                n.append(found[k])
            if rows:
                at, *columns = (np.concatenate(z).astype(np.int64) for z in (rows, a, b, n))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in range(len(keep) + 1)), *map(pa.array, columns)], [*batch.schema.names[: len(keep) + 1], "a", "b", "n"])

    schema = ST.StructType([*both.select(*keep, "lag").schema.fields, *(ST.StructField(c, ST.LongType()) for c in "abn")])
    rows = both.select(*keep, "lag", "near", "far").mapInArrow(joint, schema).groupBy(*keep, "lag", "a", "b").agg(F.sum("n").alias("cnt"))
    key = [*keep, "lag"]
    c = F.col("cnt").cast("double")
    n = F.sum(c).over(Window.partitionBy(*key))
    of_a, of_b = F.sum(c).over(Window.partitionBy(*key, "a")), F.sum(c).over(Window.partitionBy(*key, "b"))
    return rows.select(*key, (c / n * F.log2(c * n / (of_a * of_b))).alias("t")).groupBy(*key).agg(F.sum("t").alias("mi"))


def dependency_summary(mi: DataFrame, keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """Decay slope, area, period-3 excess and short and long means of each key's spectrum."""
    order = Window.partitionBy(*keep).orderBy("lag")
    x = F.log1p(F.col("lag").cast("double"))
    area = (x - F.lag(x).over(order)) * (F.col("mi") + F.lag("mi").over(order)) / 2
    m = mi.withColumn("area", area)
    at = lambda k: F.max(F.when(F.col("lag") == k, F.col("mi")))
    enough = F.count(F.lit(1)) >= 3
    return m.groupBy(*keep).agg(
        F.when(enough, F.regr_slope(F.log(F.col("mi") + 1e-12), F.log(F.col("lag").cast("double")))).alias("mi_decay_slope"),
        F.when(enough, F.sum("area")).alias("mi_decay_auc"),
        (at(3) - F.avg(F.when(F.col("lag").isin(2, 4, 6), F.col("mi")))).alias("mi_period3_excess"),
        F.avg(F.when(F.col("lag") <= 12, F.col("mi"))).alias("mi_short_range_mean"),
        F.avg(F.when(F.col("lag") >= 100, F.col("mi"))).alias("mi_long_range_mean"),
    )
