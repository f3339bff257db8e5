"""Similarity join on word n-grams by chosen paths.

A document is the set of its `size`-word shingles. Equal sets form a class with one representative.
Each set is embedded as `WIDTH` tokens, its minimum under as many hash functions. A run starts at a
root; a node samples two token positions, and the sets that share a token there go on together to a
child. Two sets of similarity s are parted in a run with a probability that follows from s and depth;
runs are repeated until the target recall. A small bucket is compared pair by pair; so is one that
keeps over half of its parent, since splitting it again would not help (its members are alike), in
tiles of two blocks. Buckets of one end. Comparison of embedded sets keeps what may reach the
threshold by five standard deviations and joins it to candidate components. Inside a component every
pair of sets is then counted exactly, by the shingles themselves, again in tiles.

Links between copies are not expanded; `n_links` counts them. That number asks for every pair of a
component, so the pairs are compared, in tiles of bounded bytes and rows; a set travels as its shingle
hashes, once for every block of its component (a component of n sets: n / 2,048 times at most for short
texts), and a tile returns sums and spanning edges, never pairs. In the search, where only connection
counts, a tile first unites what is near a few pivots and compares the rest alone.

Texts of fewer than `size` words are one shingle of all words; null texts, empty ones and texts without
words have no shingle, no link and a class of their own. Very long texts are taken whole. Repeated rows
and ties: every row counts as a document, equal sets are linked to each other. Rows without an identifier
take part and come last in a class. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import vectext as V
from strandline.llm.components import components
from strandline.llm.storage import Scratch

WIDTH, BRANCHES, CHUNK = 64, 2, 1 << 20
SMALL, BLOCK, DEPTH = 256, 4096, 8
#: Most rows and bytes of shingles in a block where links are counted; a token of over COMMON sets of a tile is one of a matrix.
ROWS, BYTES, COMMON = 2048, 4 << 20, 64
#: Pairs of a tile that are compared without looking for pivots first.
FEW_PAIRS = 1 << 16
_ODD = V.mix(np.arange(1, WIDTH + 1, dtype=np.uint64)) | V.U64(1)


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and n + 1 offsets."""
    low, s, e, at = V.folded_words(data, off)
    n = len(off) - 1
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    w = V.span_hashes(low, s, e)
    row = np.repeat(np.arange(n), np.diff(at))
    h, r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(w) >= size:
        h = w[: len(w) - size + 1].copy()
        for k in range(1, size):
            h = h * V.BASE + w[k : len(w) - size + 1 + k]
        ok = row[size - 1 :] == row[: len(row) - size + 1]
        h, r = V.mix(h[ok] + V.U64(size)), row[: len(row) - size + 1][ok]
    words = np.diff(at)
    short = np.flatnonzero((words > 0) & (words < size))
    if len(short):
        tail = []
        for k in short:
            x = V.U64(0)
            for y in w[at[k] : at[k + 1]]:
                x = V.U64((int(x) * int(V.BASE) + int(y)) & (2**64 - 1))
            tail.append(V.U64((int(x) + int(words[k])) & (2**64 - 1)))
        h, r = np.concatenate((h, V.mix(np.array(tail, np.uint64)))), np.concatenate((r, short))
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(n + 1))


def embedded(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The minimum of each row's shingles under each hash function, 32 bits each."""
    out = np.zeros((len(at) - 1, WIDTH), np.int32)
    full = at[1:] > at[:-1]
    if full.any():
        begin = at[:-1][full]
        for k in range(WIDTH):
            low = np.minimum.reduceat(h * _ODD[k], begin)
            out[full, k] = (V.mix(low) >> V.U64(32)).astype(np.uint32).view(np.int32)
    return out


def runs_needed(threshold: float, recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold is together in one bucket with this probability. A run begins at
    tokens of its own, so a recall that asks for more runs than there are tokens is an error."""
    lost = (1 - threshold) ** BRANCHES
    for _ in range(depth - 1):
        lost = (1 - threshold * (1 - lost)) ** BRANCHES
    runs = max(1, math.ceil(math.log(1 - recall) / math.log(lost)))
    if runs > WIDTH // BRANCHES:
        raise ValueError(f"a recall of {recall} at a similarity of {threshold} asks for {runs} runs; there are tokens for {WIDTH // BRANCHES}")
    return runs


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    return label


def _groups(batches, keys: int):
    """Tables of the rows that share the first `keys` columns, of a sorted partition."""
    held = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(pa.RecordBatch.from_arrays(batch.slice(x, y - x).columns, batch.schema.names))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _near_pairs(sig: np.ndarray, side_a: np.ndarray, side_b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of side_a, one of side_b) that agree in `least` embedded tokens or more."""
    out = []
    for x in range(0, len(side_a), 64):
        rows = side_a[x : x + 64]
        same = np.zeros((len(rows), len(side_b)), np.uint8)
        for k in range(WIDTH):
            same += sig[rows, k][:, None] == sig[side_b, k]
        i, j = np.nonzero(same >= least)
        out.append((rows[i], side_b[j]))
    a, b = (np.concatenate(c) for c in zip(*out, strict=True))
    return a[a != b], b[a != b]


def _near_labels(sig: np.ndarray, first: np.ndarray, second: np.ndarray, least: int, pivots: int = 8) -> np.ndarray:
    """Smallest index connected to each index by near pairs of (first, second)."""
    n = len(sig)
    if len(first) * len(second) <= FEW_PAIRS:
        return _labels(n, *_near_pairs(sig, first, second, least))
    label = np.arange(n)
    for k in range(pivots):
        side, other = (second, first) if k % 2 else (first, second)
        big = np.bincount(label).argmax()
        out = side[label[side] != big]
        if not len(out):
            break
        a, b = _near_pairs(sig, out[:1], other, least)
        label = _labels(n, np.concatenate((a, np.arange(n))), np.concatenate((b, label)))
    big = np.bincount(label).argmax()
    # Pairs inside the largest component need no comparison.
    parts = [_near_pairs(sig, x, y, least) for x, y in ((first[label[first] != big], second), (first[label[first] == big], second[label[second] != big])) if len(x) and len(y)]
    a, b = (np.concatenate([np.arange(n) if c == 0 else label, *(p[c] for p in parts)]) for c in (0, 1))
    return _labels(n, a, b)


def _candidate_edges(threshold: float):
    least = max(1, int((threshold - 5 * math.sqrt(threshold * (1 - threshold) / WIDTH)) * WIDTH))

    def work(batches):
        for t in _groups(batches, 3):
            n = t.num_rows
            if n < 2:
                continue
            uid = np.asarray(t.column("uid"))
            sig = np.asarray(t.column("sig").combine_chunks().flatten()).reshape(n, WIDTH)
            low = np.asarray(t.column("low"))
            first = np.flatnonzero(low)
            second = np.flatnonzero(~low)
            label = _near_labels(sig, first, second if len(second) else first, least)
            away = label != np.arange(n)
            if away.any():
                yield pa.RecordBatch.from_arrays([pa.array(uid[away]), pa.array(uid[label[away]])], ["a", "b"])

    return work


def _tiles(df: DataFrame, key: str, blocks) -> DataFrame:
    """Rows of groups, once for every pair of the group's `blocks` that they belong to."""
    blocks = blocks.cast("int")
    own = F.pmod(F.xxhash64("uid"), blocks).cast("int")
    df = df.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    t = df.withColumns({"t1": F.least("_own", "_other"), "t2": F.greatest("_own", "_other"), "low": F.col("_own") <= F.col("_other")})
    return t.drop("_own", "_other").repartition(key, "t1", "t2").sortWithinPartitions(key, "t1", "t2", "uid")


def _shared(token: np.ndarray, at: np.ndarray, rows: np.ndarray, n: int):
    """For each batch of `rows`: the batch and its matrix of numbers of tokens shared with all n sets."""
    row = np.repeat(np.arange(n), np.diff(at))
    sets = np.bincount(token) if len(token) else np.zeros(0, np.int64)
    common = np.flatnonzero(sets > COMMON)
    number = np.full(len(sets), -1)
    number[common] = np.arange(len(common))
    column = number[token]
    tables = []
    for k in range(0, len(common), 2048):
        table = np.zeros((n, min(2048, len(common) - k)), np.uint8)
        own = (column >= k) & (column < k + 2048)
        table[row[own], column[own] - k] = 1
        tables.append(table)
    order = np.argsort(token, kind="stable")
    posting, begin = row[order], np.searchsorted(token[order], np.arange(len(sets) + 1))
    for k in range(0, len(rows), 256):
        part = rows[k : k + 256]
        out = np.zeros((len(part), n), np.float32)
        for table in tables:
            out += table[part].astype(np.float32) @ table.astype(np.float32).T
        size = at[part + 1] - at[part]
        mine = token[V.ragged(at[part], size)]
        which = np.repeat(np.arange(len(part)), size)
        few = column[V.ragged(at[part], size)] < 0
        mine, which = mine[few], which[few]
        many = begin[mine + 1] - begin[mine]
        met = np.repeat(which, many) * n + posting[V.ragged(begin[mine], many)]
        yield part, out + np.bincount(met, minlength=len(part) * n).reshape(len(part), n)


def _counted(threshold: float):
    """Exact links inside tiles: uid, links by class size, a spanning edge."""

    def work(batches):
        for t in _groups(batches, 3):
            uid, first = np.unique(np.asarray(t.column("uid")), return_index=True)
            t = t.take(pa.array(first))
            n = t.num_rows
            low, members = np.asarray(t.column("low")), np.asarray(t.column("members"))
            data, off = V.column_bytes(t.column("ids").combine_chunks())
            at = off // 8
            token = np.unique(np.frombuffer(data.tobytes(), np.uint64), return_inverse=True)[1]
            count = np.diff(at)
            split = not low.all()
            links, label = np.zeros(n, np.int64), np.arange(n)
            for part, shared in _shared(token, at, np.flatnonzero(low), n):
                near = (shared > 0) & (shared >= threshold * (count[part][:, None] + count - shared) - 1e-9)
                near[np.arange(len(part)), part] = False
                if split:
                    near &= ~low
                links[part] += near @ members
                if split:
                    links += members[part] @ near
                i, j = np.nonzero(near)
                label = _labels(n, np.concatenate((part[i], np.arange(n))), np.concatenate((j, label)))
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(links), pa.array(uid[label])], ["uid", "links", "root"])

    return work


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.9999, with_hash: bool = False) -> DataFrame:
    """One row per input row: key, class_id (the smallest key of all rows joined by links), n_links (rows
    other than itself with similarity of the threshold or more), n_shingles, kept (one per class); with
    `with_hash` also text_hash, xxhash64 of the text."""
    tmp = Scratch(df.sparkSession, "ngram-join")

    def embed(batches):
        for batch in batches:
            data, off = V.column_bytes(batch.column(0))
            for a, b in V.chunks(off, CHUNK):
                h, at = shingles(data[off[a] : off[b]], off[a : b + 1] - off[a], size)
                sig, n = embedded(h, at), np.diff(at)
                raw, ends = h.tobytes(), (at * 8).tolist()
                digest = [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in (1, 2, 3)), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel()), WIDTH).cast(pa.list_(pa.int32()))],
                    ["id", "uid", "th", "n", "same", "sig"],
                )

    def hashes(batches):
        for batch in batches:
            data, off = V.column_bytes(batch.column(4))
            for a, b in V.chunks(off, CHUNK):
                h, at = shingles(data[off[a] : off[b]], off[a : b + 1] - off[a], size)
                ids = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((at * 8).astype(np.int64).tobytes()), pa.py_buffer(h.tobytes())])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(4)), ids.cast(pa.binary())], ["root", "blocks", "uid", "members", "ids"])

    source = df.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(key).cast("long").alias("id"), F.monotonically_increasing_id().alias("uid"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"))
    sets = tmp.save(source.mapInArrow(embed, "id long, uid long, th long, n long, same binary, sig array<int>"), "sets")
    # Equal sets: a digest of all shingles, and their number.
    alike = ["n", "same"]
    groups = tmp.save(sets.where("n > 0").groupBy(*alike).agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("members")), "groups")
    reps = tmp.save(sets.join(groups.select(F.col("rep").alias("uid"), "members"), "uid").select("uid", "id", "th", "n", "sig", "members"), "reps")
    edges = _search(reps, tmp, threshold, recall)
    comp = components(edges, tmp).select(F.col("id").alias("uid"), "root")
    asked = tmp.save(comp.join(reps.select("uid", "id", "th", "n", "members"), "uid"), "asked")
    blocks = F.greatest(F.ceil(F.sum("n") * 8 / BYTES), F.ceil(F.count(F.lit(1)) / ROWS))
    asked = asked.join(tmp.save(asked.groupBy("root").agg(blocks.alias("blocks")), "sizes"), "root")
    texts = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.withColumn("th", F.xxhash64("text")).select(F.col("id").alias("_i"), F.col("th").alias("_t"), "text")
    found = asked.join(texts, F.col("id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t"))).select("root", "blocks", "uid", "members", "text")
    found = found.mapInArrow(hashes, "root long, blocks long, uid long, members long, ids binary")
    tiled = _tiles(found, "root", F.col("blocks")).select("root", "t1", "t2", "low", "uid", "members", "ids")
    exact = tmp.save(tiled.mapInArrow(_counted(threshold), "uid long, links long, root long"), "exact")
    linked = components(exact.select(F.col("uid").alias("a"), F.col("root").alias("b")), tmp)
    told = groups.join(exact.groupBy(F.col("uid").alias("rep")).agg(F.sum("links").alias("links")), "rep", "left").join(linked.select(F.col("id").alias("rep"), "root"), "rep", "left")
    told = tmp.save(told.select(*alike, F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links")), "told")
    rows = sets.where("n > 0").select("id", "uid", "th", *alike).join(told, alike).select("id", "uid", "th", "n", "root", "n_links")
    rows = tmp.save(rows.unionByName(sets.where("n = 0").select("id", "uid", "th", "n", F.col("uid").alias("root"), F.lit(0).cast("long").alias("n_links"))), "rows")
    heads = tmp.save(rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("head")), "heads")
    return rows.join(heads, "root").select(
        F.col("id").alias(key), F.col("head.id").alias("class_id"), "n_links", F.col("n").alias("n_shingles"), *([F.col("th").alias("text_hash")] * with_hash), (F.col("uid") == F.col("head.uid")).alias("kept"),
    )


def _search(reps: DataFrame, tmp: Scratch, threshold: float, recall: float) -> DataFrame:
    """Spanning edges (a, b) of sets that may be similar."""
    runs = runs_needed(threshold, recall)
    rows = reps.select("uid", "sig", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("path"))
    rows = rows.withColumn("path", F.col("path").cast("long")).withColumn("n", F.lit(None).cast("long"))
    found = None
    for level in range(DEPTH):
        place = F.pmod(F.xxhash64("path", "j"), F.lit(WIDTH)) if level else (F.col("path") * BRANCHES + F.col("j")) * 5 % WIDTH
        split = rows.select("uid", "sig", "path", F.col("n").alias("before"), F.explode(F.array(*(F.lit(k) for k in range(BRANCHES)))).alias("j")).withColumn("place", place.cast("int"))
        split = split.select("uid", "before", F.xxhash64("path", "place", F.get("sig", F.col("place"))).alias("path"))
        sizes = tmp.save(split.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"sizes{level}")
        shared = tmp.save(split.join(sizes, "path"), f"level{level}")
        small = F.col("n") <= SMALL
        ends = small if not level else small | (F.col("n") * 2 > F.col("before"))
        if level == DEPTH - 1:
            ends = F.lit(True)
        leaf = shared.where(ends).join(reps.select("uid", "sig"), "uid").select("path", "n", "uid", "sig")
        tiled = _tiles(leaf, "path", F.ceil(F.col("n") / BLOCK)).select("path", "t1", "t2", "low", "uid", "sig")
        got = tmp.save(tiled.mapInArrow(_candidate_edges(threshold), "a long, b long").distinct(), f"edges{level}")
        found = got if found is None else found.unionByName(got)
        more = shared.where(~ends)
        if not more.head(1):
            break
        rows = more.join(reps.select("uid", "sig"), "uid").select("uid", "sig", "path", "n")
    return found


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
     e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
     reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = d.doc_id), d.doc_id)) AS class_id,
       (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links, coalesce(n.n, 0) AS n_shingles,
       d.doc_id <= coalesce((SELECT min(b) FROM reach r WHERE r.a = d.doc_id), d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id)
"""
