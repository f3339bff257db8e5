"""Removal of byte strings of `length` bytes that start more than once in the corpus.

Distribution. Every window of `length` bytes is known by the smallest hash of the 32-byte strings in
it; equal windows agree in it. Neighbouring windows with the same minimum form a run (of `LONGEST` windows
at most, so that low-complexity text gives equal pieces), the bytes under which are its context. Runs whose
minimum occurs once are dropped, by counts aggregated before they are shuffled. Contexts whose bytes are
equal are collapsed to one with a count. A minimum with very many bytes is split again by further hashes,
alike in all documents, so that its contexts spread over groups. Texts are written once in buckets by row;
runs and results come to them there, so that a text moves once.

Inside a block of groups, a Burrows-Wheeler transform of the contexts is searched by threshold-bounded
interval expansion: from the boundaries between suffixes that share exactly l bytes, breadth-first
backward extension derives those that share l + 1, by increasing l, and stops at `length`. Suffixes
that no boundary parts by then are equal in their first `length` bytes. Only intervals in which a
boundary was found are visited again. Every context of a minimum that occurs twice goes this way.

Windows never cross documents. Null and empty texts and texts shorter than `length` lose nothing; very
long texts are taken whole. Repeated rows, rows with the same identifier and text too, are separate
documents that lose what they share. An empty table gives an empty table. Extra columns, whatever their
names, are ignored, but for those named in `carry`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import vectext as V
from strandline.llm.storage import Scratch

GRAM, CHUNK, BLOCK = 32, 1 << 20, 1 << 17
#: Bytes under one minimum from which it is split again, and by about how much a split divides.
HOT, DIVIDES = 6 << 20, 64
#: Windows of a run.
LONGEST = 4096
STOP = 0xFF  # no byte of UTF-8


def gram_hashes(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the GRAM bytes from each place."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(data)
    words = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,)).copy()
    h = V.U64(seed)
    for k in range(0, GRAM, 8):
        h = h * V.BASE + words[k : k + n]
        h ^= h >> V.U64(29)
    return V.mix(h)


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every window of w values."""
    n = len(x) - w + 1
    full = -(-len(x) // w) * w
    pad = np.full(full, np.iinfo(np.uint64).max if op is np.minimum else 0, np.uint64)
    pad[: len(x)] = x
    grid = pad.reshape(-1, w)
    head = op.accumulate(grid, axis=1).ravel()
    tail = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[:n], head[w - 1 : w - 1 + n])


def window_runs(data: np.ndarray, off: np.ndarray, length: int, seed: int = 0):
    """(row, minimum, first window, last window, whether the minimum stands there twice) of all runs."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none, none, none.astype(bool)
    w = length - GRAM + 1
    h = gram_hashes(data, seed)
    low = _slide(h, w, np.minimum)
    ok = np.zeros(len(data) + 1, np.int32)
    size = np.diff(off)
    long = size >= length
    ok[off[:-1][long]] += 1
    np.subtract.at(ok, off[1:][long] - length + 1, 1)
    valid = np.cumsum(ok[: len(low)]) > 0
    start = valid.copy()
    start[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    begin_doc = off[:-1][long]
    start[begin_doc] = True
    a = np.flatnonzero(start)
    stop = valid.copy()
    stop[:-1] &= start[1:] | ~valid[1:]
    b = np.flatnonzero(stop)
    if len(a) and (b - a).max() >= LONGEST:
        pieces = (b - a) // LONGEST + 1
        step = V.ragged(np.zeros(len(a), np.int64), pieces) * LONGEST
        a, b = np.repeat(a, pieces) + step, np.minimum(np.repeat(a, pieces) + step + LONGEST - 1, np.repeat(b, pieces))
    top = np.zeros(len(h), np.uint64)
    padded = np.concatenate((np.zeros(w - 1, np.uint64), np.where(valid, low, 0), np.zeros(w - 1, np.uint64)))
    top[: len(low) + w - 1] = _slide(padded, w, np.maximum)[: len(h)]
    at = np.flatnonzero(top == h)  # places that are the minimum of some window
    x, y = np.searchsorted(at, a), np.searchsorted(at, b + w)
    which = np.repeat(np.arange(len(a)), y - x)
    same = h[at[V.ragged(x, y - x)]] == low[a][which]
    twice = np.bincount(which[same], minlength=len(a)) > 1
    row = np.searchsorted(off, a, "right") - 1
    return row, low[a], a - off[row], b - off[row], twice


def suffix_order(text: np.ndarray, depth: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` bytes, and how many bytes (8 at most) each shares
    with the one before."""
    n = len(text)
    key = np.ndarray((n,), ">u8", np.concatenate((text, np.zeros(8, np.uint8))), 0, (1,)).astype(np.uint64)
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    differ = ordered[1:] ^ ordered[:-1]
    shared = np.zeros(n, np.int8)
    for k in range(8):
        shared[1:] += differ >> V.U64(56 - 8 * k) == 0
    new = np.ones(n, bool)
    new[1:] = differ != 0
    rank = np.empty(n + depth, np.int64)
    rank[n:] = -1
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = head
    step = 8
    tied = np.flatnonzero(~new | np.append(~new[1:], False))
    while step < depth and len(tied):
        own = sa[tied]
        group = rank[own]
        key = (group << 32) | (rank[own + step] + 1)
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        sa[tied] = own
        fresh = np.ones(len(tied), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[own] = np.maximum.accumulate(np.where(fresh, tied, 0))
        keep = ~fresh | np.append(~fresh[1:], False)
        tied = tied[keep]
        step *= 2
    return sa, shared


def equal_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, start of the interval of each): intervals share `length` bytes or more."""
    n = len(text)
    sa, shared = suffix_order(text, max(256, 1 << length.bit_length()))
    bwt = text[sa - 1]
    column = np.argsort(bwt, kind="stable")
    forward = np.empty(n, np.int64)  # where backward extension by its own byte takes a suffix
    forward[column] = np.arange(n)
    before = np.full(n, -1, np.int64)  # the suffix above with the same byte in front
    same = bwt[column[1:]] == bwt[column[:-1]]
    before[column[1:][same]] = column[:-1][same]
    known = min(7, length - 1)
    start = np.maximum.accumulate(np.where(shared < known, np.arange(n), 0))
    heads = np.flatnonzero(start == np.arange(n))
    end = np.zeros(n + 1, np.int64)
    end[heads] = np.append(heads[1:], n)
    parted = np.flatnonzero(shared == known)
    parted = parted[parted > 0]
    for _ in range(known, length):
        if not len(parted):
            break
        own = np.unique(start[parted])
        size = end[own] - own
        y = V.ragged(own, size)
        flag = np.zeros(n, bool) if n < 4 * len(y) else None
        if flag is not None:
            flag[parted] = True
            flag = flag[y]
        else:
            flag = np.zeros(len(y), bool)
            base = np.cumsum(size) - size
            k = np.searchsorted(own, start[parted])
            flag[base[k] + parted - own[k]] = True
        count = np.cumsum(flag)
        x = before[y]
        inside = np.flatnonzero(x >= start[y])
        split = count[inside] > count[inside - (y[inside] - x[inside])]
        nxt = np.sort(forward[y[inside[split]]])
        # Part the intervals at this level's boundaries.
        begins = np.unique(np.concatenate((own, parted)))
        k = np.searchsorted(own, begins, "right") - 1
        stops = np.minimum(np.append(begins[1:], n), end[own[k]])
        start[y] = np.repeat(begins, stops - begins)
        end[begins] = stops
        parted = nxt
    return sa, start


def repeated_places(text: np.ndarray, length: int) -> np.ndarray:
    """True where a string of `length` bytes starts that starts elsewhere in `text` too, which has
    to end with STOP; strings with STOP in them may be told wrongly."""
    sa, start = equal_prefixes(text, length)
    size = np.bincount(start, minlength=len(text))
    out = np.zeros(len(text), bool)
    out[sa] = size[start] > 1
    return out


def _spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _contexts(data, off, rows, lists, length: int):
    """Arrays of the contexts of chosen runs: (row, minimum, start, bytes flat, sizes)."""
    row, (m, first, last, total) = rows, lists
    size = last - first + length
    hot = total > HOT
    if hot.any():
        out = [(row[~hot], m[~hot], first[~hot], last[~hot])]
        for k in np.flatnonzero(hot).tolist():
            pieces = [(int(m[k]), 0, int(last[k] - first[k]))]
            at = off[row[k]] + first[k]
            body, many, seed = data[at : at + size[k]], int(total[k]), 1
            while many > HOT:
                finer = []
                for key, a, b in pieces:
                    part = body[a : b + length]
                    _, low, x, y, _ = window_runs(part, np.array([0, len(part)]), length, seed)
                    keys = V.mix(low ^ V.mix(np.full(len(low), key & (2**64 - 1), np.uint64) + V.U64(seed)))
                    finer += [(int(q), a + int(i), a + int(j)) for q, i, j in zip(keys, x, y, strict=True)]
                pieces, many, seed = finer, many // DIVIDES, seed + 1
            got = np.array([(a, b) for _, a, b in pieces], np.int64)
            keys = np.array([q & (2**64 - 1) for q, _, _ in pieces], np.uint64).view(np.int64)
            out.append((np.full(len(got), row[k]), keys, first[k] + got[:, 0], first[k] + got[:, 1]))
        row, m, first, last = (np.concatenate(c) for c in zip(*out, strict=True))
        size = last - first + length
    return row, m, first, data[V.ragged(off[row] + first, size)], size


def _find(length: int):
    def work(batches):
        for batch in batches:
            data, off = V.column_bytes(batch.column(1))
            for a, b in V.chunks(off, CHUNK):
                row, m, first, last, twice = window_runs(data[off[a] : off[b]], off[a : b + 1] - off[a], length)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(m.view(np.int64)), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(twice)], ["uid", "m", "first", "last", "twice"])

    return work


def _cut(length: int, bodies: bool):
    """The contexts of a row's runs: (m, dg, body), or where they stand: (m, dg, uid, first)."""

    def work(batches):
        for batch in batches:
            data, off = V.column_bytes(batch.column(1))
            lists = batch.column(2)
            at = np.asarray(lists.offsets)
            fields = [np.asarray(lists.values.field(k)).astype(np.int64) for k in range(4)]
            for a, b in V.chunks(off, CHUNK):
                x, y = at[a], at[b]
                row, m, first, flat, size = _contexts(data, off, np.repeat(np.arange(a, b), np.diff(at[a : b + 1])), [f[x:y] for f in fields], length)
                ends = np.concatenate(([0], np.cumsum(size)))
                raw, cuts = flat.tobytes(), ends.tolist()
                dg = pa.array([hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())
                if bodies:
                    body = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays([pa.array(m), dg, body], ["m", "dg", "body"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(m), dg, batch.column(0).take(pa.array(row)), pa.array(first, pa.int32())], ["m", "dg", "uid", "first"])

    return work


def _repeats(t: pa.Table, length: int) -> pa.RecordBatch:
    """(m, dg, a, b): the starts a to b - 1 of a context's repeated strings, over a block of whole groups."""
    body = t.column("body").combine_chunks()
    data, off = V.column_bytes(body)
    size = np.diff(off)
    where = np.arange(len(data)) + np.repeat(np.arange(len(size)), size)
    text = np.full(len(data) + len(size), STOP, np.uint8)
    text[where] = data
    # A context that was collapsed repeats as a whole; the transform finds what different ones share.
    hit = np.repeat(np.asarray(t.column("n")) > 1, size) | repeated_places(text, length)[where]
    inside = np.repeat(off[1:], size) - np.arange(len(data)) >= length
    a, b = V.runs(hit & inside, off)
    owner = np.searchsorted(off, a, "right") - 1
    pick = pa.array(owner)
    return pa.RecordBatch.from_arrays([t.column("m").combine_chunks().take(pick), t.column("dg").combine_chunks().take(pick), pa.array(a - off[owner], pa.int32()), pa.array(b - off[owner], pa.int32())], ["m", "dg", "a", "b"])


def _search(length: int):
    """Blocks of whole groups of a partition in order of m."""
    names = ["m", "dg", "body", "n"]

    def work(batches):
        held, total, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.asarray(batch.column(0))
            off = V.column_bytes(batch.column(2))[1]
            # Places where another minimum begins; a group may go on in the next batch.
            begins = np.flatnonzero(np.concatenate(([last is not None and m[0] != last], m[1:] != m[:-1])))
            begin = 0
            for c in begins.tolist():
                if total + off[c] - off[begin] > BLOCK:
                    held.append(pa.RecordBatch.from_arrays(batch.slice(begin, c - begin).columns, names))
                    yield _repeats(pa.Table.from_batches(held), length)
                    held, total, begin = [], 0, c
            held.append(pa.RecordBatch.from_arrays(batch.slice(begin).columns, names))
            total += int(off[-1] - off[begin])
            last = m[-1]
        if held:
            yield _repeats(pa.Table.from_batches(held), length)

    return work


def _apply(length: int, names: list[str]):
    def work(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            texts, spans = batch.column(1).cast(pa.binary()), batch.column(2)
            for raw, own in zip(texts, spans, strict=True):
                raw = np.frombuffer(raw.as_buffer(), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int32)
                if own.is_valid:
                    np.add.at(edge, np.asarray(own.values.field(0)), 1)
                    np.add.at(edge, np.asarray(own.values.field(1)) + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = raw[~gone].tobytes()
                for c, x in zip(out, (len(raw), int(gone.sum()), len(_spans(gone)[0]), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")), strict=True):
                    c.append(x)
            told = [*(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *told[: 5 if "kept" in names else 4], *batch.columns[3:]], names)

    return work


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans, kept_sha256, what is left if asked for,
    and the columns named in `carry`."""
    tmp = Scratch(df.sparkSession, "suffix-dedup")
    kind = df.schema[key].dataType.simpleString()
    more = [f"c{k}" for k in range(len(carry))]
    base = df.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *(F.col(f"`{c}`").alias(x) for c, x in zip(carry, more, strict=True)))
    texts = tmp.save_bucketed(base, "uid", "text")
    runs = tmp.save(texts.select("uid", "text").where(F.octet_length("text") >= length).mapInArrow(_find(length), "uid long, m long, first int, last int, twice boolean"), "runs")
    size = (F.col("last") - F.col("first") + length).cast("long")
    often = runs.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"), F.max("twice").alias("twice")).where("n > 1 OR twice").select("m", "total")
    listed = runs.select("uid", "m", "first", "last").join(tmp.save(often, "often"), "m").groupBy("uid").agg(F.collect_list(F.struct("m", "first", "last", "total")).alias("runs"))
    lists = tmp.save(listed, "lists")
    tmp.drop(runs)
    some = texts.select("uid", "text").join(lists, "uid").select("uid", "text", "runs")
    places = tmp.save(some.mapInArrow(_cut(length, False), "m long, dg binary, uid long, first int"), "places")
    bodies = some.mapInArrow(_cut(length, True), "m long, dg binary, body binary").groupBy("m", "dg", "body").agg(F.count(F.lit(1)).alias("n"))
    found = tmp.save(bodies.repartition("m").sortWithinPartitions("m", "dg").mapInArrow(_search(length), "m long, dg binary, a int, b int"), "found")
    hits = places.join(found, ["m", "dg"]).select("uid", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    hits = tmp.save(hits.groupBy("uid").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "hits")
    tmp.drop(lists, places, found)
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text + more
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text + "".join(f", {x} {base.schema[x].dataType.simpleString()}" for x in more)
    marked = texts.join(hits, "uid", "left").select("id", "text", "spans", *more)
    return marked.mapInArrow(_apply(length, names), schema).withColumnsRenamed({"id": key, **dict(zip(more, carry, strict=True))})
