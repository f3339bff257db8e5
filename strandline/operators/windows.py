"""Analysis windows, null-model controls and the fused Arrow pass over windows."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect
from collections.abc import Iterator
from operator import length_hint

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import kernels as K
from strandline.functions.symbols import revcomp, stable_seed

SLICE = 1 << 22
TASKS = 8  # of windows, for each core
TOGETHER = 1 << 20  # symbols of windows that are drawn side by side
WINDOW = "organism string, accession string, organism_type string, source string, replicate int, start long, end long, sequence string"


def spans(n: int, window: int, count: int, least: int, rng: random.Random) -> list[tuple[int, int]]:
    """Both ends, evenly spaced places and random ones until there are `count`, in order. A sequence
    with fewer different places than that gets all of them."""
    room = n - window
    if n < least or room <= 0:
        return [(0, n)] if n else []
    if count > 2:
        even = np.rint(np.linspace(0, 1, count - 2) * room).astype(np.int64)
        places = set(np.append(even, (0, room)).tolist())
        drawn = iter(lambda: rng.randint(0, room), None)
        while len(places) < min(count, room + 1):
            places.add(next(drawn))
    else:
        places = {0} if count == 1 else {0, room}
    return [(a, a + window) for a in sorted(places)[: max(0, count)]]


def observed(df: DataFrame, window: int = 200_000, count: int = 8, least: int = 1000, seed: int = 42, shared_rng: bool = False) -> DataFrame:
    """Windows of (name, accession, organism_type, sequence). By default every record has a generator of its
    own, seeded by its name; only names and lengths go to Python, and records of one name get windows each
    of their own. `shared_rng` hands one generator on from record to record in order of name, which needs
    the names and lengths (not the sequences) on the driver, and names that don't repeat. What follows costs far
    more than moving a window, so windows are dealt to `TASKS` a core, whatever partitions the records came in."""
    kind = "array<struct<start: bigint, end: bigint>>"
    if shared_rng:
        rng, rows, last = random.Random(seed), [], None
        for r in df.select("name", F.length("sequence").alias("n")).orderBy("name").toLocalIterator():
            if rows and r.name == last:
                raise ValueError(f"repeated name: {r.name}")
            last = r.name
            rows.append((r.name, spans(r.n, window, count, least, rng)))
        df = df.join(df.sparkSession.createDataFrame(rows, f"name string, places {kind}"), "name")
    else:

        @F.pandas_udf(kind)
        def plan(names: pd.Series, lengths: pd.Series) -> pd.Series:
            return pd.Series([[{"start": a, "end": b} for a, b in spans(int(n), window, count, least, random.Random(stable_seed(seed, name)))] for name, n in zip(names, lengths, strict=True)])

        df = df.withColumn("places", plan("name", F.length("sequence")))
    raw = F.col("sequence").cast("binary")
    cut = F.transform("places", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.substring(raw, (w["start"] + 1).cast("int"), (w["end"] - w["start"]).cast("int")).cast("string").alias("sequence")))
    pieces = df.select(F.col("name").alias("organism"), "accession", "organism_type", F.posexplode(cut).alias("replicate", "w"))
    wins = pieces.select("organism", "accession", "organism_type", F.lit("observed").alias("source"), "replicate", "w.start", "w.end", "w.sequence")
    return wins.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism, "organism", "accession", "replicate")


def even_windows(df: DataFrame, window: int, count: int, keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """keep..., replicate, start, end, sequence: `count` evenly spaced windows, in the JVM alone."""
    room = F.greatest(F.length("sequence") - window, F.lit(0))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * room / F.lit(max(1, count - 1))).cast("long")))
    out = df.where(F.length("sequence") > 0).select(*keep, F.col("sequence").alias("_s"), F.posexplode(places).alias("replicate", "start"))
    end = F.least(F.col("start") + window, F.length("_s").cast("long"))
    return out.select(*keep, "replicate", "start", end.alias("end"), F.substring(F.col("_s"), (F.col("start") + 1).cast("int"), F.lit(window)).alias("sequence"))


def _bits(rng: random.Random, n: int) -> np.ndarray:
    """The generator's next `n` words of 32 bits, at once."""
    return np.frombuffer(rng.getrandbits(32 * n).to_bytes(4 * n, "little"), "<u4") if n else np.zeros(0, np.uint32)


def _uniform(rng: random.Random, n: int) -> np.ndarray:
    """What `n` calls of rng.random() give: 53 bits of two words each."""
    w = _bits(rng, 2 * n).astype(np.float64)
    return (np.floor(w[::2] / 32) * 67108864.0 + np.floor(w[1::2] / 64)) / 9007199254740992.0


def _draw(seq: str, order: int, rng: random.Random) -> str:
    """A Markov surrogate: start words and steps by observed frequency, one added to each count. Words are
    numbers in the base of the alphabet; a draw is a place among running sums of weights."""
    seq = seq.encode("latin-1", "replace").decode("latin-1")
    n = len(seq)
    alphabet = "ACGT" + "".join(sorted(set(seq) - set("ACGT")))
    base = len(alphabet)
    table = np.zeros(256, np.int64)
    table[np.frombuffer(alphabet.encode("latin-1"), np.uint8)] = np.arange(base)
    a = table[np.frombuffer(seq.encode("latin-1"), np.uint8)]
    if order <= 0 or n <= order:
        weight = np.cumsum(np.bincount(a, minlength=4)[:4] / max(1, n))
        if not weight[-1]:
            return ""
        drawn = _uniform(rng, n) * weight[-1]
        return "".join(alphabet[k] for k in np.minimum(np.searchsorted(weight, drawn, "right"), 3))
    words = np.zeros(n - order, np.int64)
    for j in range(order):
        words = words * base + a[j : j + n - order]
    follows = a[order:]
    plain = follows < 4
    steps = 1 + np.bincount(words[plain] * 4 + follows[plain], minlength=base**order * 4).reshape(-1, 4)
    steps = np.cumsum(steps, axis=1)
    # The first word counts once more; words stand in order of their first places.
    found, at, times = np.unique(words, return_index=True, return_counts=True)
    by_place = np.argsort(at)
    found, times = found[by_place], times[by_place] + 1
    times[0] += 1
    sums = np.cumsum(times)
    drawn = _uniform(rng, n - order + 1)
    state = int(found[min(np.searchsorted(sums, drawn[0] * sums[-1], "right"), len(sums) - 1)])
    out = [state // base**j % base for j in reversed(range(order))]
    if order == 1:
        # A place's draw says what follows each of the four symbols; one after the other is then looked up.
        if out[0] > 3:
            out.append(bisect(steps[out[0], :3].tolist(), drawn[1] * steps[out[0], 3]))
        follows = np.zeros(n - len(out), np.uint8)
        for k in range(4):
            at = drawn[len(out) :] * steps[k, 3]
            follows |= ((at >= steps[k, 0]).astype(np.uint8) + (at >= steps[k, 1]) + (at >= steps[k, 2])) << np.uint8(2 * k)
        k = out[-1]
        for nexts in map(FOLLOWS.__getitem__, follows.tolist()):
            k = nexts[k]
            out.append(k)
        return "".join(map(alphabet.__getitem__, out))
    steps = steps.tolist()
    keep = base ** (order - 1)
    for r in drawn[1:].tolist():
        weight = steps[state]
        k = bisect(weight, r * weight[3], 0, 3)
        out.append(k)
        state = state % keep * base + k
    return "".join(map(alphabet.__getitem__, out))


#: The symbols behind each of four, two bits each.
FOLLOWS = [tuple(b >> 2 * k & 3 for k in range(4)) for b in range(256)]


def _shuffled(parts: list[str], rng: random.Random) -> str:
    """As rng.shuffle orders them, and with as many words of the generator: a place is the first of the next words,
    cut to the bits of the places left, that is none too large."""
    left = len(parts) - 1
    while left > 0:
        bits = (left + 1).bit_length()
        least = max(1, (1 << bits - 1) - 1)  # below it, places have fewer bits
        before, size = rng.getstate(), 2 * (left - least + 1) + 64
        drawn = iter((_bits(rng, size) >> np.uint32(32 - bits)).tolist())
        for k in drawn:
            if k <= left:
                parts[left], parts[k] = parts[k], parts[left]
                left -= 1
                if left < least:
                    break
        if spare := length_hint(drawn):
            rng.setstate(before)
            rng.getrandbits(32 * (size - spare))
    return "".join(parts)


def control(seq: str, kind: str, rng: random.Random, block: int = 500) -> str:
    match kind:
        case "shuffle":
            return _shuffled(list(seq), rng)
        case "block_shuffle":
            return seq if len(seq) <= block else _shuffled([seq[a : a + block] for a in range(0, len(seq), block)], rng)
        case "revcomp":
            return seq.translate(str.maketrans("ACGTacgt", "TGCAtgca"))[::-1].upper()
        case _ if kind in ("markov0", "markov1", "markov2", "markov3"):
            return _draw(seq, int(kind[-1]), rng)
    raise ValueError(f"unknown control: {kind}")


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint32(16))
    h = h * np.uint32(0x85EBCA6B)
    h = h ^ (h >> np.uint32(13))
    h = h * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def draws(places: np.ndarray, *parts: object) -> np.ndarray:
    """A 32-bit number for each place, keyed by `parts`: any place's draw is known without those before it, and any
    engine that has MD5 and whole numbers gets the same."""
    key = np.uint32(int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16))
    return _mix(_mix(places.astype(np.uint32)) + key)


def _below(drawn: np.ndarray, total) -> np.ndarray:
    """Numbers below `total` from 32-bit draws."""
    return (drawn.astype(np.uint64) * np.uint64(total) >> np.uint64(32)).astype(np.int64)


def _chain(a: np.ndarray, order: int, drawn: np.ndarray) -> np.ndarray:
    """A Markov surrogate of the codes `a`: the start word by its count plus one among the words that occur, each
    step by the counts after its word plus one each. A place's draw turns every word into the next one, a map of
    4^order words; chunks compose their maps side by side, their starts follow from the maps, and then all chunks
    are filled at once: no step waits for more than a chunk's length."""
    n, words = len(a), 4**order
    w = np.zeros(n - order + 1, np.int64)
    for j in range(order):
        w = w * 4 + a[j : j + n - order + 1]
    times = np.bincount(w, minlength=words)
    times[times > 0] += 1
    state = int(np.searchsorted(np.cumsum(times), _below(drawn[:1], times.sum())[0], "right"))
    weight = np.cumsum(1 + np.bincount(w[:-1] * 4 + a[order:], minlength=words * 4).reshape(words, 4), axis=1).astype(np.uint64)
    steps = drawn[order:].astype(np.uint64)
    size = max(1, int(np.sqrt(len(steps))))
    chunks = -(-len(steps) // size)
    grid = np.zeros((chunks, size), np.uint64)
    grid.ravel()[: len(steps)] = steps

    def following(words_now: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = weight[words_now]
        at = r * own[..., 3] >> np.uint64(32)
        base = (at >= own[..., 0]).astype(np.int64) + (at >= own[..., 1]) + (at >= own[..., 2])
        return words_now % (words // 4) * 4 + base, base

    maps = np.broadcast_to(np.arange(words), (chunks, words))
    for k in range(size):
        maps, _ = following(maps, grid[:, k : k + 1])
    start = np.empty(chunks, np.int64)
    for c in range(chunks):
        start[c], state = state, int(maps[c, state])
    out, now = np.empty((chunks, size), np.int64), start
    for k in range(size):
        now, out[:, k] = following(now, grid[:, k])
    first = [int(start[0]) // 4**j % 4 for j in reversed(range(order))] if chunks else [state // 4**j % 4 for j in reversed(range(order))]
    return np.concatenate((first, out.ravel()[: len(steps)])).astype(np.int64)


def _chains(a: np.ndarray, order: int, drawn: np.ndarray) -> np.ndarray:
    """`_chain` for windows of one length, a row each: they take a step at a time together."""
    (rows, n), words = a.shape, 4**order
    row = np.arange(rows)
    w = np.zeros((rows, n - order + 1), np.int64)
    for j in range(order):
        w = w * 4 + a[:, j : j + n - order + 1]
    times = np.bincount((row[:, None] * words + w).ravel(), minlength=rows * words).reshape(rows, words)
    times[times > 0] += 1
    sums = np.cumsum(times, axis=1)
    state = (sums <= _below(drawn[:, 0], sums[:, -1])[:, None]).sum(1)
    pairs = (row[:, None] * words + w[:, :-1]) * 4 + a[:, order:]
    weight = np.cumsum(1 + np.bincount(pairs.ravel(), minlength=rows * words * 4).reshape(-1, 4), axis=1).astype(np.uint64)
    out = np.empty((rows, n), np.int64)
    for j in range(order):
        out[:, j] = state // 4 ** (order - 1 - j) % 4
    steps = np.ascontiguousarray(drawn[:, order:].T).astype(np.uint64)
    for k, r in enumerate(steps):
        own = weight[row * words + state]
        at = r * own[:, 3] >> np.uint64(32)
        out[:, order + k] = symbol = (at >= own[:, 0]).astype(np.int64) + (at >= own[:, 1]) + (at >= own[:, 2])
        state = state % (words // 4) * 4 + symbol
    return out


def counter_chains(rows: list, names: list[str], seed: int) -> dict[tuple[int, str], str]:
    """The Markov surrogates of `counter_control` by row and kind, where so many windows have one length that steps
    together are fewer than steps of each."""
    codes = [K.encode(r.sequence).astype(np.int64) for r in rows]
    by_length: dict[int, list[int]] = {}
    for i, a in enumerate(codes):
        by_length.setdefault(len(a), []).append(i)
    out = {}
    for kind in (n for n in names if n in ("markov1", "markov2", "markov3")):
        order = int(kind[-1])
        for n, members in by_length.items():
            if n <= order or len(members) ** 2 < n:
                continue
            most = max(1, TOGETHER // n)
            for b in range(0, len(members), most):
                part = members[b : b + most]
                drawn = np.stack([draws(np.arange(n), seed, rows[i].organism, rows[i].replicate, kind) for i in part])
                made = LETTERS[_chains(np.stack([codes[i] for i in part]), order, drawn)]
                out |= {(i, kind): x.tobytes().decode() for i, x in zip(part, made, strict=True)}
    return out


LETTERS = np.frombuffer(b"ACGT", np.uint8)


def counter_control(seq: str, kind: str, block: int, *parts: object) -> str:
    """A control by keyed draws of places. Surrogates are of the symbols A, C, G and T alone."""
    n = len(seq)
    match kind:
        case "revcomp":
            return seq.translate(str.maketrans("ACGTacgt", "TGCAtgca"))[::-1].upper()
        case "shuffle":
            raw = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)
            return raw[np.argsort(draws(np.arange(n), *parts, kind), kind="stable")].tobytes().decode("latin-1")
        case "block_shuffle":
            if n <= block:
                return seq
            order = np.argsort(draws(np.arange(-(-n // block)), *parts, kind), kind="stable")
            return "".join(seq[b * block : (b + 1) * block] for b in order.tolist())
        case _ if kind in ("markov0", "markov1", "markov2", "markov3"):
            a, order = K.encode(seq).astype(np.int64), int(kind[-1])
            drawn = draws(np.arange(len(a)), *parts, kind)
            if order == 0 or len(a) <= order:
                sums = np.cumsum(np.bincount(a, minlength=4))
                return LETTERS[np.searchsorted(sums, _below(drawn, sums[-1]), "right")].tobytes().decode() if len(a) else ""
            return LETTERS[_chain(a, order, drawn)].tobytes().decode()
    raise ValueError(f"unknown control: {kind}")


#: Controls beyond the built-in ones: name -> fn(sequence, rng).
CUSTOM: dict = {}


def register_control(name: str, fn) -> None:
    """Adds a control. `fn(sequence, rng)` must be importable or picklable by the workers."""
    CUSTOM[name.strip().lower().replace("-", "_")] = fn


def control_names(names) -> list[str]:
    out = [n.strip().lower().replace("-", "_") for n in names]
    out = ["block_shuffle" if n == "blockshuffle" else n for n in out]
    return list(dict.fromkeys(n for n in out if n not in ("", "none", "observed")))


def sliced(rows: Iterator[tuple], columns, size: int = SLICE) -> Iterator[pd.DataFrame]:
    """Rows with a sequence as frames of about `size` symbols, so that a batch's controls are never held at once."""
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += len(r.sequence)
        if held >= size:
            yield pd.DataFrame(out, columns=columns)
            out, held = [], 0
    if out:
        yield pd.DataFrame(out, columns=columns)


def with_controls(windows: DataFrame, names=("shuffle", "markov1", "revcomp"), seed: int = 42, block: int = 500, counter: bool = False) -> DataFrame:
    """Observed windows and their controls. One generator per window serves its controls in order; with `counter`
    every place of a control has a draw of its own, keyed by seed, window and kind, so that a control does not
    depend on which others are made. Reverse complements alone stay in the JVM."""
    names = control_names(names)
    if not set(names) - {"revcomp"}:
        return windows.unionByName(windows.withColumns({"source": F.lit("revcomp"), "sequence": revcomp(F.col("sequence"))})) if names else windows
    custom = {n: CUSTOM[n] for n in names if n in CUSTOM}  # travels with the function
    for n in names:
        custom.get(n) or control("A", n, random.Random(0))

    def make(seq: str, kind: str, rng: random.Random) -> str:
        return custom[kind](seq, rng) if kind in custom else control(seq, kind, rng, block)

    def parts(pdf: pd.DataFrame) -> Iterator[list]:
        out, held = [], 0
        for r in pdf.itertuples(index=False):
            out.append(r)
            held += len(r.sequence)
            if held >= TOGETHER:
                yield out
                out, held = [], 0
        yield out

    def made(pdf: pd.DataFrame):
        for rows in parts(pdf):
            chains = counter_chains(rows, [n for n in names if n not in custom], seed) if counter else {}
            for i, r in enumerate(rows):
                yield r
                rng = random.Random(stable_seed(seed, r.organism, r.replicate))
                for n in names:
                    if (i, n) in chains:
                        yield r._replace(source=n, sequence=chains[i, n])
                    else:
                        yield r._replace(source=n, sequence=make(r.sequence, n, rng) if n in custom or not counter else counter_control(r.sequence, n, block, seed, r.organism, r.replicate))

    def work(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            yield from sliced(made(pdf), pdf.columns)

    # `end` is no Python name trouble here, but column order is fixed for the tuples.
    cols = ["organism", "accession", "organism_type", "source", "replicate", "start", "end", "sequence"]
    return windows.select(*cols).mapInPandas(work, windows.select(*cols).schema)


GROUPS = {
    "complexity": (("lz_ratio",), lambda s, c: {"lz_ratio": K.zlib_ratio(s)}),
    "fft": (K.FFT, lambda s, c: K.spectrum(s)),
    "svd": (("svd_entropy_ratio",), lambda s, c: {"svd_entropy_ratio": K.svd_entropy(s)}),
    "mfdfa": (("dfa_proxy_alpha_mean", "dfa_proxy_width"), lambda s, c: K.dfa(s)),
    "resonance": (K.RESONANCE, lambda s, c: K.resonance(s, c.resonance_max_period)),
    "grammar": (K.GRAMMAR, lambda s, c: K.grammar(s, c.grammar_sketch_dim, c.grammar_levels)),
}


def register_group(name: str, columns: tuple[str, ...], fn) -> None:
    """Adds a feature group: `fn(sequence, config)` gives a dict of `columns`; enable it in Config.features."""
    GROUPS[name] = (columns, fn)


def kernel_features(df: DataFrame, groups, config, keep: list[str]) -> DataFrame:
    """keep... and the numeric features of the chosen groups, in one Arrow pass over `sequence`."""
    chosen = [GROUPS[g] for g in groups]  # travels with the function
    names = [n for columns, _ in chosen for n in columns]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} double" for n in names])

    def work(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            rows = [{k: v for _, fn in chosen for k, v in fn(s or "", config).items()} for s in pdf.sequence]
            out = pd.DataFrame(rows, columns=names, dtype=float, index=pdf.index)
            yield pd.concat([pdf[keep], out.where(np.isfinite(out))], axis=1)

    return df.select(*keep, "sequence").mapInPandas(work, schema)


def per_record(df: DataFrame, schema: str, fn) -> DataFrame:
    """name and the dict that `fn` makes of each sequence."""
    cols = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            rows = [{"name": n, **fn(s or "")} for n, s in zip(pdf.name, pdf.sequence, strict=True)]
            yield pd.DataFrame(rows, columns=cols)

    return df.select("name", "sequence").mapInPandas(work, schema)
