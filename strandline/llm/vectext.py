"""Vectorised text primitives: whole Arrow string columns as NumPy arrays, without a Python object
per row or word. A word is known by the 64-bit hash of its symbols."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 row offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(offsets: np.ndarray, size: int):
    """Row ranges [a, b) of about `size` symbols; a longer row is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(n, BASE, U64), np.full(n, BASE_INV, U64)
    p[0] = q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of symbols[s:e] for each span; another `salt` is another hash function."""
    n = len(symbols)
    p, q = powers(n + 1)
    acc = np.zeros(n + 1, U64)
    wide = symbols.astype(U64) + U64(1)
    np.cumsum((mix(wide + U64(salt << 32)) if salt else wide) * p[:n], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * q[starts] + (ends - starts).astype(U64))


def same_spans(x: np.ndarray, a: np.ndarray, a_len: np.ndarray, y: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> bool:
    """Whether x[a:a + a_len] and y[b:b + b_len] hold the same symbols for every pair of spans."""
    if not np.array_equal(a_len, b_len):
        return False
    return bool((x[ragged(a, a_len)] == y[ragged(b, b_len)]).all())


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that don't cross row offsets."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    prev = np.zeros(n, bool)
    prev[1:] = mask[:-1]
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    return np.flatnonzero(mask & (~prev | cut[:n])), np.flatnonzero(mask & (~after | cut[1:])) + 1


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index into `starts` where each row begins: row i has starts[out[i]:out[i + 1]]."""
    return np.searchsorted(starts, offsets, "left")


def ragged(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices begin[0], begin[0]+1, ... for every (begin, length), one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(total)


class Classes:
    """Kind of every code point as the tokenizers library's own engine sees it, and whether it is newer
    than Unicode 3.2 (tables of later characters differ between libraries). Blocks are filled when met."""

    BITS = 14

    def __init__(self):
        self.kind = np.zeros(0x110000, np.uint8)
        self.newer = np.zeros(0x110000, bool)
        self.filled = np.zeros(0x110000 >> self.BITS, bool)

    def fill(self, cp: np.ndarray) -> None:
        if not len(cp) or (cp.max() >> self.BITS == 0 and self.filled[0]):
            return
        met = np.unique(cp >> self.BITS)
        for block in met[~self.filled[met]].tolist():
            self._fill_block(block)
            self.filled[block] = True

    def _fill_block(self, block: int) -> None:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        lo, hi = block << self.BITS, (block + 1) << self.BITS
        points = [c for c in range(lo, hi) if not 0xD800 <= c < 0xE000]
        text, at = "".join(map(chr, points)), np.array(points, np.int64)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for _, (x, y) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
                self.kind[at[x:y]] = kind
        old = unicodedata.ucd_3_2_0.category
        self.newer[at] = [old(c) == "Cn" for c in text]


@lru_cache(maxsize=1)
def _classes() -> Classes:
    return Classes()


def kinds(cp: np.ndarray) -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE of each code point."""
    table = _classes()
    table.fill(cp)
    return table.kind[cp]


def any_newer(text: str) -> bool:
    """Whether a text holds characters that Unicode 3.2 had not assigned."""
    if text.isascii():
        return False
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _classes()
    table.fill(cp)
    return bool(table.newer[cp].any())


@lru_cache(maxsize=1)
def word_bytes() -> np.ndarray:
    """True for bytes of words: digits, a-z (after folding) and all from 0x80 up."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


def folded_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, starts, ends, row index) of the words of A-Z-folded rows."""
    low = fold_table()[data]
    s, e = runs(word_bytes()[low], offsets)
    return low, s, e, rows_of(s, offsets)
