"""The length that zlib's level 9 gives a long string of four symbols, without walking its chains.

Of 64 possible words of three symbols, zlib's chains hold hundreds of places each, and it tries them one by one. Here
every place's longest earlier match comes from sorts of words with their places, one sort a length; then the same
lazy choice is made, and a block's Huffman lengths are figured as zlib figures them. What is rare (long copies in
large numbers) is left to zlib itself, and so is everything where zlib is not the one known here."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

REACH, CHAIN, FAR, LONGEST, GOOD, BLOCK = 32506, 4096, 4096, 258, 32, 16383
LEAST = 1 << 14  # shorter strings have short chains
MIDDLE = 9  # symbols of a usual match
EXTRA_L = [0] * 8 + [k for k in range(1, 6) for _ in range(4)] + [0]
EXTRA_D = [0, 0] + [k for k in range(14) for _ in range(2)]
EXTRA_B = [0] * 16 + [2, 3, 7]
FIRST_D = np.cumsum([1] + [1 << k for k in EXTRA_D[:-1]])
CODE_L = np.append(np.searchsorted(np.cumsum([3] + [1 << k for k in EXTRA_L[:-2]]), np.arange(LONGEST), "right") - 1, 28)
FIXED_L = [8] * 144 + [9] * 112 + [7] * 24 + [8] * 8
ORDER_B = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


def compressed_length(raw: bytes) -> int:
    """len(zlib.compress(raw, 9))."""
    n = len(raw)
    if n < LEAST or not _known():
        return len(zlib.compress(raw, 9))
    return _length(raw) or len(zlib.compress(raw, 9))


@lru_cache(maxsize=1)
def _known() -> bool:
    """Whether this process's zlib is the one that is followed here."""
    rng = np.random.default_rng(5)
    raw = np.frombuffer(b"ACGT", np.uint8)[rng.choice(4, 90_000, p=(0.3, 0.1, 0.05, 0.55))].tobytes()
    raw += raw[:3000] + raw[40_000:41_000]
    return _length(raw) == len(zlib.compress(raw, 9))


def _length(raw: bytes) -> int | None:
    table = np.full(256, 4, np.uint8)
    table[list(b"ACGT")] = range(4)
    a = table[np.frombuffer(raw, np.uint8)]
    if a.max() > 3:
        return None
    tokens = _tokens(raw, a)
    if tokens is None:
        return None
    parts = [tokens[k : k + BLOCK] for k in range(0, len(tokens), BLOCK)]
    if len(parts[-1]) == BLOCK and tokens[-1] > 255:  # a match that fills a block closes it; the last one is empty
        parts.append(tokens[:0])
    return 6 + (sum(map(_block_bits, parts)) + 7) // 8


def _matches(a: np.ndarray):
    """Longest earlier match of every place, up to `cap` symbols, and its distance, in one number; the nearest earlier
    place whose first `cap` symbols are the same; the least place that a chain reaches; and places by their words of
    three, with ranks. Most matches have `MIDDLE` symbols or more: all places go up from there, and only those without
    a match go down."""
    n = len(a)
    bits = n.bit_length()
    cap = (64 - bits) // 2
    found, same_cap = np.zeros(n, np.int32), np.full(n, -1, np.int32)
    mask, shift, wide, words = np.uint64((1 << bits) - 1), np.uint64(bits), a.astype(np.uint64), {1: a.astype(np.uint64)}
    for k in range(2, MIDDLE + 1):
        words[k] = words[k - 1][:-1] << np.uint64(2) | wide[k - 1 :]

    def ordered(k: int) -> np.ndarray:
        return np.sort(words[k] << shift | np.arange(n - k + 1, dtype=np.uint64))

    key = ordered(3)
    by_word, word, rank = (key & mask).view(np.int64), key >> shift, np.empty(n, np.int32)
    rank[by_word] = np.arange(n - 2)
    least = np.maximum(np.arange(n) - REACH + 1, 1)
    full = np.flatnonzero(word[CHAIN:] == word[:-CHAIN])
    least[by_word[full + CHAIN]] = np.maximum(least[by_word[full + CHAIN]], by_word[full])
    gap = np.flatnonzero((word[1:] == word[:-1]) & (np.diff(by_word) == REACH) & (by_word[:-1] > 0))
    least[by_word[gap + 1]] = by_word[gap]

    key = ordered(MIDDLE)
    for k in range(MIDDLE, cap + 1):
        at, word = (key & mask).view(np.int64), key >> shift
        t = np.flatnonzero((word[1:] == word[:-1]) & (at[:-1] >= least.take(at[1:])))
        i, j = at.take(t + 1), at.take(t)
        found[i] = k << 16 | i - j
        if k == cap:
            same_cap[i] = j
            break
        keep = np.zeros(len(at), bool)
        keep[t] = keep[t + 1] = True
        keep = np.flatnonzero(keep & (at + k < n))
        if not len(keep):
            break
        at, word = at.take(keep), word.take(keep)
        key = np.sort((word << np.uint64(2) | wide[at + k]) << shift | at.view(np.uint64))
    alone = found == 0
    for k in range(MIDDLE - 1, 2, -1):
        key = ordered(k)
        at = (key & mask).view(np.int64)
        t = np.flatnonzero(alone[at[1:]])
        i, j = at[t + 1], at[t]
        own = (key[t + 1] >> shift == key[t] >> shift) & (j >= least[i])
        i, j = i[own], j[own]
        if k == 3:
            i, j = i[i - j <= FAR], j[i - j <= FAR]
        found[i] = k << 16 | i - j
        alone[i] = False
    return cap, found, same_cap, least, by_word, rank


def _tokens(raw: bytes, a: np.ndarray) -> np.ndarray | None:
    """Symbols as their bytes, matches as length and distance in one number; None where long copies are many."""
    n = len(raw)
    cap, found, same_cap, least, by_word, rank = _matches(a)
    code = (a[:-2].astype(np.int64) * 4 + a[1:-1]) * 4 + a[2:]
    matches = found.tolist()
    left = n  # of tries of long copies

    def longer(i: int, known: int) -> int:
        nonlocal left
        low, most = int(least[i]), min(LONGEST, n - i)
        if known >= GOOD and (back := int(rank[i]) - CHAIN // 4) >= 0 and code[by_word[back]] == code[i]:
            low = max(low, int(by_word[back]))
        best, where, j = 0, 0, int(same_cap[i])
        while j >= low and left > 0:
            left -= 2
            if raw[i : i + best + 1] == raw[j : j + best + 1] or not best:
                a, b = max(cap, best + 1), most + 1  # what is known to agree, and not to
                while b - a > 1:
                    mid = (a + b) // 2
                    a, b = (mid, b) if raw[i + a : i + mid] == raw[j + a : j + mid] else (a, mid)
                best, where = a, i - j
                if best >= most:
                    break
            j = int(same_cap[j])
        return best << 16 | where

    out: list[int] = []
    put = out.append
    i, held, waiting, whole, most = 0, 0, False, cap << 16, LONGEST << 16
    while i < n:
        match = matches[i]
        if match >= whole:
            match = longer(i, held >> 16) if held < most else 0
            if left <= 0:
                return None
        if held and match >> 16 <= held >> 16:
            put(held)
            i += (held >> 16) - 1
            held, waiting = 0, False
        else:
            if waiting:
                put(raw[i - 1])
            waiting = True
            held = match
            i += 1
    if waiting:
        put(raw[-1])
    return np.array(out, np.int64)


def _block_bits(tokens: np.ndarray) -> int:
    lit = tokens[tokens < 256]
    match = tokens[tokens > 255]
    lengths = CODE_L[match >> 16]
    back = np.searchsorted(FIRST_D, match & 0xFFFF, "right") - 1
    count_l = (np.bincount(lit, minlength=286) + np.bincount(lengths + 257, minlength=286)).tolist()
    count_l[256] = 1
    count_d = np.bincount(back, minlength=30).tolist()
    extra_l, extra_d = [0] * 257 + EXTRA_L, EXTRA_D
    fixed = sum(c * (FIXED_L[k] + extra_l[k]) for k, c in enumerate(count_l) if c) + sum(c * (5 + extra_d[k]) for k, c in enumerate(count_d) if c)
    len_l, own_l = _huffman(count_l, 15, extra_l)
    len_d, own_d = _huffman(count_d, 15, extra_d)
    count_b = [0] * 19
    for lens in (len_l, len_d):
        _runs(lens, count_b)
    len_b, own_b = _huffman(count_b, 7, EXTRA_B)
    len_b += [0] * (19 - len(len_b))
    last = next((k for k in range(18, 2, -1) if len_b[ORDER_B[k]]), 2)
    own = own_l + own_d + own_b + 3 * (last + 1) + 14
    return 3 + (fixed if (fixed + 10) >> 3 <= (own + 10) >> 3 else own)


def _runs(lens: list[int], count: list[int]) -> None:
    """Adds the numbers of the codes that tell the lengths of a tree."""
    before, run, most, least = -1, 0, 138 if lens[0] == 0 else 7, 3 if lens[0] == 0 else 4
    for k, now in enumerate(lens):
        after = lens[k + 1] if k + 1 < len(lens) else 0xFFFF
        run += 1
        if run < most and now == after:
            continue
        if run < least:
            count[now] += run
        elif now:
            count[now] += now != before
            count[16] += 1
        else:
            count[17 if run <= 10 else 18] += 1
        run, before = 0, now
        most, least = (138, 3) if after == 0 else (6, 3) if now == after else (7, 4)


def _huffman(count: list[int], longest: int, extra: list[int]) -> tuple[list[int], int]:
    """Lengths by symbol, up to the last that occurs, and all bits: zlib's heap, in which depths part equal counts, and
    its way to cut what is too long."""
    n = len(count)
    freq, depth, heap = count + [0] * n, [0] * (2 * n), [0]
    heap += [k for k, c in enumerate(count) if c]
    top = heap[-1] if len(heap) > 1 else -1
    forced = 0
    while len(heap) < 3:
        if top < 2:
            top += 1
            node = top
        else:
            node = 0
        heap.append(node)
        freq[node] = 1
        forced += 1

    def down(k: int) -> None:
        v, size = heap[k], len(heap) - 1
        own = (freq[v], depth[v])
        j = 2 * k
        while j <= size:
            x = (freq[heap[j]], depth[heap[j]])
            if j < size and (y := (freq[heap[j + 1]], depth[heap[j + 1]])) <= x:
                j, x = j + 1, y
            if own <= x:
                break
            heap[k] = heap[j]
            k, j = j, 2 * j
        heap[k] = v

    for k in range((len(heap) - 1) // 2, 0, -1):
        down(k)
    dad, taken, node = [0] * (2 * n), [], n
    while len(heap) > 2:
        one = heap[1]
        heap[1] = heap[-1]
        heap.pop()
        down(1)
        two = heap[1]
        taken += [one, two]
        freq[node], depth[node] = freq[one] + freq[two], max(depth[one], depth[two]) + 1
        dad[one] = dad[two] = heap[1] = node
        node += 1
        down(1)
    lens, of_length, over = [0] * (2 * n), [0] * (longest + 1), 0
    for k in reversed(taken):
        size = lens[dad[k]] + 1
        if size > longest:
            size, over = longest, over + 1
        lens[k] = size
        if k <= top:
            of_length[size] += 1
    if over:
        while over > 0:
            size = longest - 1
            while not of_length[size]:
                size -= 1
            of_length[size] -= 1
            of_length[size + 1] += 2
            of_length[longest] -= 1
            over -= 2
        leaves = iter([k for k in taken if k <= top])
        for size in range(longest, 0, -1):
            for _ in range(of_length[size]):
                lens[next(leaves)] = size
    bits = sum(freq[k] * (lens[k] + extra[k]) for k in range(top + 1) if lens[k]) - forced
    return lens[: top + 1], bits
