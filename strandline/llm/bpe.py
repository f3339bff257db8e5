"""BPE encoding and decoding by a pair occurrence index.

All distinct unseen words of a partition's buffer are laid out as one symbol array. An index maps
each adjacent pair (by its merge rank) to all its positions; active ranks are applied in ascending
order at all their positions at once, and only the lists of the neighbouring pairs are updated.
Words repeat, so each distinct word is merged once per worker and found again by its 64-bit hash; its
symbols are compared each time, and should two words ever share a hash, another hash function is taken.

Results are those of the tokenizers library with add_special_tokens=False; classes of characters are
asked of the library, and texts with characters newer than Unicode 3.2 are normalised by it, since tables
of other libraries differ there. Null and empty texts give no ids. A special token's string in a text
becomes its id, as there. Repeated rows are encoded each, an empty table gives an empty table. A very
long text is one buffer of its worker, in memory some forty bytes a symbol; no text is cut. Extra columns
are passed on by encode() and decode(), but for one with the name of the new column, which it replaces.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from strandline.llm import vectext as V
from strandline.llm.storage import by_position

NONE = np.int32(2**31 - 1)
FEW = 12
#: Symbols hashed at once, and symbols gathered before unseen words are merged.
CHUNK, BUFFER = 1 << 19, 8 << 20
#: A worker forgets its words beyond this many.
MOST_WORDS = 1_000_000


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return [out[b] for b in range(256)]


class Vocabulary:
    """Merges and byte strings of a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.lowercase = spec["normalizer"] is not None
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str if self.lowercase else None
        symbols = byte_symbols()
        first = [vocab[c] for c in symbols]
        self.first = np.array(first, np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in symbols], np.int32)
        left, right, new = [], [], []
        for a, b in model["merges"]:
            left.append(vocab[a])
            right.append(vocab[b])
            new.append(vocab[a + b])
        self.size = max(max(vocab.values()), max((t["id"] for t in spec["added_tokens"]), default=0)) + 1
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.right, self.new = np.array(right, np.int32), np.array(new, np.int32)
        self.left = np.array(left, np.int32)
        self.rank_of = dict(zip(key.tolist(), range(len(key)), strict=True))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(symbols)}
        pieces = [b""] * self.size
        # Without a decoder the library joins the vocabulary's own strings by blanks.
        self.spaced = spec["decoder"] is None
        for text, i in vocab.items():
            pieces[i] = f"{text} ".encode() if self.spaced else bytes(back[c] for c in text)
        for text, i in self.special.items():
            pieces[i] = f"{text} ".encode() if self.spaced else text.encode()
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_words(sym: np.ndarray, v: Vocabulary) -> np.ndarray:
    """`sym` holds words, each followed by -1. Applies every merge; returns what is left."""
    n = len(sym)
    sym = sym.copy()
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank = np.full(n, NONE, np.int32)
    rank[:-1] = v.rank(sym[:-1], sym[1:])
    live = np.ones(n, bool)
    at = np.flatnonzero(rank != NONE)
    order = np.argsort(rank[at], kind="stable")
    at = at[order]
    active, begin = np.unique(rank[at], return_index=True)
    index: dict[int, list | np.ndarray] = dict(zip(active.tolist(), np.split(at, begin[1:]), strict=True)) if len(at) else {}
    heap = active.tolist()
    rank_of, new_of, none = v.rank_of, v.new, int(NONE)
    while heap:
        r = heapq.heappop(heap)
        positions = index.pop(r)
        twin = v.left[r] == v.right[r]
        new = int(new_of[r])
        if len(positions) <= FEW or twin:
            for p in sorted(set(map(int, positions))):
                if rank[p] != r or not live[p]:
                    continue
                q = int(after[p])
                nn = int(after[q])
                sym[p], live[q], rank[q] = new, False, NONE
                after[p] = nn
                if nn < n:
                    before[nn] = p
                for x in (int(before[p]), p):
                    if x < 0:
                        continue
                    y = int(after[x])
                    k = rank_of.get(int(sym[x]) << 32 | int(sym[y]), none) if y < n and sym[x] >= 0 and sym[y] >= 0 else none
                    rank[x] = k
                    if k != none:
                        if k in index:
                            index[k] = [*index[k], x] if isinstance(index[k], np.ndarray) else index[k]
                            if index[k][-1] != x:
                                index[k].append(x)
                        else:
                            index[k] = [x]
                            heapq.heappush(heap, k)
            continue
        p = np.unique(np.asarray(positions))
        p = p[(rank[p] == r) & live[p]]
        if not len(p):
            continue
        q = after[p]
        nn = after[q]
        sym[p] = new
        live[q] = False
        rank[q] = NONE
        after[p] = nn
        before[nn[nn < n]] = p[nn < n]
        x = before[p]
        x = np.unique(np.concatenate((x[x >= 0], p)))
        y = after[x]
        ok = (y < n) & (sym[x] >= 0)
        k = np.full(len(x), NONE, np.int32)
        k[ok] = v.rank(sym[x[ok]], sym[y[ok]])
        rank[x] = k
        x, k = x[k != NONE], k[k != NONE]
        if not len(x):
            continue
        order = np.argsort(k, kind="stable")
        x, k = x[order], k[order]
        cuts = np.flatnonzero(np.diff(k)) + 1
        for rk, xs in zip(k[np.concatenate(([0], cuts))].tolist(), np.split(x, cuts), strict=True):
            if rk in index:
                index[rk] = [*index[rk], *xs.tolist()] if len(xs) + len(index[rk]) <= 4 * FEW else np.concatenate((np.asarray(index[rk], np.int64), xs))
            else:
                index[rk] = xs
                heapq.heappush(heap, rk)
    return sym[live]


def gpt_tokens(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces that byte-level pre-tokenisation cuts code points into."""
    n = len(cp)
    kind = V.kinds(cp)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= cut[:n]
    s = np.flatnonzero(start)
    e = np.append(s[1:], n)
    # The last white-space character before other text stands alone; a blank joins what follows.
    before_text = (kind[s] == V.SPACE) & ~cut[e]
    last = e[before_text] - 1
    start[last] = True
    joined = last[cp[last] == 0x20] + 1
    start[joined] = False
    is_joined = np.zeros(n + 1, bool)
    is_joined[joined] = True
    _contractions(cp, kind, cut, start, s, e, is_joined)
    s = np.flatnonzero(start)
    return s, np.append(s[1:], n)


def _contractions(cp, kind, cut, start, s, e, is_joined) -> None:
    """An apostrophe alone, with 's 't 'm 'd 're 've 'll behind it, takes those letters."""
    one = s[(e - s == 1) & (cp[s] == 0x27) & ~is_joined[s]]
    one = one[(one + 1 < len(cp))]
    one = one[~cut[one + 1]]
    if not len(one):
        return
    a = cp[one + 1]
    single = np.isin(a, [ord(c) for c in "stmd"])
    two = one + 2 < len(cp)
    two[two] &= ~cut[one[two] + 2]
    b = np.where(two, cp[np.minimum(one + 2, len(cp) - 1)], 0)
    double = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    for hit, size in ((one[single], 2), (one[double & ~single], 3)):
        start[hit + 1] = False
        end = hit + size
        start[end[end < len(cp)]] = True


def clip_tokens(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for lower-cased words: white space is dropped, each number character stands alone."""
    n = len(cp)
    kind = V.kinds(cp)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= cut[:n] | (kind == V.NUMBER)
    s = np.flatnonzero(start)
    _contractions(cp, kind, cut, start, s, np.append(s[1:], n), np.zeros(n + 1, bool))
    s = np.flatnonzero(start)
    e = np.append(s[1:], n)
    keep = kind[s] != V.SPACE
    return s[keep], e[keep]


class Encoder:
    """Encodes texts; keeps the ids of words it has met."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.salt = 0
        self._forget()

    def _forget(self) -> None:
        self.points, self.word_at, self.word_len = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, n + 1 offsets) of the texts."""
        v, raw = self.v, texts
        special = [k for k, t in enumerate(texts) if any(x in t for x in v.special)]
        if special:
            return self._with_specials(texts, set(special))
        if v.lowercase:
            texts = [v.normalize(t) if V.any_newer(t) else unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() for t in texts]
        words, docs, met = [], [], {}
        counts = [np.zeros(1, np.int64)]
        at = np.cumsum([0, *map(len, texts)])
        for a, b in V.chunks(at, CHUNK):
            cp = np.frombuffer("".join(texts[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32)
            off = at[a : b + 1] - at[a]
            s, e = (clip_tokens if v.lowercase else gpt_tokens)(cp, off)
            h = V.span_hashes(cp, s, e, self.salt)
            counts.append(np.diff(V.rows_of(s, off)))
            uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            size = e - s
            known, place = self._find(uniq)
            old, mine = place[known], first[known]
            alike = V.same_spans(cp, s, size, cp, s[first][inverse], size[first][inverse])
            alike = alike and V.same_spans(cp, s[mine], size[mine], self.points, self.word_at[old], self.word_len[old])
            new = np.flatnonzero(~known)
            for u, x, y in zip(uniq[new].tolist(), s[first[new]].tolist(), e[first[new]].tolist(), strict=True):
                word = cp[x:y].tobytes()
                alike = alike and met.setdefault(u, word) == word
            if not alike:  # two words with one hash
                self.salt += 1
                self._forget()
                return self.encode(raw)
            words.append(uniq)
            docs.append(inverse.astype(np.int32))
        if met:
            self._learn(np.fromiter(met, np.uint64, len(met)), list(met.values()))
        parts = []
        for uniq, inverse in zip(words, docs, strict=True):
            k = np.searchsorted(self.known, uniq)[inverse] if len(uniq) else np.zeros(0, np.int64)
            parts.append((self.at[k], self.len[k]))
        begin = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.int64)
        size = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.int32)
        per_doc = np.cumsum(np.concatenate(counts))
        ids = self.pool[V.ragged(begin, size.astype(np.int64))]
        ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        if len(self.known) > MOST_WORDS:
            self._forget()
        return ids, ends[per_doc]

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is known, and its place."""
        if not len(self.known):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        k = np.searchsorted(self.known, h)
        k[k == len(self.known)] = 0
        return self.known[k] == h, k

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        v = self.v
        points = np.frombuffer(b"".join(words), np.uint32)
        ends = np.cumsum([len(w) // 4 for w in words])
        symbols = np.diff(ends, prepend=0)
        word_at = np.concatenate((self.word_at, ends - symbols + len(self.points)))
        self.points = np.concatenate((self.points, points))
        data = np.frombuffer(points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        wide = np.concatenate(([0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))))
        ends = wide[ends]
        size = np.diff(ends, prepend=0)
        where = np.arange(len(data)) + np.repeat(np.arange(len(words)), size)
        sym = np.full(len(data) + len(words), -1, np.int32)
        sym[where] = v.first[data]
        if v.suffix:
            sym[where[ends - 1]] = v.last[data[ends - 1]]
        out = merge_words(sym, v)
        stop = np.flatnonzero(out < 0)
        length = (np.diff(stop, prepend=-1) - 1).astype(np.int32)
        begin = np.cumsum(length, dtype=np.int64) - length + len(self.pool)
        self.pool = np.concatenate((self.pool, out[out >= 0]))
        known = np.concatenate((self.known, hashes))
        order = np.argsort(known)
        self.known, self.word_at, self.word_len = known[order], word_at[order], np.concatenate((self.word_len, symbols))[order]
        self.at = np.concatenate((self.at, begin))[order]
        self.len = np.concatenate((self.len, length))[order]

    def _with_specials(self, texts: list[str], special: set[int]) -> tuple[np.ndarray, np.ndarray]:
        import re

        cut = re.compile("(" + "|".join(map(re.escape, sorted(self.v.special, key=len, reverse=True))) + ")")
        pieces: list[str] = []
        marks: list[tuple[int, int]] = []
        owner = []
        for k, t in enumerate(texts):
            for p in cut.split(t) if k in special else [t]:
                if k in special and p in self.v.special:
                    marks.append((len(pieces), self.v.special[p]))
                    p = ""
                pieces.append(p)
                owner.append(k)
        ids, off = self.encode(pieces)
        at = np.array([m for m, _ in marks])
        ids = np.insert(ids, off[at], [i for _, i in marks])
        size = np.diff(off)
        size[at] += 1
        per_doc = np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(per_doc)))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def decode_ids(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> list[bytes]:
    """UTF-8 of each row's text; byte sequences that are no text become U+FFFD."""
    size = v.piece_len[ids]
    at = np.concatenate(([0], np.cumsum(size)))[offsets].tolist()
    data = v.piece_bytes[V.ragged(v.piece_at[ids], size)].tobytes()
    if v.spaced:
        return [data[a : max(a, b - 1)] for a, b in zip(at, at[1:], strict=False)]
    return [data[a:b].decode("utf-8", "replace").encode() for a, b in zip(at, at[1:], strict=False)]


def encoded(batches: Iterable[pa.RecordBatch], text: str, path: str, buffer: int = BUFFER) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, offsets) of every batch, in slices of about `buffer` bytes of text."""
    enc = encoder(path)
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        _, off = V.column_bytes(col)
        for a, b in V.chunks(off, buffer):
            texts = [t or "" for t in col.slice(a, b - a).to_pylist()]
            yield batch.slice(a, b - a), *enc.encode(texts)


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Every row with its token ids in a new column `ids`; a column of that name is replaced."""
    df = df.drop(ids)
    inner, column = by_position(df), f"c{df.columns.index(text)}"
    schema = T.StructType([*inner.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def work(batches):
        for rows, flat, off in encoded(batches, column, tokenizer_path):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, pa.int32()))], schema.names)

    return inner.mapInArrow(work, schema).toDF(*df.columns, ids)


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Every row with the text of its ids in a new column; null ids give an empty text."""
    df = df.drop(text)
    inner, column = by_position(df), df.columns.index(ids)
    schema = T.StructType([*inner.schema.fields, T.StructField("text", T.StringType(), False)])

    def work(batches):
        v = vocabulary(tokenizer_path)
        for batch in batches:
            lists = batch.column(column)
            size = np.asarray(lists.value_lengths().fill_null(0))
            out = decode_ids(np.asarray(lists.flatten(), np.int64), np.concatenate(([0], np.cumsum(size, dtype=np.int64))), v)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.decode() for x in out], pa.string())], schema.names)

    return inner.mapInArrow(work, schema).toDF(*df.columns, text)


def round_trip_digests(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """encode() and decode() in one pass of a worker, so that neither ids nor texts travel back:
    key, n_tokens, and the SHA-256 of the ids (little-endian, 32 bits) and of the decoded text."""

    def work(batches):
        v = vocabulary(tokenizer_path)
        for rows, flat, off in encoded(batches, text, tokenizer_path):
            raw, at = flat.astype("<u4").tobytes(), (off * 4).tolist()
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
            back = [hashlib.sha256(x).hexdigest() for x in decode_ids(flat, off, v)]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(key)), pa.array(np.diff(off), pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(work, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_path(name: str) -> str:
    """Place of a vocabulary file; the folder is $TOKENIZERS_DIR or the installed package."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
