"""Licence scans by a positional index of rare words.

Templates are word sequences with a label and mandatory key phrases. A first pass counts in how many
documents of the corpus each licence word occurs. The index maps words to postings (template, position);
a template stands under the rarest word (highest inverse document frequency) of its key phrases, which
every accepted copy holds at that position, so no copy is missed. A scan looks up a file's words there;
the position of a word less that in the template gives a start, the template's other words are
intersected by relative position, the alignment scores the share of the template's IDF that agrees, and
the key phrases are verified word by word. A template that must match whole is found at all its places.

The corpus is read twice and not written in between: in English prose the places of licence words would
come to a third of the text.

Words: A-Z is folded; runs of digits, letters and all bytes from 0x80 up. Null and empty texts hold no
words, no hits and score 0. Very long texts are scanned whole. Repeated rows are scanned each, an empty
table gives an empty table. Alignments that overlap or tie are all returned, in order of template and
start. Extra columns are passed on, but for `n_words` and `hits`, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import vectext as V
from strandline.llm.storage import by_position

CHUNK = 1 << 20


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]
    whole: bool = False
    threshold: float = 0.6


# The base phrases, each of which must match whole.
BASE = (
    Template("cc-by", "cc by", ("cc by",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
)

# Openings of public licence texts and the usual notices.
TEMPLATES = (
    *BASE,
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "this program is free software licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)


def word_hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(V.span_hashes(b, np.array([0]), np.array([len(b)]))[0])


def vocabulary(templates) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words, and their hashes sorted with the word's number."""
    words = sorted({w for t in templates for w in t.text.split()})
    h = np.array([word_hash(w) for w in words], np.uint64)
    order = np.argsort(h)
    return words, h[order], order


def _ids(h: np.ndarray, known: np.ndarray, number: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return np.where(known[at] == h, number[at], -1)


def document_frequencies(df: DataFrame, text: str, templates=TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those with each licence word; as many rows as there are such words."""
    words, known, number = vocabulary(templates)

    def work(batches):
        count, docs = np.zeros(len(words), np.int64), 0
        for batch in batches:
            data, off = V.column_bytes(batch.column(0))
            docs += batch.num_rows
            for a, b in V.chunks(off, CHUNK):
                low, s, e, at = V.folded_words(data[off[a] : off[b]], off[a : b + 1] - off[a])
                ids = _ids(V.span_hashes(low, s, e), known, number) if len(s) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(b - a), np.diff(at))
                both = np.unique(row[ids >= 0] * len(words) + ids[ids >= 0])
                count += np.bincount(both % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(words)), pa.int32()), pa.array([docs, *count], pa.int64())], ["word", "n"])

    got = {r.word: r.n for r in df.select(text).mapInArrow(work, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.get(-1, 0), {w: got.get(k, 0) for k, w in enumerate(words)}


class Index:
    """Templates as word numbers, and the postings of rare words."""

    def __init__(self, templates, n_docs: int, df: dict[str, int]):
        self.templates = templates
        self.words, self.known, self.number = vocabulary(templates)
        at = {w: k for k, w in enumerate(self.words)}
        idf = np.array([np.log((n_docs + 1) / (df.get(w, 0) + 0.5)) for w in self.words])
        idf = np.maximum(idf, 1e-3)
        ids = [np.array([at[w] for w in t.text.split()]) for t in templates]
        self.size = np.array([len(x) for x in ids])
        self.begin = np.cumsum(self.size) - self.size
        self.ids = np.concatenate(ids)
        self.share = np.concatenate([idf[x] / idf[x].sum() for x in ids])
        self.is_key = np.concatenate([_key_places(t) for t in templates])
        postings = []
        for n, x in enumerate(ids):
            p = max(np.flatnonzero(self.is_key[self.begin[n] :][: len(x)]).tolist(), key=lambda p: (idf[x[p]], -p))
            postings.append((int(x[p]), n, p))
        postings.sort()
        word, self.post_template, self.post_place = (np.array(c) for c in zip(*postings, strict=True))
        self.post_at = np.searchsorted(word, np.arange(len(self.words) + 1))
        self.whole = np.array([t.whole for t in templates])
        self.threshold = np.array([t.threshold for t in templates])

    def matches(self, ids: np.ndarray, row_at: np.ndarray):
        """(template, row, start, score) of all accepted alignments, by template, row and start."""
        hits = np.flatnonzero(ids >= 0)
        found = np.diff(self.post_at)[ids[hits]]
        hits, found = hits[found > 0], found[found > 0]
        post = V.ragged(self.post_at[ids[hits]], found)
        number, start = self.post_template[post], np.repeat(hits, found) - self.post_place[post]
        row = np.searchsorted(row_at, np.repeat(hits, found), "right") - 1
        if not len(number):
            return number, row, start, np.zeros(0)
        size = self.size[number]
        first = np.cumsum(size) - size
        own = V.ragged(self.begin[number], size)
        place = V.ragged(start, size)
        inside = (place >= np.repeat(row_at[row], size)) & (place < np.repeat(row_at[row + 1], size))
        agrees = inside & (ids[np.clip(place, 0, len(ids) - 1)] == self.ids[own])
        score = np.add.reduceat(agrees * self.share[own], first)
        good = np.where(self.whole[number], np.logical_and.reduceat(agrees, first), score >= self.threshold[number])
        good &= np.logical_and.reduceat(agrees | ~self.is_key[own], first)
        order = np.flatnonzero(good)
        order = order[np.lexsort((start[order], row[order], number[order]))]
        return number[order], row[order], (start - row_at[row])[order], np.minimum(score[order], 1.0)


def _key_places(t: Template) -> np.ndarray:
    """True for words of a template that belong to a key phrase (its first occurrence there)."""
    words, out = t.text.split(), np.zeros(len(t.text.split()), bool)
    for key in (k.split() for k in t.keys):
        p = next(p for p in range(len(words)) if words[p : p + len(key)] == key)
        out[p : p + len(key)] = True
    return out


HIT = T.ArrayType(T.StructType([T.StructField("template", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("n_words", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def scan(df: DataFrame, text: str = "text", templates=TEMPLATES) -> DataFrame:
    """Every row with `n_words` and `hits`: template number, label, first word (from 0), length, score."""
    df = df.drop("n_words", "hits")
    index = df.sparkSession.sparkContext.broadcast(Index(templates, *document_frequencies(df, text, templates)))
    inner, column = by_position(df), df.columns.index(text)
    schema = T.StructType([*inner.schema.fields, T.StructField("n_words", T.LongType(), False), T.StructField("hits", HIT, False)])
    kind = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int32()), ("score", pa.float64())]))

    def work(batches):
        ix = index.value
        for batch in batches:
            data, off = V.column_bytes(batch.column(column))
            for a, b in V.chunks(off, CHUNK):
                low, s, e, at = V.folded_words(data[off[a] : off[b]], off[a : b + 1] - off[a])
                ids = _ids(V.span_hashes(low, s, e), ix.known, ix.number) if len(s) else np.zeros(0, np.int64)
                hits: list[list] = [[] for _ in range(b - a)]
                for number, r, x, y in zip(*(c.tolist() for c in ix.matches(ids, at)), strict=True):
                    hits[r].append({"template": number, "label": ix.templates[number].label, "start": x, "n_words": int(ix.size[number]), "score": y})
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(np.diff(at), pa.int64()), pa.array(hits, kind)], schema.names)

    return inner.mapInArrow(work, schema).toDF(*df.columns, "n_words", "hits")


def digest(scanned: DataFrame, key: str = "doc_id", n_base: int = len(BASE)) -> DataFrame:
    """doc_id, n_words and what the hits come to; the first `n_base` templates are the base phrases."""
    base = F.filter("hits", lambda h: h["template"] < n_base)
    starts = F.transform(base, lambda h: h["start"])
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    return scanned.select(
        key, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("hits")).alias("labels"), F.round(F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)), 6).alias("score"),
    )


def oracle(templates=TEMPLATES, n_base: int = len(BASE)) -> str:
    """The same as SQL over `documents`: every start at which any word of a template agrees is scored."""
    rows = []
    for n, t in enumerate(templates):
        rows += [f"({n}, '{t.label}', {p}, '{w}', {bool(k)}, {t.whole}, {t.threshold})" for p, (w, k) in enumerate(zip(t.text.split(), _key_places(t), strict=True))]
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
     t AS (SELECT * FROM (VALUES {", ".join(rows)}) AS v(n, label, pos, word, is_key, whole, threshold)),
     p AS (SELECT doc_id, i - 1 AS pos, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) WHERE ws[i] IN (SELECT word FROM t)),
     f AS (SELECT word, count(DISTINCT doc_id) AS df FROM p GROUP BY word),
     x AS (SELECT t.*, greatest(ln(((SELECT count(*) FROM documents) + 1) / (coalesce(df, 0) + 0.5)), 0.001) AS idf FROM t LEFT JOIN f USING (word)),
     y AS (SELECT *, idf / sum(idf) OVER (PARTITION BY n) AS share FROM x),
     c AS (SELECT DISTINCT doc_id, n, p.pos - y.pos AS start FROM p JOIN y USING (word)),
     m AS (SELECT c.doc_id, c.n, c.start, label, whole, threshold, sum(CASE WHEN p.word IS NOT NULL THEN share ELSE 0 END) AS score,
                  bool_and(p.word IS NOT NULL) AS every, bool_and(p.word IS NOT NULL OR NOT is_key) AS keys
           FROM c JOIN y USING (n) LEFT JOIN p ON p.doc_id = c.doc_id AND p.pos = c.start + y.pos AND p.word = y.word
           GROUP BY c.doc_id, c.n, c.start, label, whole, threshold),
     a AS (SELECT * FROM m WHERE keys AND CASE WHEN whole THEN every ELSE score >= threshold END)
SELECT w.doc_id, len(any_value(ws)) AS n_words, count(*) FILTER (a.n < {n_base}) AS n_base, min(a.start) FILTER (a.n < {n_base}) AS first_word,
       max(a.start) FILTER (a.n < {n_base}) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (a.n < {n_base}), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, round(coalesce(max(least(a.score, 1.0)) FILTER (a.n IS NOT NULL), 0.0), 6) AS score
FROM w LEFT JOIN a ON a.doc_id = w.doc_id GROUP BY w.doc_id
"""
