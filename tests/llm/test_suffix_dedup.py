import hashlib
import random
from collections import Counter

import numpy as np

from strandline.llm import suffix_dedup


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + length] for r in raw for k in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(r)) if gone[k] and (not k or not gone[k - 1]))
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(30, 120))) for _ in range(5)]
    texts = []
    for _ in range(60):
        t = " ".join(word() for _ in range(rng.randint(1, 200)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            k = rng.randrange(len(t) + 1)
            t = t[:k] + p[a : a + rng.randint(100, 600)] + t[k:]
        texts.append(t)
        if rng.random() < 0.3:
            k = rng.randrange(len(t) + 1)
            texts.append(t[:k] + "!" + t[k:])
    return texts + ["", None, "a" * 199, "b" * 200, "c" * 201, "xyz" * 400, texts[0], texts[0], "ab" * 100, "ab" * 100, "long " * 20_000]


def check(spark, texts, length=200):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, m string")
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, length=length).collect()}
    assert out == dict(enumerate(brute(texts, length)))


def test_kernel_against_brute_force():
    rng = np.random.default_rng(3)
    for length in (9, 20, 200):
        for _ in range(5):
            x = rng.integers(97, 100, 3000).astype(np.uint8)
            x[1000:1500] = x[200:700]
            x[2000:2300] = 97
            raw = x.tobytes()
            seen = Counter(raw[k : k + length] for k in range(len(raw) - length + 1))
            want = [seen[raw[k : k + length]] > 1 for k in range(len(raw) - length + 1)]
            assert suffix_dedup.repeated_places(np.append(x, np.uint8(255)), length)[: len(want)].tolist() == want


def test_against_brute_force(spark):
    check(spark, corpus())


def test_hot_minima_are_split(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "DIVIDES", 2)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    check(spark, corpus(2))


def test_rows_alike_and_empty(spark):
    df = spark.createDataFrame([(1, "z" * 10 + "ab" * 150), (1, "z" * 10 + "ab" * 150), (None, "q " * 200)], "doc_id long, text string")
    out = suffix_dedup.remove_repeats(df, with_text=True).collect()
    assert sorted(r.n_removed for r in out) == [310, 310, 400]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
