import hashlib
import random
import re

import numpy as np

from strandline.llm import exact_dedup

TEXTS = ["a  b", "a\tb", "a b", "", None, " ", "x" * 100_000, "x" * 100_000, "a b ", "é", "é"]


def test_against_brute_force(spark):
    rows = [(k * 7 % 11, t, None) for k, t in enumerate(TEXTS)] + [(3, "a b", "x"), (3, "a b", "x"), (None, "a b", "x"), (None, "only", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sha string")
    out = exact_dedup.dedup(df, rows_per_run=2, fan_bits=1).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(hashlib.sha256(norm(t).encode()).hexdigest(), []).append(i)
    assert len(out) == len(rows)
    for r in out:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == (min(known) if known else None)
    for sha in groups:
        assert sum(r.kept for r in out if r.text_sha256 == sha) == 1


def test_empty(spark):
    assert exact_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_runs(spark):
    rng = random.Random(6)
    rows = [(k, f"text {min(rng.randrange(400), rng.randrange(400))}") for k in range(5000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = exact_dedup.dedup(df, rows_per_run=100, fan_bits=2).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    text = dict(rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out) == sorted((i, min(groups[text[i]]), len(groups[text[i]]), i == min(groups[text[i]])) for i in text)


def test_merge_verifies_whole_digests():
    rng = np.random.default_rng(2)
    runs = []
    for k in range(4):
        x = np.zeros(500, exact_dedup.ENTRY)
        x["d0"], x["d1"], x["size"] = np.sort(rng.integers(0, 300, 500)), rng.integers(0, 2, 500), rng.integers(0, 2, 500)
        x["id"], x["none"], x["uid"], x["copies"] = rng.integers(0, 50, 500), rng.integers(0, 2, 500), k * 500 + np.arange(500), 1
        runs.append(x)
    want = {}
    for x in np.concatenate(runs).tolist():
        want.setdefault(x[:5], []).append((x[5:8], x[8]))
    want = {d: (min(v)[0], sum(c for _, c in v)) for d, v in want.items()}
    segments = sorted(((9, int(part["d0"][0]), part) for x in map(exact_dedup.united, runs) for part in np.array_split(x, 7)), key=lambda s: s[:2])
    parts = [p for _, p in exact_dedup.merge_segments((b, p.tobytes()) for b, _, p in segments)]
    got = np.concatenate(parts)
    assert (np.diff(got["d0"].astype(np.int64)) >= 0).all()
    assert {x[:5]: (x[5:8], x[8]) for x in got.tolist()} == want and len(got) == len(want)
