import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from strandline.llm import ngram_join
from strandline.llm.components import components
from strandline.llm.storage import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, size=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return {rows[i][0]: (min(groups[find(i)]), links[i], len(sets[i])) for i in range(len(rows))}


def data():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(3, 300))]
        if rng.random() < 0.5:
            base[1:1] = passage
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    rows = [" ".join(t) for t in texts] + ["", "", None, "one", "One!", "two words", "É a b c d e", "é a b c d e", "x " * 20_000]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = data()
    out = ngram_join.classes(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string")).collect()
    want = brute(rows)
    assert {r.doc_id: (r.class_id, r.n_links, r.n_shingles) for r in out} == want
    assert all(r.kept == (r.class_id == r.doc_id) for r in out)


def test_splitting_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "ROWS", 5)
    monkeypatch.setattr(ngram_join, "COMMON", 2)
    rows = data()
    out = ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.n_shingles) for r in out} == brute(rows)


def test_rows_alike_without_id_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z")], "doc_id long, text string")
    out = ngram_join.classes(df).collect()
    assert sorted((r.class_id is None, r.n_links, r.kept) for r in out) == [(False, 2, False), (False, 2, False), (False, 2, True), (True, 0, True)]
    assert ngram_join.classes(df.limit(0)).count() == 0


def test_no_link_is_lost_on_a_whole_table(spark):
    """Recall is 1 on 10,000 documents: all links that SQL counts from common shingles."""
    sf = "/root/testdata/sf0.1"
    out = ngram_join.classes(spark.read.parquet(f"{sf}/documents.parquet")).selectExpr("doc_id", "n_links").where("n_links > 0").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    links = ngram_join.ORACLE.split("     reach AS")[0].rstrip().rstrip(",") + " SELECT a, count(*) FROM e GROUP BY a"
    assert {r.doc_id: r.n_links for r in out} == dict(con.execute(links).fetchall())


def test_kernels_against_brute_force(monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 5)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.choice(np.concatenate((np.arange(12), np.arange(100, 400))), rng.integers(0, 40))) for _ in range(300)]
    at, token = np.cumsum([0, *map(len, sets)]), np.concatenate(sets)
    rows = np.arange(0, 300, 2)
    for part, shared in ngram_join._shared(token, at, rows, 300):
        assert [[len(np.intersect1d(sets[i], y)) for y in sets] for i in part[:20]] == shared[:20].tolist()
    sig = rng.integers(0, 3, (200, ngram_join.WIDTH)).astype(np.int32)
    sig[50:120] = sig[7]
    sig[60:90, :20] = 9
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", 0)
    for first, second in ((np.arange(200), np.arange(200)), (np.arange(0, 200, 2), np.arange(1, 200, 2))):
        a, b = ngram_join._near_pairs(sig, first, second, 30)
        assert ngram_join._near_labels(sig, first, second, 30).tolist() == ngram_join._labels(200, a, b).tolist()


def test_runs_are_as_many_as_the_recall_asks():
    assert [ngram_join.runs_needed(t, 0.9999) for t in (0.8, 0.6, 0.5)] == [4, 11, 26]
    with pytest.raises(ValueError):
        ngram_join.runs_needed(0.3, 0.9999)


def test_components_of_a_long_path(spark):
    rng = random.Random(2)
    name = list(range(3000))
    rng.shuffle(name)
    edges = [(name[k], name[k + 1]) for k in range(2999) if k % 1000 != 999] + [(5, 5), (None, 3)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "path")).collect()}
    for k in range(0, 3000, 1000):
        assert {got[x] for x in name[k : k + 1000]} == {min(name[k : k + 1000])}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "none")).count() == 0
