import hashlib
import math

import numpy as np
import pytest

from strandline.llm import vector_codes as VC


def plain(rows, parts=16, entries=64, scale=256, rounds=2):
    """{position of a row: (code, error)} and the codebooks, by full scans in Python's integers."""
    good = [(k, i, [math.floor(scale * x) for x in v]) for k, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(good[0][2]) // parts
    good.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    cut = [[tuple(v[p * w : p * w + w]) for p in range(parts)] for _, _, v in good]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(held[e]) for x in zip(*held[e], strict=True)) if e in held else b for e, b in enumerate(books[p])]
    out = {}
    for (k, _, _), c in zip(good, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out[k] = ("".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found))
    return out, books


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1) for (i, v), lab in rows], "vec_id long, embedding array<double>, label string, code string, `a.b` int")


def test_against_full_scans(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 64)) / 8
    x[200:430] = x[7] + rng.normal(size=(230, 64)) / 500  # a third lies close together
    x[430:520] = x[3]  # repeated rows
    rows = [(int(k), v.tolist()) for k, v in zip(rng.permutation(700), x, strict=True)]
    rows += [(900, None), (901, [None] * 64), (902, [float("nan")] * 64), (903, [float("inf")] * 64), (904, [1.0] * 6), (None, x[1].tolist())]
    labels = [None if k % 5 == 0 else f"l{k % 3}" for k in range(len(rows))]
    out = VC.digest(frame(spark, zip(rows, labels, strict=True)).repartition(3)).collect()
    want, books = plain([r if r[0] != 904 else (904, None) for r in rows])
    total = {}
    for k, (_, e) in want.items():
        total[labels[k]] = total.get(labels[k], 0) + e
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in out) == sorted((str(rows[k][0]), c, e, total[labels[k]]) for k, (c, e) in want.items())
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in out} == {sha}


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_rounds_and_small_blocks(spark, rounds):
    rng = np.random.default_rng(rounds)
    rows = [(k, (rng.integers(0, 12, 8) / 4).tolist()) for k in range(240)]  # many ties
    df = frame(spark, zip(rows, ["a"] * 240, strict=True))
    got, books = VC.compress(df, parts=4, entries=16, scale=4, rounds=rounds, block_rows=50)
    want, plain_books = plain(rows, 4, 16, 4, rounds)
    assert books.tolist() == [[list(e) for e in b] for b in plain_books]
    assert {r.k: (r.code, r.error) for r in got.collect()} == want


def test_few_rows_and_none(spark):
    rows = [(5, [0.5, -0.25]), (2, [0.001, -0.001]), (9, [0.5, -0.25])]
    df = frame(spark, zip(rows, [None, None, "z"], strict=True))
    out, books = VC.compress(df, parts=4)  # filled up with zeros to four parts of one component
    assert books.shape == (4, 3, 1) and books[:, 0, 0].tolist() == [0, -1, 0, 0] and books[:, 1, 0].tolist() == [128, -64, 0, 0]
    assert {r.k: r.code for r in out.collect()} == {2: "00000000", 5: "01010000", 9: "01010000"}
    assert VC.digest(df.limit(0)).count() == 0 and VC.digest(df.limit(0)).columns == VC.digest(df).columns
    one = VC.digest(df.where("vec_id = 2")).collect()
    assert [(r.code, r.error, r.label_error) for r in one] == [("00" * 16, 0, 0)]
    empty = frame(spark, [((1, []), "a"), ((2, []), "a")])
    assert sorted((r.vec_id, r.code, r.error) for r in VC.digest(empty).collect()) == [(1, "00" * 16, 0), (2, "00" * 16, 0)]


def test_large_components(spark):
    rows = [(k, [k * 1e4 + 0.5] * 16) for k in range(80)]  # integers beyond the exact range of products in doubles
    got, _ = VC.compress(frame(spark, zip(rows, ["a"] * 80, strict=True)), label=None, entries=8)
    assert {r.k: (r.code, r.error) for r in got.collect()} == plain(rows, 16, 8)[0]
    with pytest.raises(ValueError):
        VC.compress(frame(spark, [((1, [1e30] * 16), "a")]))


def test_only_violated_parts_are_popped():
    rng = np.random.default_rng(4)
    centres = rng.integers(-900, 900, (6, 4, 3))
    x = (centres[rng.integers(0, 6, 400)] + rng.integers(-9, 10, (400, 4, 3))).astype(np.int32)
    books = centres.transpose(1, 0, 2).astype(np.int64)
    block, drift = VC.Block.fresh(x, books, True), np.zeros((4, 6))
    for _ in range(3):
        new = books + rng.integers(-3, 4, books.shape)
        moved = np.sqrt(((new - books) ** 2).sum(2))
        drift, books = drift + moved + moved.max(1, keepdims=True), new
        block = VC.Block.read(block.columns()[:4], books, True)
        assert block.step(drift) < 400  # of 1,600
        full = ((x[:, :, None] - books[None]) ** 2).sum(3).argmin(2)
        assert (block.assigned() == full).all()
        for heap in block.heaps:
            assert all((np.diff(k) >= 0).all() for k in np.split(heap.key, np.cumsum(heap.size)[:-1]))
