import itertools
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import language as L


def plain_counts(text):
    """Slots by loops over the bytes of the folded text."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    low = b" " + b" ".join(bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in low).split(b" ")) + b" "
    # One blank of each run inside; one more at either end.
    inner = low[1:-1]
    kept = bytes(b for k, b in enumerate(inner) if b != 32 or k == 0 or inner[k - 1] != 32)
    low = b" " + kept + b" "
    out = {}
    for n in L.ORDERS:
        for k in range(len(low) - n + 1):
            h = int.from_bytes(low[k : k + n], "big") * int(L.FACTOR[n - 1]) & 0xFFFFFFFF
            h = (h ^ h >> 15) * int(L.FACTOR[0]) & 0xFFFFFFFF
            out[h >> 32 - L.BITS] = out.get(h >> 32 - L.BITS, 0) + 1
    return out


def test_counts_against_loops(monkeypatch):
    texts = ["", "A", "Über  die, Brücke 3x", "été", "  two  blanks ", "x" * 70, "ab " * 50]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for size in (L.SLICE, 7):  # texts longer than a slice are counted across slices
        monkeypatch.setattr(L, "SLICE", size)
        got = L.counts(*L.letters(data, off))
        for row, t in zip(got, texts, strict=True):
            assert {int(k): int(row[k]) for k in np.flatnonzero(row)} == plain_counts(t)


def test_codewords():
    assert L.codewords(0).shape == (0, 0) and L.codewords(1).shape == (1, 0)
    for n in (2, 3, 4, 7, 8, 40):
        code = L.codewords(n)
        columns = {tuple(c * c[0]) for c in code.T.tolist() for c in [np.array(c)]}
        assert len(columns) == code.shape[1] if n <= 7 else code.shape[1] == 15 * math.ceil(math.log2(n))
        assert all(abs(sum(c)) < n for c in columns)
        least = min((a != b).sum() for a, b in itertools.combinations(code, 2))
        assert least == 2 ** (n - 2) if n <= 7 else least > code.shape[1] / 5
    assert (L.codewords(9) == L.codewords(9)).all()


def test_decoding_against_loops():
    rng = np.random.default_rng(1)
    code, margin = L.codewords(5), rng.normal(size=(20, 15)) * 2
    trust = L.trusted(np.where(rng.random((50, 15)) < 0.8, 1, -1), np.arange(50) % 5, code)
    assert np.allclose(trust.sum(1), 1)
    m = L.Model(list("abcde"), code, trust, np.zeros((1, 15)), np.zeros(15))
    best, score, tied = L.decide(margin, m, 0.05)
    for r in range(20):
        loss = [sum(trust[k][j] * math.exp(-code[k][j] * margin[r][j]) for j in range(15)) for k in range(5)]
        order = sorted(range(5), key=lambda k: loss[k])
        assert best[r] == order[0] and 0 < score[r] <= 1
        assert tied[r] == (math.log(loss[order[1]]) - math.log(loss[order[0]]) < 0.05)
        assert abs(score[r] - 1 / sum((loss[order[0]] / x) ** 2 for x in loss)) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in L.digest(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(rows) == len(out)
    assert all(out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    fresh = [r for r in rows if out[r.doc_id].held_out]
    assert sum(out[r.doc_id].lang_pred == r.lang for r in fresh) >= 0.98 * len(fresh)
    # Held-out labels play no part, and neither does the layout.
    other = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).repartition(5)
    assert {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in L.digest(other).collect()} == {k: (r.lang_pred, round(r.score, 6)) for k, r in out.items()}


def words(rng, alphabet, n):
    return " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 7))) for _ in range(n))


def test_many_languages_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    alphabets = {f"l{k:02d}": "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäöüéèñßø"), 9, replace=False)) for k in range(12)}
    rows = [(n, words(rng, a, 30), la) for n, (la, a) in enumerate((la, a) for la, a in alphabets.items() for _ in range(40))]
    rows += [(n, rows[0][1], "l00") for n in [0] * 300]  # one row, repeated
    odd = [(9000, None, "l01"), (9001, "", "l01"), (9002, "12, 34!", "l02"), (None, words(rng, alphabets["l03"], 40), None), (9003, words(rng, alphabets["l04"], 60_000), None)]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows + odd], "doc_id long, text string, lang string, score double, `a.b` string")
    model = L.train(df, max_rows=360)
    assert model.languages == sorted(alphabets)
    out = L.predict(df, model)
    assert out.columns == ["doc_id", "text", "lang", "a.b", "lang_pred", "score", "ambiguous"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[k].lang_pred for k in (9000, 9001, 9002, None, 9003)] == ["und", "und", "und", "l03", "l04"]
    assert got[9000].score == 0 and 0 < got[9003].score <= 1
    assert sum(got[n].lang_pred == la for n, _, la in rows[:480]) > 460
    assert out.count() == len(rows) + len(odd)


def test_one_language_and_none(spark):
    df = spark.createDataFrame([(1, "hello", "en"), (2, "123", "en"), (3, None, None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.predict(df, L.train(df)).orderBy("doc_id").collect()] == [("en", 1.0), ("und", 0.0), ("und", 0.0)]
    assert {r.lang_pred for r in L.predict(df, L.train(df.limit(0))).collect()} == {"und"}
    assert L.predict(df.limit(0), L.train(df)).count() == 0
    assert L.digest(df.limit(0)).count() == 0
