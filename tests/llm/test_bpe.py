import hashlib
import random
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from strandline.llm import bpe
from strandline.llm import vectext as V

ODD = ["", " ", "it's we're ''s  's\n's", "x <|endoftext|> y<|endoftext|>", "ΑΣ Σ İ ǅ", "½ ²3 Ⅷ 123", "é ́x", "日本語 😀😀", "a" * 5000, "x\x1c\x85y"]


def texts():
    rng = random.Random(3)
    letters = "aab's tledrvm  \n\t'’.,é日Σ1½́ 😀 "
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(800)]


def test_ids_equal_the_library():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = bpe.public_path(name)
        ids, off = bpe.Encoder(path).encode(texts())
        want = Tokenizer.from_file(path).encode_batch(texts(), add_special_tokens=False)
        for k, w in enumerate(want):
            assert ids[off[k] : off[k + 1]].tolist() == w.ids, texts()[k]


def test_encode_decode_frames(spark):
    path = bpe.public_path("byte_bpe_50k.json")
    rows = [(k, t, "x") for k, t in enumerate([*ODD, None])] + [(None, "dup", None), (None, "dup", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, path), path).collect()
    assert len(out) == len(rows)
    assert all(r.decoded == (r.text or "") for r in out)
    assert bpe.encode(df.limit(0), path).count() == 0


def test_digests(spark):
    path = bpe.public_path("byte_bpe_50k.json")
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*ODD, None])], "doc_id long, text string")
    tk = Tokenizer.from_file(path)
    for r in bpe.round_trip_digests(df, path).collect():
        ids = tk.encode([*ODD, ""][r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_every_assigned_character():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 256 == 0 or unicodedata.category(chr(c)) not in ("Cn", "Co"))]
    lines = ["".join(f"a{chr(c)}b 1{chr(c)} {chr(c)}s " for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = bpe.public_path(name)
        ids, off = bpe.Encoder(path).encode(lines)
        want = Tokenizer.from_file(path).encode_batch(lines, add_special_tokens=False)
        assert [hex(points[64 * k]) for k, w in enumerate(want) if ids[off[k] : off[k + 1]].tolist() != w.ids] == []


def test_two_words_with_one_hash(monkeypatch):
    true = V.span_hashes
    monkeypatch.setattr(V, "span_hashes", lambda x, s, e, salt=0: true(x, s, e, salt) if salt > 1 else true(x, s, e, salt) % V.U64(50))
    path = bpe.public_path("byte_bpe_50k.json")
    enc, tk = bpe.Encoder(path), Tokenizer.from_file(path)
    for part in (["one two"], texts()):
        ids, off = enc.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == [tk.encode(t, add_special_tokens=False).ids for t in part]
    assert enc.salt == 2


def test_decode_as_the_library(spark):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):  # one with a decoder, one without
        path = bpe.public_path(name)
        tk = Tokenizer.from_file(path)
        rows = [(k, tk.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts())] + [(-1, None)]
        out = bpe.decode(spark.createDataFrame(rows, "`a.b` long, ids array<int>"), path).collect()
        assert {r["a.b"]: r.decoded for r in out} == {k: tk.decode(i or [], skip_special_tokens=False) for k, i in rows}


def test_names_with_dots(spark):
    path = bpe.public_path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, `a.b` string")
    out = bpe.decode(bpe.encode(df, path), path)
    assert out.columns == ["doc_id", "text", "a.b", "ids", "decoded"] and out.first().decoded == "a b"
