import numpy as np
from tokenizers import Tokenizer

from strandline.llm import bpe, token_counts

PATH = bpe.public_path("byte_bpe_50k.json")


def test_scan_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for stream in range(3):
        ids = rng.integers(0, 6, 400).astype("<u2")
        ids[100:200] = 1
        cuts = np.sort(rng.integers(0, 401, 60))
        for k, part in enumerate(np.split(ids, cuts)):
            rows.append((stream, k, bytearray(part.tobytes())))
        size, n = 0, 0
        for x in ids:
            if x == 5:
                want[stream, n] = (size, True)
                size, n = 0, n + 1
            else:
                size += 1
        if size:
            want[stream, n] = (size, False)
    df = spark.createDataFrame(rows, "stream long, block long, content binary")
    out = token_counts.scan(df, 5).collect()
    assert {(r.stream, r.ordinal): (r.n_tokens, r.ended) for r in out} == want


def test_documents(spark, tmp_path):
    texts = ["", None, "one two", "x" * 3000, "y " * 4000, "same", "same"]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, "z", 1)], "doc_id long, text string, stream int")
    tk = Tokenizer.from_file(PATH)
    out = {r.doc_id: r.n_tokens for r in token_counts.count_documents(df, PATH, 50256, f"file://{tmp_path}/a", block_bytes=64).collect()}
    assert out == {**{k: len(tk.encode(t or "").ids) for k, t in enumerate(texts)}, None: len(tk.encode("z").ids)}
    assert token_counts.count_documents(df.limit(0), PATH, 50256, f"file://{tmp_path}/b").count() == 0


def test_end_identifier_in_texts(spark, tmp_path):
    texts = ["plain", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> c", "", "last one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tk = Tokenizer.from_file(PATH)
    for name, end in (("special", 50256), ("word", tk.encode("plain").ids[0])):
        out = [(r.doc_id, r.n_tokens) for r in token_counts.count_documents(df, PATH, end, f"file://{tmp_path}/{name}", block_bytes=8).collect()]
        assert sorted(out) == [(k, len(tk.encode(t).ids)) for k, t in enumerate(texts)]
