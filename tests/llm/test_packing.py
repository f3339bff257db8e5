import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from strandline.llm import bpe, packing

PATH = bpe.public_path("word_bpe_49k.json")


def checked(rows, texts, seq_len, max_segments=256):
    tk = Tokenizer.from_file(PATH)
    want = {k: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for k, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
    assert set(by_doc) == set(want)
    for k, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[k])
            at += r.length
        assert at == len(want[k])
    padding = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= seq_len and len(own) <= max_segments
        padding += 0 if at & (at - 1) == 0 else seq_len - at
    return padding


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    assert checked(packing.pack(df, PATH).collect(), texts, 4096) == 0


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "word " * 30_000, 4: "a", 5: "x <|endoftext|>"}
    df = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, part int")
    assert checked(packing.pack(df, PATH, seq_len=64, max_segments=2, pool=4).collect(), texts, 64, 64) == 0
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_loss_limit(spark):
    df = spark.createDataFrame([(k, "tell me now " * (k % 7), "yes it is " * (k % 11)) for k in range(200)], "doc_id long, ask string, text string")
    out = packing.pack(df, PATH, prompt="ask", seq_len=128, max_loss=40, pool=64, with_ids=True).collect()
    loss = defaultdict(int)
    for r in out:
        loss[r.sequence_id] += r.loss_tokens
        assert len(r.ids) == r.length
    assert max(loss.values()) <= 40
    assert sum(loss.values()) == sum(3 * (k % 11) + 1 for k in range(200))


def test_replies_under_three_limits(spark):
    turns = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    rows = {(r.conv_id, r.turn): r for r in turns.collect()}
    own = {f"{c}:{t}": (r.text, rows[c, t - 1].text if (c, t - 1) in rows else "") for (c, t), r in rows.items() if r.role == "assistant"}
    out = packing.pack(packing.replies(turns).coalesce(1), PATH, key="key", prompt="prompt", seq_len=2048, max_segments=8, max_loss=1536).collect()
    tk = Tokenizer.from_file(PATH)
    size = lambda t: len(tk.encode(t or "", add_special_tokens=False).ids)
    by_key, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_key[r.key].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_key) == set(own)
    for k, (text, prompt) in list(own.items())[:300]:
        assert sum(r.length for r in by_key[k]) == size(prompt) + size(text) + 1 == by_key[k][0].doc_tokens
        assert sum(r.loss_tokens for r in by_key[k]) == size(text) + 1
    limits = {"length": 2048, "loss_tokens": 1536}
    for c, most in limits.items():
        sums = [sum(getattr(r, c) for r in s) for s in by_seq.values()]
        assert max(sums) <= most
    assert max(map(len, by_seq.values())) <= 8
    full = {c: sum(sum(getattr(r, c) for r in s) == most for s in by_seq.values()) for c, most in limits.items()}
    assert full["loss_tokens"] > 0 and full["length"] > 0 and any(len(s) == 8 for s in by_seq.values())  # each limit is met


def test_odd_replies(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 0, "user", "0"), (2, 0, "assistant", None), (None, 1, "assistant", "c"), (3, 0, None, "d"), (None, None, "assistant", "e")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, prompt int")
    got = packing.replies(df).collect()
    assert len(got) == 5
    assert {(r.key, r.prompt, r.text) for r in got} == {("1:1", "0", "b"), ("2:0", None, None), ("1", None, "c"), ("", None, "e")}
    assert packing.replies(df.limit(0)).count() == 0
