import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import toxicity
from strandline.llm import vectext as V


def test_learns_and_ranks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train_on_tables(docs, labels)
    out = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert {r.doc_id % 1 for r in out} == {0}
    fresh = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    bad, good = [r.score for r in fresh if r.toxic], [r.score for r in fresh if not r.toxic]
    auc = sum((a > b) + (a == b) / 2 for a in bad for b in good) / (len(bad) * len(good))
    assert auc > 0.9
    assert sum(s >= 0.5 for s in good) <= 0.02 * len(good)
    # The same rows give the same model.
    again = toxicity.train_on_tables(docs.repartition(5), labels.repartition(3))
    assert (again[0] == model[0]).all() and abs(again[1] - model[1]).max() < 1e-12


def test_odd_rows(spark):
    df = spark.createDataFrame([(k, t, y, "s") for k, (t, y) in enumerate([("bad bad", 1), ("good", 0)] * 20 + [(None, 1), ("", 0), ("x", None), ("long " * 20_000, 0)])], "doc_id long, text string, toxic int, score string")
    model = toxicity.train(df)
    out = {r.text: r.score for r in toxicity.score(df, model).collect()}
    assert out["bad bad"] > 0.5 > out["good"]
    assert out[None] == out[""]
    assert toxicity.score(df.limit(0), model).count() == 0
    assert {r.score for r in toxicity.score(df, toxicity.train(df.limit(0))).collect()} == {0.5}
    assert spark.range(3).select(toxicity.held_out(F.lit(None).cast("long")).alias("h")).where("h").count() == 0


def plain_slots(text, bits=16, skip=2):
    """Features by loops over words; only the hash of a word is the library's."""
    mask = 2**64 - 1

    def mix(h):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> 33) * factor & mask
        return h ^ h >> 33

    def word(w):
        x = np.frombuffer(w, np.uint8)
        return int(V.span_hashes(x, np.array([0]), np.array([len(x)]))[0])

    words = re.findall(rb"[0-9a-z\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
    h = [word(w) for w in words]
    out = set(h)
    for size in (4, 5):
        out |= {mix(word(w[:size]) + (size << 8) & mask) for w in words if len(w) > size}
    for d in range(1, skip + 1):
        out |= {mix(h[k] * 3 + h[k + d] + d & mask) for k in range(len(h) - d)}
    out |= {mix(mix(h[k] * 5 + h[k + 1] & mask) * 7 + h[k + 2] & mask) for k in range(len(h) - 2)}
    return sorted({x >> 64 - bits for x in out})


def test_features_against_loops():
    texts = ["", "One", "one two", "Sprawling sentences, written at 10 o'clock; ÜBER alles", "a b c a b c a", "x" * 30]
    raw = [t.encode() for t in texts]
    slots, at = toxicity.row_slots(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 16)
    assert [slots[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [plain_slots(t) for t in texts]


def test_ftrl_against_a_dictionary():
    rng = random.Random(3)
    rows = [(sorted(rng.sample(range(40), rng.randint(0, 9))), float(rng.random() < 0.4), rng.choice([1.0, 2.5])) for _ in range(400)]
    model = toxicity.Ftrl(6, l1=1.5)
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= 1.5:
            return 0.0
        return -(z[k] - math.copysign(1.5, z[k])) / ((1.0 + math.sqrt(n[k])) / 0.3 + 1.0)

    for slots, y, w in rows:
        model.learn(np.array(slots, np.int64), y, w)
        keys = [*slots, 64]
        g = w * (1 / (1 + math.exp(-sum(map(weight, keys)))) - y)
        for k, old in [(k, weight(k)) for k in keys]:
            z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / 0.3 * old
            n[k] = n.get(k, 0.0) + g * g
    assert np.allclose(model.weights(), [weight(k) for k in range(65)], atol=1e-12)
    assert 0 < np.count_nonzero(model.weights()) < 41


def test_scores_against_a_sum(spark):
    texts = ["some words here", "", None, "other Words HERE again", "some words here"]
    slots = plain_slots("some words here again", toxicity.BITS)
    model = (np.array(slots, np.int32), np.linspace(-1, 2, len(slots)), -0.25)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    out = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    table = dict(zip(slots, np.linspace(-1, 2, len(slots)).astype(np.float32), strict=True))
    for k, t in enumerate(texts):
        total = sum(float(table.get(s, 0.0)) for s in plain_slots(t or "", toxicity.BITS)) - 0.25
        assert abs(out[k] - 1 / (1 + math.exp(-total))) < 1e-9
    assert toxicity.score(df.limit(0), model).count() == 0


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, "some words", "x")], "doc_id long, text string, `a.b` string")
    out = toxicity.score(df, (np.zeros(0, np.int32), np.zeros(0), 0.0))
    assert out.columns == ["doc_id", "text", "a.b", "score"] and out.first().score == 0.5
