import math
import random
import re

from strandline.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def compare(df):
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    out = licenses.digest(licenses.scan(df)).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))
    return {r.doc_id: r for r in out}


def test_whole_table(spark, sf):
    compare(spark.read.parquet(f"{sf}/documents.parquet"))


def test_odd_texts(spark):
    texts = [None, "", "CC BY", "cc-by-nc 4.0", "all rights reserved all rights reserved", "x " * 50_000 + "General Public License", "GENERAL\nPUBLIC\tLICENSE", "général public license", "ÀLL rights reserved", "all rights", "by cc", "cc cc by by", "general public cc by license", "Released under the MIT License."]
    rows = [(k, t, 0) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    out = compare(df)
    assert out[13].labels == "mit" and out[3].labels == "cc-by,cc-by-nc"
    assert licenses.digest(licenses.scan(df.limit(0))).count() == 0


def test_key_phrase_is_mandatory(spark):
    df = spark.createDataFrame([(1, "released under the mit license"), (2, "released under the bsd license"), (3, "it was licensed under the apache license version 2 0")], "doc_id long, text string")
    out = {r.doc_id: r.labels for r in licenses.digest(licenses.scan(df)).collect()}
    assert out == {1: "mit", 2: "", 3: "apache-2.0"}


def unanchored(texts, templates=licenses.TEMPLATES):
    """Labels of every start of every template, by plain loops."""
    docs = [WORD.findall(t.lower()) for t in texts]
    idf = lambda w: max(1e-3, math.log((len(docs) + 1) / (sum(w in d for d in docs) + 0.5)))
    out = []
    for d in docs:
        labels = set()
        for t in templates:
            words = t.text.split()
            weight = [idf(w) for w in words]
            for start in range(-len(words), len(d)):
                agrees = [0 <= start + p < len(d) and d[start + p] == w for p, w in enumerate(words)]
                if not any(agrees):
                    continue
                keys = []
                for k in (k.split() for k in t.keys):
                    p = next(p for p in range(len(words)) if words[p : p + len(k)] == k)
                    keys += agrees[p : p + len(k)]
                score = sum(w for w, a in zip(weight, agrees, strict=True) if a) / sum(weight)
                if all(keys) and (all(agrees) if t.whole else score >= t.threshold):
                    labels.add(t.label)
        out.append(",".join(sorted(labels)))
    return out


def test_near_copies_against_all_starts(spark):
    rng = random.Random(5)
    texts = ["permission is hereby granted free of charge to any person getting a copy of this software and related help files", "charge person copy software hereby granted free any", "obtaining documentation associated"]
    for _ in range(300):
        words = rng.choice(licenses.TEMPLATES).text.split()
        for _ in range(rng.randint(0, 8)):
            k = rng.randrange(len(words))
            if rng.random() < 0.7:
                words[k] = rng.choice(["thing", "the", "license", "obtaining", "public"])
            elif len(words) > 1:
                del words[k]
        if rng.random() < 0.3:
            words = words[rng.randrange(len(words)) :]
        texts.append(" ".join(["so"] * rng.randint(0, 3) + words + ["end"] * rng.randint(0, 3)))
    out = licenses.digest(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert [r.labels for r in sorted(out, key=lambda r: r.doc_id)] == unanchored(texts)
    assert "mit" in {r.doc_id: r.labels for r in out}[0]


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, "all rights reserved", "x", 2)], "doc_id long, text string, `a.b` string, hits int")
    out = licenses.scan(df)
    assert out.columns == ["doc_id", "text", "a.b", "n_words", "hits"] and out.first().n_words == 3
