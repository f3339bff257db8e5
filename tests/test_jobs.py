"""The two jobs: against SQL, on growing input, after failures, on odd rows and from the command line."""

import glob
import math
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.errors import StreamingQueryException

from jobs import catalogue, common, queries, word_profiles

from .conftest import SF
from .test_catalog import comparable

ROOT = str(Path(__file__).resolve().parents[1])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    out = queries.QUERIES[name](spark, SF)
    cols = sorted(out.columns)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    assert comparable(tuple(r[c] for c in cols) for r in out.collect()) == comparable(rel.select(*(f'"{c}"' for c in cols)).fetchall())


def plain_profiles(rows, words=(1, 2, 3)):
    """{(lang, source, k, kmer): cnt} by loops over texts."""
    out = Counter()
    for text, lang, source in rows:
        s = "".join(c for c in (text or "").upper().replace("U", "T") if c in "ACGT")
        for k in words:
            for i in range(len(s) - k + 1):
                out[((lang or "").strip() or "unknown", (source or "").strip() or "unknown", k, s[i : i + k])] += 1
    return dict(out)


def found(spark, out):
    rows = word_profiles.read(spark, out).collect()
    assert len({(r.lang, r.source, r.k, r.kmer) for r in rows}) == len(rows)
    return {(r.lang, r.source, r.k, r.kmer): r.cnt for r in rows}


def files(folder):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


SCHEMA = "doc_id long, text string, lang string, source string, extra string"


def put(spark, folder, number, rows):
    spark.createDataFrame([(k, *r, "x") for k, r in enumerate(rows)], SCHEMA).coalesce(1).write.parquet(f"{folder}/new{number}")
    os.makedirs(f"{folder}/in", exist_ok=True)
    for p in glob.glob(f"{folder}/new{number}/*.parquet"):
        os.rename(p, f"{folder}/in/f{number}.parquet")


FIRST = [("ACGTACGU", "en", "a"), ("gattaca", "en", "b"), (None, "de", "a"), ("", "de", "a"), ("AAAA", None, " "), ("xyz", "1", "a")]
SECOND = [("CCGG", "de", "a"), ("ACGT" * 3000, "1", "a"), ("ACGTACGU", "en", "a")]


def test_growing_input(spark, tmp_path):
    at = str(tmp_path)
    put(spark, at, 1, FIRST)
    run = lambda: word_profiles.run(spark, f"{at}/in", f"{at}/out", f"{at}/mark")
    assert run() == {"rows": 6, "profiles": 2}  # `de` and `1` have no words yet
    assert found(spark, f"{at}/out") == plain_profiles(FIRST)
    before = files(f"{at}/out/increments")
    same = files(f"{at}/out/profiles/lang=unknown")
    put(spark, at, 2, SECOND)
    assert run() == {"rows": 3, "profiles": 3}  # only the new file
    assert found(spark, f"{at}/out") == plain_profiles(FIRST + SECOND)
    now = files(f"{at}/out/increments")
    assert all(now[p] == t for p, t in before.items()) and len(now) > len(before)
    assert files(f"{at}/out/profiles/lang=unknown") == same  # a language without news stays as it is
    for r in word_profiles.read(spark, f"{at}/out").where("lang = '1' and k = 2").collect():
        assert math.isclose(r.share, r.cnt / 11_999) and math.isclose(r.rho, r.share * 16)
    everything = files(f"{at}/out")
    assert run() == {"rows": 0, "profiles": 0}
    assert files(f"{at}/out") == everything


def test_runs_after_failures(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    put(spark, at, 1, FIRST)
    put(spark, at, 2, SECOND)
    run = lambda: word_profiles.run(spark, f"{at}/in", f"{at}/out", f"{at}/mark", max_files=1)
    right, calls = word_profiles.read_or_empty, []

    def fails_once(session, path, schema):
        calls.append(path)
        if len(calls) == 2:  # the second batch has been written, but not committed
            raise RuntimeError("lost")
        return right(session, path, schema)

    monkeypatch.setattr(word_profiles, "read_or_empty", fails_once)
    with pytest.raises(StreamingQueryException):
        run()
    assert not os.path.exists(f"{at}/out/profiles")
    # The batch comes again under its number, and the profiles of both batches are caught up.
    assert run()["rows"] in (3, 6)
    assert found(spark, f"{at}/out") == plain_profiles(FIRST + SECOND)
    monkeypatch.undo()
    # A run that ended before the marks were written: the next one makes the profiles anew.
    for p in glob.glob(f"{at}/out/marks/*"):
        os.remove(p)
    for p in glob.glob(f"{at}/out/marks/.*"):
        os.remove(p)
    os.rmdir(f"{at}/out/marks")
    assert run() == {"rows": 0, "profiles": 4}
    assert found(spark, f"{at}/out") == plain_profiles(FIRST + SECOND)


def plain_catalogue(rows, min_length, spread=3.0):
    recs = {}
    for doc_id, text, lang, source in sorted(rows, key=lambda r: r[0]):
        key = (lang or "unknown", f"{lang or 'unknown'}_{source or 'unknown'}_{doc_id // 10}")
        recs[key] = recs.get(key, "") + "".join(c for c in (text or "").upper().replace("U", "T") if c in "ACGT")
    recs = {k: s for k, s in recs.items() if s}
    words = [a + b for a in "ACGT" for b in "ACGT"]

    def share(s):
        n = Counter(s[i : i + 2] for i in range(len(s) - 1))
        return [n[w] / (len(s) - 1) if len(s) > 1 else 1 / 16 for w in words]

    away, flags = {}, {}
    for t in {t for t, _ in recs}:
        v = {k: share(s) for k, s in recs.items() if k[0] == t}
        mean = [sum(x) / len(v) for x in zip(*v.values(), strict=True)]
        for k, p in v.items():
            away[k] = 2 * math.acos(max(0.0, min(1.0, sum(math.sqrt(a * b / sum(mean)) for a, b in zip(p, mean, strict=True)))))
    for k, s in recs.items():
        peers = [d for (t, _), d in away.items() if t == k[0]]
        mean = sum(peers) / len(peers)
        sd = math.sqrt(sum((d - mean) ** 2 for d in peers) / len(peers))
        n = Counter(s[i : i + 3] for i in range(len(s) - 2))
        h = -sum(c / sum(n.values()) * math.log2(c / sum(n.values())) for c in n.values()) / 6
        told = (len(s) < min_length, h < 0.5, any(o == s and k2[1] < k[1] for k2, o in recs.items()), len(peers) >= 8 and away[k] > mean + spread * sd)
        flags[k] = ",".join(f for f, x in zip(catalogue.FLAGS, told, strict=True) if x)
    return flags, away


def test_catalogue(spark, tmp_path):
    import random

    rng = random.Random(4)
    word = lambda n, of="ACGT": "".join(rng.choice(of) for _ in range(n))
    rows = [(k, word(40), "en", f"s{k % 3}") for k in range(100)]
    rows += [(k + 100, "AT" * 30, "en", "s9") for k in range(10)]  # plain, and far from the others of its type
    rows += [(k + 200, t, "de", "x") for k, t in ((0, word(50)), (1, None), (2, ""))] + [(210, rows[-1][1], None, None), (220, "A", "fr", "y"), (230, "-.-", "fr", "z")]
    copy = rows[0:10]
    rows += [(k + 300, t, "zz", "c") for k, (_, t, _, _) in enumerate(copy)] + [(k + 310, t, "zz", "c") for k, (_, t, _, _) in enumerate(copy)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    first = catalogue.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", block=10, min_length=60)
    got = {(r.organism_type, r.name): r for r in catalogue.read(spark, f"{tmp_path}/out").collect()}
    flags, away = plain_catalogue(rows, 60)
    assert {k: r.flags for k, r in got.items()} == flags
    assert {"short", "plain", "repeat", "outlier"} <= {f for v in flags.values() for f in v.split(",")}
    assert all(abs(r.distance - away[k]) < 1e-7 for k, r in got.items())
    assert first == {"documents": len(rows), "records": len(flags), "accepted": sum(not f for f in flags.values())}
    kept = spark.read.parquet(f"{tmp_path}/out/sequences").collect()
    assert {(r.organism_type, r.name) for r in kept} == {k for k, f in flags.items() if not f}
    told = {r.organism_type: r for r in spark.read.csv(f"{tmp_path}/out/summary", header=True, inferSchema=True).collect()}
    assert told["zz"].repeat == 1 and sum(r.records for r in told.values()) == len(flags)
    # Again: the same rows.
    assert catalogue.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", block=10, min_length=60) == first
    assert {(r.organism_type, r.name): r for r in catalogue.read(spark, f"{tmp_path}/out").collect()} == got


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    assert catalogue.run(spark, f"{tmp_path}/in", f"{tmp_path}/out") == {"documents": 0, "records": 0, "accepted": 0}
    assert catalogue.read(spark, f"{tmp_path}/out").count() == 0
    assert word_profiles.run(spark, f"{tmp_path}/in", f"{tmp_path}/words", f"{tmp_path}/mark") == {"rows": 0, "profiles": 0}
    assert word_profiles.read(spark, f"{tmp_path}/words").count() == 0


def test_settings(tmp_path):
    chosen = common.settings("", "word_profiles.json", ["--input", "a", "--output", "b", "--checkpoint", "c", "--words", "2", "4"])
    assert chosen == {"input": "a", "output": "b", "checkpoint": "c", "words": [2, 4], "max_files": 1000}
    (tmp_path / "own.json").write_text('{"input": "q", "output": "", "spread": 2.0}')
    assert common.settings("", "catalogue.json", ["--config", f"{tmp_path}/own.json", "--output", "r"]) == {"input": "q", "output": "r", "spread": 2.0}
    with pytest.raises(SystemExit):
        common.settings("", "catalogue.json", ["--input", "a"])


@pytest.mark.parametrize("job", ["word_profiles", "catalogue"])
def test_command_line(spark, tmp_path, job):
    more = ["--checkpoint", f"{tmp_path}/mark"] if job == "word_profiles" else ["--min-length", "100"]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--input", f"{SF}/documents*", "--output", f"{tmp_path}/out", *more], cwd=ROOT, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 200" in done.stderr
    out = word_profiles.read(spark, f"{tmp_path}/out") if job == "word_profiles" else catalogue.read(spark, f"{tmp_path}/out")
    assert out.count() > 50
