"""The cache of sequences as a data source: stored, read, fetched with retries, and on odd input."""

import hashlib
import os

import pytest

from strandline.__main__ import main
from strandline.sources import cache


@pytest.fixture
def source(spark):
    cache.register(spark)
    return lambda path, **options: spark.read.format("sequence_cache").options(path=str(path), **options).load()


def store(spark, path, rows):
    spark.createDataFrame(rows, "accession string, name string, sequence string, more int").write.format("sequence_cache").option("path", str(path)).mode("append").save()


def test_stored_and_read(spark, source, tmp_path):
    rows = [("X1", "one", "ACGT" * 100, 1), ("X2", None, "", 2), ("X3", "three", None, 3)]
    store(spark, tmp_path / "c", rows)
    got = {r.accession: r for r in source(tmp_path / "c").collect()}
    assert set(got) == {"X1", "X2", "X3"}
    assert (got["X1"].name, got["X1"].sequence, got["X1"].length_bp, got["X1"].retained_pct) == ("one", "ACGT" * 100, 400, 100.0)
    assert got["X1"].sha256 == hashlib.sha256(b"ACGT" * 100).hexdigest()
    assert (got["X2"].name, got["X2"].sequence, got["X2"].length_bp) == ("X2", "", 0)
    assert not any(r.downloaded_this_run or r.error for r in got.values())
    assert sorted(os.listdir(tmp_path / "c")) == ["X1.fasta", "X2.fasta", "X3.fasta"]  # nothing half written is left
    store(spark, tmp_path / "c", [("X2", "new", "GG", 0)])  # the same accession again
    assert {r.accession: r.sequence for r in source(f"file://{tmp_path}/c").collect()} == {"X1": "ACGT" * 100, "X2": "GG", "X3": ""}


def test_partitions(spark, source, tmp_path):
    store(spark, tmp_path, [(f"A{k}", "n", "ACGT", 0) for k in range(7)])
    assert source(tmp_path).rdd.getNumPartitions() == 7
    few = source(tmp_path, partitions=3, accessions="A1, A2,A3,A4,A4,none")
    assert few.rdd.getNumPartitions() == 3
    assert sorted((r.accession, r.error) for r in few.collect()) == [("A1", None), ("A2", None), ("A3", None), ("A4", None), ("none", "not in the cache")]
    assert source(tmp_path / "missing").count() == 0 and source(tmp_path, accessions="").count() == 0


def test_fetched_once_by_tasks(spark, source, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "Y1.txt").write_text(">Y1 title\nacgu\nNNGT\n")
    (tmp_path / "web" / "Y2.txt").write_text("an error page")
    asked = {"accessions": "Y1,Y2,Y3", "url": f"file://{tmp_path}/web/{{accession}}.txt", "retries": 2, "backoff": 0.01, "pause": 0}
    got = {r.accession: r for r in source(tmp_path / "c", **asked).collect()}
    y1 = got["Y1"]
    assert (y1.name, y1.sequence, y1.raw_length, y1.length_bp, y1.retained_pct, y1.downloaded_this_run, y1.attempts) == ("Y1 title", "ACGTGT", 8, 6, 75.0, True, 1)
    assert (got["Y2"].sequence, got["Y2"].error, got["Y2"].attempts) == (None, "no FASTA text", 2)
    assert got["Y3"].sequence is None and "URLError" in got["Y3"].error
    again = {r.accession: r for r in source(tmp_path / "c", **asked).collect()}
    assert (again["Y1"].sequence, again["Y1"].downloaded_this_run, again["Y1"].attempts) == ("ACGTGT", False, 0)
    assert os.listdir(tmp_path / "c") == ["Y1.fasta"]


def test_retries_wait_longer_each_time(monkeypatch):
    waits, answers = [], [OSError("a"), OSError("b"), ">x\nAC\n"]

    class Answer:
        def __init__(self, text):
            self.text = text

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def read(self):
            return self.text.encode()

    def open_url(url, timeout):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return Answer(x)

    monkeypatch.setattr(cache, "urlopen", open_url)
    assert cache.fetched("u", 3, 1.5, waits.append) == (">x\nAC\n", 3, None)
    assert waits == [1.5, 3.0]


def test_odd_names_and_modes(spark, source, tmp_path):
    with pytest.raises(Exception, match="not an accession"):
        store(spark, tmp_path / "c", [("../up", "n", "A", 0)])
    with pytest.raises(Exception, match="append"):
        spark.createDataFrame([("A", "n", "A")], "accession string, name string, sequence string").write.format("sequence_cache").option("path", str(tmp_path / "c")).mode("overwrite").save()


def test_command_line_reads_the_cache(spark, tmp_path):
    import json
    import random

    rng = random.Random(1)
    store(spark, tmp_path / "c", [(a, n, "".join(rng.choice("ACGT") for _ in range(400)), 0) for a, n in (("NC_001422", "phiX174"), ("L09137", "pUC19"))])
    assert main(["--cache", str(tmp_path / "c"), "--no-fetch", "--out", str(tmp_path / "out"), "--window", "200", "--windows-per-genome", "2", "--min-window", "100", "--fast", "--permutations", "9", "--no-plots", "--no-graph"], spark) == 0
    told = {r.accession: r for r in spark.read.json(str(tmp_path / "out" / "fetch_metadata")).collect()}
    assert len(told) == 11 and told["L09137"].catalog_name == "pUC19" and told["J01749"].error == "not in the cache"
    assert {r["name"] for r in json.loads((tmp_path / "out" / "manifest.json").read_text())} == {"phiX174", "pUC19"}
