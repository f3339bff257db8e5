"""FASTA files read in splits, against a parser that reads whole files."""

import gzip
import random
import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from strandline.sources import fasta, records


@contextmanager
def split_size(spark, size):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(old, (size, 1), strict=True):
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def plain(text, stem):
    """[(name, body)] of a file, by a loop over lines; the record before the first header only if it has symbols."""
    out = [[None, ""]]
    for line in text.replace("\r", "").split("\n"):
        line = line.strip(fasta.BLANKS)
        if line.startswith(">"):
            out.append([line[1:], ""])
        else:
            out[-1][1] += line
    out = out if out[0][1] else out[1:]
    name = lambda h: re.sub(r"[^A-Za-z0-9_.-]+", "_", (h or "").strip(fasta.BLANKS) or stem)[:80]
    return [(name(h), b) for h, b in out]


def cleaned(body):
    return "".join(c for c in body.upper().replace("U", "T") if c in "ACGT")


def texts():
    rng = random.Random(8)
    line = lambda n: "".join(rng.choice("ACGTNacgtu ") for _ in range(n))
    out = {}
    for k in range(6):
        lines = [] if k % 2 else [line(30), "", line(10)]  # some begin without a header
        for r in range(rng.randint(1, 12)):
            lines.append(rng.choice([f">rec {k} {r} é", f"  >pad {k} {r}", ">", f">tab\t{k}{r}\r"]))
            lines += [line(rng.choice([0, 1, 60, 61])) + rng.choice(["", "\r", "  "]) for _ in range(rng.choice([0, 1, 3, 200]))]
        out[f"f{k}.fasta"] = "\n".join(lines) + rng.choice(["", "\n", "\n\n"])
    out["one.fa"] = ">whole\n" + "\n".join(line(70) for _ in range(1500))
    out["flat.fa"] = ">a\n" + line(5000).replace(" ", "A") + "\n>b\n" + "\n" * 3000 + "ACGT"
    return out | {"empty.fa": "", "blank.fa": "\n \n", "header.fa": ">only"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("fa")
    for name, text in texts().items():
        (at / name).write_bytes(text.encode())
    with gzip.open(at / "z.fasta.gz", "wb") as f:
        f.write(texts()["f3.fasta"].encode())
    return str(at)


@pytest.mark.parametrize("size", [300, 5000, 128 << 20])
def test_records_for_any_split(spark, folder, size):
    files = texts() | {"z.fasta.gz": texts()["f3.fasta"]}
    want = sorted((n, f, cleaned(b), len(b)) for f, t in files.items() for n, b in plain(t, f.removesuffix(".gz").rsplit(".", 1)[0]))
    with split_size(spark, size):
        if size == 300:
            assert spark.read.text(f"{folder}/one.fa").rdd.getNumPartitions() > 100  # the record is cut that often
        got = sorted((r.name, r.accession, r.sequence, r.raw_length) for r in records.read_fasta(spark, folder, split_records=True).collect())
        assert got == want
        whole = {r.accession: r for r in records.read_fasta(spark, folder).collect()}
        assert records.read_fasta(spark, folder, keep_symbols=True).where("accession = 'one.fa'").first().sequence == plain(files["one.fa"], "")[0][1].upper().replace("U", "T")
    for f, t in files.items():
        recs = plain(t, f.removesuffix(".gz").rsplit(".", 1)[0])
        if recs:
            headers = [n for n, _ in plain(t[t.index(">") :] if ">" in t else t, f.removesuffix(".gz").rsplit(".", 1)[0])]
            assert (whole[f].name, whole[f].sequence) == (headers[0], cleaned("".join(b for _, b in recs)))
    assert "empty.fa" not in whole and "blank.fa" not in whole


@pytest.mark.parametrize("size", [300, 128 << 20])
def test_places_of_pieces(spark, folder, size):
    with split_size(spark, size):
        rows = fasta.pieces(spark, [f"{folder}/one.fa", f"{folder}/f2.fasta"])
        at = fasta.placed(rows).join(fasta.names(rows), ["path", "record"])
        got = {}
        for r in at.orderBy("base").collect():
            assert r.base == len(got.get((r.file, r.record), ("", ""))[1])
            got[r.file, r.record] = (r.name, got.get((r.file, r.record), ("", ""))[1] + r.body)
    files = texts()
    want = sorted((f, n, cleaned(b)) for f in ("one.fa", "f2.fasta") for n, b in plain(files[f], f[:2]) if cleaned(b))
    assert sorted((f, n, s) for (f, _), (n, s) in got.items()) == want


def test_no_piece_holds_a_record(spark, folder):
    with split_size(spark, 5000):
        longest = fasta.pieces(spark, f"{folder}/one.fa").agg(F.max(F.length("body"))).first()[0]
    assert longest < 6000
