import duckdb
import pytest

import corpus_pipeline
from strandline.llm import bpe, line_dedup, packing, toxicity

from .test_ngram_join import brute as jaccard_classes
from .test_packing import checked
from .test_suffix_dedup import brute as repeats


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 0"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert sorted(out.columns) == sorted(corpus_pipeline.COLUMNS)
            kept = {r.doc_id: r.text for r in out.collect()}
            assert all(r.n_chars == len(r.text) for r in out.collect())
        if name == "toxicity":
            model = toxicity.train_on_tables(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            want = {r.doc_id for r in toxicity.score(docs, model).where("score < 0.5").collect()}
            assert set(kept) == want and 0 < len(want) < len(before)
        if name == "line_dedup":
            con = duckdb.connect()
            con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
            con.executemany("INSERT INTO documents VALUES (?, ?)", list(before.items()))
            assert kept == {r[0]: r[1] for r in con.execute(line_dedup.ORACLE).fetchall()}
        if name == "ngram_join":
            want = jaccard_classes(list(before.items()))
            assert set(kept) == {i for i, (c, _, _) in want.items() if i == c} and kept.items() <= before.items()
        if name == "suffix_dedup":
            want = dict(zip(before, repeats(list(before.values()), 200), strict=True))
            assert set(kept) == set(before)
            for i, (size, gone, _, _) in want.items():
                assert 0 <= size - gone - len(kept[i].encode()) <= 6 * want[i][2]
        if name == "packing":
            assert checked(out.collect(), before, 4096) == 0
        docs = out


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", None, "s", 5), (3, "x " * 30_000, "en", None, 60_000), (3, "x " * 30_000, "en", None, 60_000), (4, "a\nb\n\nc", "en", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n, part in enumerate((docs, docs.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{name}{n}"
            stage(spark, part, "/root/testdata/sf0.001").write.parquet(path)
            part = spark.read.parquet(path)
    assert part.count() == 0


@pytest.mark.parametrize("name", ["op1_bpe", "op8_suffix_dedup", "pipeline"])
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries()
