"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import ann, bpe, exact_dedup, language, licenses, line_dedup, ngram_join, packing, suffix_dedup, token_counts, toxicity, vector_codes
from strandline.llm.storage import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), bpe.public_path("byte_bpe_50k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, report=True)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as flat token files, scanned for the end-of-document identifier."""
    folder = Scratch(spark, "token-files").path("flat")
    return token_counts.count_documents(table(spark, sf_dir, "documents"), bpe.public_path("byte_bpe_50k.json"), 50256, folder)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_on_tables(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe.public_path("word_bpe_49k.json"))


def packed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of operator 10 for instruction data: assistants' turns behind the turn before, under limits on
    tokens, segments and loss-bearing tokens that all bind."""
    examples = packing.replies(table(spark, sf_dir, "conversations"))
    return packing.pack(examples, bpe.public_path("word_bpe_49k.json"), key="key", prompt="prompt", seq_len=2048, max_segments=8, max_loss=1536)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_nearest": op6_nearest,
    "op7_licenses": op7_licenses,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_packing": op10_packing,
    "packed_replies": packed_replies,
    "op11_language": op11_language,
    "op12_vector_codes": op12_vector_codes,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_ngram_join": ngram_join.ORACLE,
    "op6_nearest": ann.ORACLE,
    "op7_licenses": licenses.oracle(),
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
}
