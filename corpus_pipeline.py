"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all that the one before kept.

toxicity      documents scored 0.5 or more go
line_dedup    repeated multi-line chunks go, but for their first occurrence
ngram_join    one document stays of each group linked by 0.8 of their five-word shingles
suffix_dedup  bytes under 200-byte strings that start more than once go
packing       what is left, as pieces of training sequences

A null text counts as empty (its score is the base rate); an emptied document stays, with an empty text.
A byte string cut in the middle of a character leaves the rest of that character out. Very long texts go
through whole. Repeated rows: near duplicates keep one row of those alike in identifier and text; the other
stages treat every row. Null identifiers come last where one of several stays. Columns beyond those of
`documents`, whatever their names, are not carried; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, line_dedup, ngram_join, packing, suffix_dedup, toxicity
from strandline.llm.storage import Scratch, stage_of_pipeline

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Frees the intermediate tables of the stage before, once its written result is what comes in."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_of_pipeline(docs):
            return fn(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below 0.5; learned from the labelled rows outside the held-out fifth."""
    model = toxicity.train_on_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where("score < 0.5").drop("score")


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs.select(*COLUMNS))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row per class. Rows alike in identifier and text are one class, of which one stays."""
    kept = ngram_join.classes(docs, with_hash=True).where("kept").select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"))
    docs = docs.select(*COLUMNS).withColumn("_t", F.xxhash64(F.coalesce("text", F.lit(""))))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_t") == F.col("_h")), "left_semi").dropDuplicates(["doc_id", "_t"]).drop("_t")


@stage
def drop_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(docs.select(*COLUMNS), with_text=True, carry=COLUMNS[2:4])
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, bpe.public_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_bytes),
    ("packing", pack),
]

#: No SQL: scores of a trained model and a tokenizer. The stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    tmp = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tmp.save(stage(spark, docs, sf_dir), name)
    return docs
