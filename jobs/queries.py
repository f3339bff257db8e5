"""The jobs as queries: each runs its job twice into one new folder and returns the output as it then stands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import catalogue, word_profiles
from strandline.sources.shared import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def job1_word_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job1")  # the table may be one file or a folder of files; a pattern fits both
    for _ in range(2):
        word_profiles.run(spark, f"{sf_dir}/documents*", f"{at}/out", f"{at}/checkpoint")
    return _rounded(word_profiles.read(spark, f"{at}/out"))


def job2_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job2")
    for _ in range(2):
        catalogue.run(spark, f"{sf_dir}/documents.parquet", f"{at}/out")
    return _rounded(catalogue.read(spark, f"{at}/out"))


QUERIES = {"job1_word_profiles": job1_word_profiles, "job2_catalogue": job2_catalogue}
ORACLE_SQL = {"job1_word_profiles": word_profiles.ORACLE, "job2_catalogue": catalogue.ORACLE}
