"""What the jobs share: settings from a file and the command line, a log, and reading what may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def logger(name: str) -> logging.Logger:
    log = logging.getLogger(f"jobs.{name}")
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log


def settings(description: str, default: str, argv: list[str] | None = None) -> dict:
    """The settings of a JSON file; options of the same names win. Names that the file lacks are an error."""
    first = argparse.ArgumentParser(add_help=False)
    first.add_argument("--config", default=str(Path(__file__).with_name(default)))
    known, _ = first.parse_known_args(argv)
    values = json.loads(Path(known.config).read_text())
    parser = argparse.ArgumentParser(description=description, parents=[first])
    for key, value in values.items():
        many = isinstance(value, list)
        parser.add_argument(f"--{key.replace('_', '-')}", dest=key, default=value, type=type(value[0] if many else value), nargs="+" if many else None)
    got = vars(parser.parse_args(argv))
    got.pop("config")
    missing = [k for k, v in got.items() if v == ""]
    if missing:
        parser.error(f"no value for {', '.join(missing)}")
    return got


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def named(column: str) -> Column:
    """A group's name: blank and missing ones are one group, which a partition folder can hold."""
    return F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit("unknown"))


def session(name: str) -> SparkSession:
    return SparkSession.builder.appName(name).getOrCreate()
