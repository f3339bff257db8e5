"""Sinks: CSV with a stable column order, JSON with sorted keys, logs."""

from __future__ import annotations

import json
import logging
import math
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST = ("organism", "organism_type", "accession", "source", "replicate", "start", "end", "length_bp", "n_windows")


def ordered(df: DataFrame) -> DataFrame:
    head = [c for c in FIRST if c in df.columns]
    return df.select(*head, *(c for c in df.columns if c not in head))


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """`one_file` is for reports of a few rows."""
    out = ordered(df)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").csv(path, header=True)


def json_safe(x):
    """NaN and infinities become null, at any depth."""
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [json_safe(v) for v in x]
    if hasattr(x, "item"):
        x = x.item()
    return None if isinstance(x, float) and not math.isfinite(x) else x


def write_json(path, obj) -> None:
    Path(path).write_text(json.dumps(json_safe(obj), indent=2, sort_keys=True, default=str))


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def report(stats: DataFrame) -> DataFrame:
    """Test rows nested as feature -> control -> figures, one row per feature."""
    inner = [c for c in stats.columns if c not in ("feature", "control")]
    return stats.groupBy("feature").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("control", F.struct(*inner))))).alias("controls"))


def logger(out) -> logging.Logger:
    log = logging.getLogger("strandline")
    log.setLevel(logging.INFO)
    if not log.handlers:
        for h in (logging.StreamHandler(), logging.FileHandler(Path(out) / "run.log")):
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
            log.addHandler(h)
    return log
