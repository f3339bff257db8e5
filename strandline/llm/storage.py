"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_LAST: list[Scratch] = []
_NOW: list[list[Scratch]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A temporary one only where that is unset and the master is
    local; elsewhere each executor would write to a disk of its own, so an unset folder is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="strandline-")
    return _OWN[key]


def by_position(df: DataFrame) -> DataFrame:
    """The columns as c0, c1, ...: the caller's names may hold dots or occur twice."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


@contextmanager
def stage_of_pipeline(docs: DataFrame) -> Iterator[None]:
    """Tables opened inside are freed when the next stage begins, which reads a written copy of this one's
    result. If `docs` still reads them, they stay."""
    files = docs.inputFiles() if _LAST else []
    for scratch in _LAST:
        if not any(scratch.root in f for f in files):
            scratch.free()
    _LAST.clear()
    _NOW.append(_LAST)
    try:
        yield
    finally:
        _NOW.pop()


class Scratch:
    """Written tables of one query. `save` cuts the lineage: a lost executor costs a reread, not a
    recomputation. `drop` frees a table that later ones no longer read; the rest goes at exit.

    Aggregates are saved before they are joined to the rows that they come from: adaptive execution splits a
    hot key of a join whose sides come straight from an exchange, but not where an aggregate stands between."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._tables: list[str] = []
        if _NOW:
            _NOW[-1].append(self)
        atexit.register(self._clean)

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def save_bucketed(self, df: DataFrame, key: str, text: str, bytes_each: int = 16 << 20) -> DataFrame:
        """Saved in buckets by `key`, of about `bytes_each`: joins on that key read the buckets and move the
        other side only. The size is that of the files that one table scan expects, else measured by `text`."""
        plan = df._jdf.queryExecution().optimizedPlan()
        size = int(str(plan.stats().sizeInBytes()))
        if plan.collectLeaves().size() > 1 or size >= 1 << 60:
            size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
        n = max(self.spark.sparkContext.defaultParallelism, min(100_000, -(-size // bytes_each)))
        path, table = self.path("bucketed"), f"t{uuid.uuid4().hex}"
        df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(table)
        self._tables.append(table)
        out = self.spark.table(table)
        out._scratch_path = path  # type: ignore[attr-defined]
        self.drop()
        return out

    def drop(self, *saved: DataFrame) -> None:
        for df in saved:
            self._delete(df._scratch_path)  # type: ignore[attr-defined]
        # Spark deletes the shuffle files of a finished write once the driver's collector has found its plan
        # unused, and asks for a collection every 30 minutes only; the next step needs the disk sooner.
        self.spark.sparkContext._jvm.System.gc()

    def free(self) -> None:
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._tables.clear()
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _clean(self) -> None:
        try:
            self.free()
        except Exception:  # the JVM has ended
            pass
