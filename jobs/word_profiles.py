"""Word profiles of a growing text table, kept up to date by a stream.

    python -m jobs.word_profiles --input PATH --output PATH --checkpoint PATH [--words 1 2 3] [--max-files 1000]

A folder of Parquet files (doc_id, text, lang, source), or a pattern that names files, grows. Each run takes the files that no earlier run with
this checkpoint has taken, counts the words of 1 and of the given numbers of A, C, G and T of their texts by
language and source, and then renews the profiles of the languages that got new counts:

    output/increments/batch=N   lang, source, k, kmer, cnt of one micro-batch
    output/intake/batch=N       lang, source, documents, symbols of one micro-batch
    output/profiles/lang=L      source, k, kmer, cnt, share (within source and k), rho (share over the product
                                of the shares of its symbols; null for single symbols)
    output/marks                lang and the last batch that its profile holds

A batch is written under its number, so a batch that Spark repeats after a failure replaces itself. A profile is
made anew from the increments of its language where its mark is behind; a run that ended between a batch and its
profile, or between a profile and its mark, is caught up by the next. A run without new files changes nothing. A
document counts as often as files bring it; words don't cross documents. Null texts have no words; a blank or
missing language or source is `unknown`.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import logger, named, read_or_empty, session, settings
from strandline.functions.symbols import clean
from strandline.operators import tiles

COUNTS = "lang string, source string, k int, kmer string, cnt long, batch long"
INTAKE = "lang string, source string, documents long, symbols long"
MARKS = "lang string, through long"
KEYS = ("lang", "source")


def word_counts(docs: DataFrame, words: list[int]) -> DataFrame:
    """lang, source, k, kmer, cnt. Counts add up inside a task first, so a group moves 4^k rows a task at most."""
    short, long = [k for k in words if k <= tiles.LONGEST], [k for k in words if k > tiles.LONGEST]
    each = [tiles.word_counts(docs, tuple(short), keep=KEYS)] if short else []
    each += [tiles.kmer_counts(docs, k, keep=KEYS).select(*KEYS, F.lit(k).alias("k"), "kmer", "cnt") for k in long]
    return reduce(DataFrame.unionByName, each)


def profiles(counts: DataFrame) -> DataFrame:
    """source, k, kmer, cnt, share, rho by language, from counts that may be split over batches."""
    total = counts.groupBy(*KEYS, "k", "kmer").agg(F.sum("cnt").alias("cnt"))
    share = total.withColumn("share", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*KEYS, "k")))
    singles = share.where("k = 1").groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("kmer", "share"))).alias("of"))
    expected = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.col("of")[F.substring(F.col("kmer"), i, F.lit(1))]), F.lit(1.0), lambda a, b: a * b)
    return share.join(singles, list(KEYS)).select(*KEYS, "k", "kmer", "cnt", "share", F.when(F.col("k") > 1, F.col("share") / expected).alias("rho"))


def write_batch(output: str, words: list[int], log, taken: list[int]):
    """What becomes of one micro-batch; the same batch again gives the same files in the same places. The
    number of its rows is added to `taken`."""

    def write(batch: DataFrame, number: int) -> None:
        docs = batch.select(named("lang").alias("lang"), named("source").alias("source"), clean(F.col("text")).alias("sequence"))
        docs = docs.persist(StorageLevel.DISK_ONLY)
        try:
            intake = docs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.length("sequence").cast("long")), F.lit(0)).alias("symbols"))
            for name, rows in (("increments", word_counts(docs, words)), ("intake", intake)):
                rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/{name}")
            told = read_or_empty(batch.sparkSession, f"{output}/intake/batch={number}", INTAKE).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("documents"), F.lit(0)).alias("rows"), F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols")).first()
            taken.append(told.rows)
            log.info("batch %d: read %d rows, wrote the words of %d symbols in %d groups to %s/increments and %s/intake", number, told.rows, told.symbols, told.groups, output, output)
        finally:
            docs.unpersist()

    return write


def take_new(spark: SparkSession, input: str, output: str, checkpoint: str, words: list[int], max_files: int, log) -> int:
    """Runs the stream over the files that are new; returns the number of rows that it read."""
    rows = spark.readStream.schema(spark.read.parquet(input).schema).option("maxFilesPerTrigger", max_files).parquet(input)
    taken: list[int] = []
    query = rows.select("text", "lang", "source").writeStream.foreachBatch(write_batch(output, words, log, taken)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new rows from %s in %d batches", sum(taken), input, len(taken))
    return sum(taken)


def renew_profiles(spark: SparkSession, output: str, log) -> int:
    """Makes the profiles anew whose marks are behind the increments; returns their number."""
    counts = read_or_empty(spark, f"{output}/increments", COUNTS)
    marks = read_or_empty(spark, f"{output}/marks", MARKS)
    last = counts.groupBy("lang").agg(F.max("batch").alias("through"))
    behind = last.join(marks, ["lang", "through"], "left_anti").select("lang")
    n = behind.count()
    if n:
        profiles(counts.join(behind, "lang", "left_semi")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(f"{output}/profiles")
        last.write.mode("overwrite").parquet(f"{output}/marks")
    log.info("%d profiles renewed under %s/profiles", n, output)
    return n


def run(spark: SparkSession, input: str, output: str, checkpoint: str, words: tuple[int, ...] | list[int] = (1, 2, 3), max_files: int = 1000) -> dict:
    """Takes what is new under `input`; {"rows": read by this run, "profiles": renewed by it}."""
    log = logger("word_profiles")
    words = sorted({1, *map(int, words)})
    rows = take_new(spark, input.rstrip("/"), output.rstrip("/"), checkpoint, words, max_files, log)
    return {"rows": rows, "profiles": renew_profiles(spark, output.rstrip("/"), log)}


def read(spark: SparkSession, output: str) -> DataFrame:
    """All profiles as they stand."""
    return read_or_empty(spark, f"{output.rstrip('/')}/profiles", "source string, k int, kmer string, cnt long, share double, rho double, lang string")


def main(argv: list[str] | None = None) -> None:
    chosen = settings(__doc__.split("\n")[0], "word_profiles.json", argv)
    spark = session("word_profiles")
    try:
        run(spark, **chosen)
    finally:
        spark.stop()


ORACLE = r"""
WITH d AS (SELECT coalesce(nullif(trim(lang), ''), 'unknown') AS lang, coalesce(nullif(trim(source), ''), 'unknown') AS source, regexp_replace(replace(upper(text), 'U', 'T'), '[^ACGT]', '', 'g') AS s FROM documents),
     w AS (SELECT lang, source, k, substr(s, CAST(i AS BIGINT), k) AS kmer FROM (SELECT lang, source, s, k, unnest(range(1, length(s) - k + 2)) AS i FROM d, (SELECT unnest([1, 2, 3]) AS k))),
     c AS (SELECT lang, source, k, kmer, count(*) AS cnt FROM w GROUP BY ALL),
     p AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY lang, source, k) AS share FROM c),
     b AS (SELECT lang, source, kmer, share FROM p WHERE k = 1),
     e AS (SELECT p.lang, p.source, p.k, p.kmer, product(b.share) AS expected FROM (SELECT *, unnest(string_split(kmer, '')) AS x FROM p WHERE k > 1) p JOIN b ON b.lang = p.lang AND b.source = p.source AND b.kmer = p.x GROUP BY ALL)
SELECT p.lang, p.source, p.k, p.kmer, p.cnt, round(p.share, 6) + 0.0 AS share, round(p.share / e.expected, 6) + 0.0 AS rho FROM p LEFT JOIN e USING (lang, source, k, kmer)
"""

if __name__ == "__main__":
    main()
