"""A quality-checked catalogue of the sequences of a text table.

    python -m jobs.catalogue --input PATH --output PATH [--block 2000] [--min-length 500] ...

Reads `documents`, joins the texts of up to `block` consecutive identifiers of a language and source to a
record, and writes, by organism type (the language):

    output/records/organism_type=T     every record: its manifest (name, accession, length_bp, raw_length,
                                       retained_pct, sha256), gc_pct, entropy_norm (words of k), distance (of its
                                       words of two to the mean of its type), same (records with its sequence),
                                       flags and accepted
    output/sequences/organism_type=T   name, accession, sequence of the accepted records
    output/summary                     CSV: organism_type, records, accepted, symbols, and a count of each flag

Flags: `short` below min_length symbols; `plain` below min_entropy; `repeat` where a record of a smaller name has
the same sequence; `outlier` where the distance exceeds the mean of its type by more than `spread` standard
deviations (types of at least 8 records). A record without a flag is accepted.

The job reads whole tables and replaces whole outputs: run again, it gives the same files' rows. Null texts are
empty; a blank or missing language or source is `unknown`; records without a symbol are left out, as a sequence
needs one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import logger, named, read_or_empty, session, settings
from strandline.functions.symbols import gc_pct
from strandline.operators import spectra
from strandline.sources import records
from strandline.sources.shared import checkpointed

FLAGS = ("short", "plain", "repeat", "outlier")
ROWS = "name string, accession string, length_bp long, raw_length long, retained_pct double, sha256 string, gc_pct double, entropy_norm double, distance double, same long, flags string, accepted boolean, organism_type string"


def catalogue(recs: DataFrame, k: int, min_length: int, min_entropy: float, spread: float) -> DataFrame:
    """Every record with its figures and flags."""
    by_type = ("organism_type", "name")
    rows = records.manifest(recs).join(recs.select(*by_type, gc_pct(F.col("sequence")).alias("gc_pct")), list(by_type))
    rows = rows.join(spectra.kmer_entropy(recs, k, by_type).select(*by_type, "entropy_norm"), list(by_type), "left")
    away = checkpointed(spectra.fisher_to_centroid(recs, 2, by_type, ("organism_type",)).select(*by_type, F.col("fisher_to_centroid").alias("distance")))
    usual = away.groupBy("organism_type").agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("sd"), F.count(F.lit(1)).alias("n"))
    # Sums of a type are made before they meet its records; types are few beside records, so Spark may broadcast them.
    rows = rows.join(away.join(usual, "organism_type"), list(by_type))
    first = rows.groupBy("sha256").agg(F.min("name").alias("first"), F.count(F.lit(1)).alias("same"))
    rows = rows.join(first, "sha256")
    told = {
        "short": F.col("length_bp") < min_length,
        "plain": F.coalesce(F.col("entropy_norm"), F.lit(0.0)) < min_entropy,
        "repeat": F.col("name") > F.col("first"),
        "outlier": (F.col("n") >= 8) & (F.col("distance") > F.col("mean") + spread * F.col("sd")),
    }
    flags = F.array_join(F.array_compact(F.array(*(F.when(told[f], f) for f in FLAGS))), ",")
    return rows.withColumn("flags", flags).withColumn("accepted", F.col("flags") == "").select(*(c.split()[0] for c in ROWS.split(", ")))


def summary(rows: DataFrame) -> DataFrame:
    has = lambda f: F.count_if(F.array_contains(F.split("flags", ","), f)).alias(f)
    return rows.groupBy("organism_type").agg(F.count(F.lit(1)).alias("records"), F.count_if("accepted").alias("accepted"), F.sum("length_bp").alias("symbols"), *map(has, FLAGS)).orderBy("organism_type")


def run(spark: SparkSession, input: str, output: str, block: int = 2000, k: int = 3, min_length: int = 500, min_entropy: float = 0.5, spread: float = 3.0) -> dict:
    """Writes the catalogue; {"documents": read, "records": written, "accepted": of these}."""
    log, output = logger("catalogue"), output.rstrip("/")
    docs = spark.read.parquet(input).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), named("lang").alias("lang"), named("source").alias("source"))
    n = docs.count()
    log.info("read %d documents from %s", n, input)
    recs = checkpointed(records.sequences_from_documents(docs, block))  # cut and joined once, used four times
    rows = catalogue(recs, k, min_length, min_entropy, spread)
    rows.write.mode("overwrite").partitionBy("organism_type").parquet(f"{output}/records")
    rows = read(spark, output)
    kept = recs.join(rows.where("accepted").select("organism_type", "name"), ["organism_type", "name"], "left_semi")
    kept.select("name", "accession", "sequence", "organism_type").write.mode("overwrite").partitionBy("organism_type").parquet(f"{output}/sequences")
    summary(rows).coalesce(1).write.mode("overwrite").csv(f"{output}/summary", header=True)
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("ok")).first()
    log.info("wrote %d records to %s/records, %d of them accepted to %s/sequences, and %s/summary", told.n, output, told.ok, output, output)
    return {"documents": n, "records": told.n, "accepted": told.ok}


def read(spark: SparkSession, output: str) -> DataFrame:
    """All records of the catalogue."""
    return read_or_empty(spark, f"{output.rstrip('/')}/records", ROWS)


def main(argv: list[str] | None = None) -> None:
    chosen = settings(__doc__.split("\n")[0], "catalogue.json", argv)
    spark = session("catalogue")
    try:
        run(spark, **chosen)
    finally:
        spark.stop()


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(nullif(trim(lang), ''), 'unknown') AS lang, coalesce(nullif(trim(source), ''), 'unknown') AS source FROM documents),
     seq AS (SELECT lang AS organism_type, concat_ws('_', lang, source, CAST(doc_id // 2000 AS VARCHAR)) AS name, source AS accession, string_agg(regexp_replace(replace(upper(text), 'U', 'T'), '[^ACGT]', '', 'g'), '' ORDER BY doc_id) AS s, CAST(sum(length(text)) AS BIGINT) AS raw_length FROM d GROUP BY ALL),
     r AS (SELECT *, length(s) AS n, sha256(s) AS sha256 FROM seq WHERE s <> ''),
     w AS (SELECT organism_type, name, k, substr(s, CAST(i AS BIGINT), k) AS w FROM (SELECT organism_type, name, s, k, unnest(range(1, n - k + 2)) AS i FROM r, (SELECT unnest([2, 3]) AS k))),
     c AS (SELECT organism_type, name, k, w, count(*) AS c FROM w GROUP BY ALL),
     p AS (SELECT *, c / sum(c) OVER (PARTITION BY organism_type, name, k) AS p FROM c),
     h AS (SELECT organism_type, name, -sum(p * log2(p)) / 6 AS entropy_norm FROM p WHERE k = 3 GROUP BY ALL),
     v AS (SELECT r.organism_type, r.name, x.w, CASE WHEN r.n < 2 THEN 1 / 16 ELSE coalesce(p.p, 0) END AS p FROM r CROSS JOIN (SELECT a || b AS w FROM unnest(['A','C','G','T']) AS t(a), unnest(['A','C','G','T']) AS u(b)) x LEFT JOIN p ON p.k = 2 AND p.organism_type = r.organism_type AND p.name = r.name AND p.w = x.w),
     m AS (SELECT organism_type, w, avg(p) AS a FROM v GROUP BY ALL),
     q AS (SELECT organism_type, w, a / sum(a) OVER (PARTITION BY organism_type) AS q FROM m),
     f AS (SELECT organism_type, name, 2 * acos(greatest(0, least(1, sum(sqrt(p * q)) / sqrt((sum(p) + 1e-15) * (sum(q) + 1e-15))))) AS distance FROM v JOIN q USING (organism_type, w) GROUP BY ALL),
     u AS (SELECT organism_type, avg(distance) AS mean, stddev_pop(distance) AS sd, count(*) AS many FROM f GROUP BY ALL),
     z AS (SELECT r.*, entropy_norm, distance, count(*) OVER (PARTITION BY sha256) AS same, array_to_string(list_filter([CASE WHEN n < 500 THEN 'short' END, CASE WHEN coalesce(entropy_norm, 0) < 0.5 THEN 'plain' END, CASE WHEN r.name > min(r.name) OVER (PARTITION BY sha256) THEN 'repeat' END, CASE WHEN many >= 8 AND distance > mean + 3 * sd THEN 'outlier' END], lambda x: x IS NOT NULL), ',') AS flags
           FROM r LEFT JOIN h USING (organism_type, name) JOIN f USING (organism_type, name) JOIN u USING (organism_type))
SELECT name, accession, n AS length_bp, raw_length, round(100.0 * n / raw_length, 6) + 0.0 AS retained_pct, sha256, round(100.0 * length(regexp_replace(s, '[AT]', '', 'g')) / n, 6) + 0.0 AS gc_pct, round(entropy_norm, 6) + 0.0 AS entropy_norm, round(distance, 6) + 0.0 AS distance, same, flags, flags = '' AS accepted, organism_type FROM z
"""

if __name__ == "__main__":
    main()
