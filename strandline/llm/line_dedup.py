"""Removal of repeated multi-line chunks, in DataFrame operations only.

A document's lines are hashed, and a rolling hash over `window` line hashes decides where chunks end:
only the lines around a place decide, so text put in or taken out elsewhere shifts no boundary. A chunk
of two or more lines that occurs anywhere else is removed, but for its first occurrence by identifier
and place. Chunks meet by a digest without their text; only those whose digest repeats are compared
byte by byte.

The text moves once, to meet its document's repeated chunks. Counts are aggregated before they are
shuffled and saved before they meet the chunks again, so a chunk that a third of all documents hold costs
a row per task, and adaptive execution can split its join.

Null texts stay null and hold no chunk; empty texts stay empty. Chunks of white space alone are kept.
Very long texts are split whole, in one array of their lines. Rows with the same identifier and text count
as one document and are treated alike; rows without an identifier come last in the order, and ties among
them go by text. An empty table gives an empty table. Extra columns are passed on, whatever their names;
with `report`, columns named removed_chunks and removed_lines are replaced. `n_chars` is brought up to date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.storage import Scratch

WINDOW, DIVISOR, MODULUS, FACTOR = 2, 4, 1 << 28, 31


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunk_ends(lines: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """Indices of the last lines of chunks."""
    hashes = F.transform(lines, lambda x: F.conv(F.left(F.md5(x.cast("binary")), F.lit(7)), 16, 10).cast("long"))

    def is_end(hs: Column, i: Column) -> Column:
        rolled = F.aggregate(F.slice(hs, i - (window - 2), F.lit(window)), F.lit(0).cast("long"), lambda a, h: (a * FACTOR + h) % MODULUS)
        return (i == F.size(hs) - 1) | ((i >= window - 1) & (rolled % divisor == 0))

    # A let-binding: the hashes are computed once and not anew for every line.
    return F.element_at(F.transform(F.array(hashes), lambda hs: F.filter(F.sequence(F.lit(0), F.size(hs) - 1), lambda i: F.when(i < window - 1, i == F.size(hs) - 1).otherwise(is_end(hs, i)))), 1)


def chunks_of(lines: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """struct(no, body, n_lines) of every chunk."""

    def cut(ls: Column) -> Column:
        ends = chunk_ends(ls, window, divisor)

        def one(es: Column) -> Column:
            def body(e: Column, k: Column) -> Column:
                start = F.when(k == 0, F.lit(0)).otherwise(F.get(es, k - 1) + 1)
                return F.struct(k.alias("no"), F.array_join(F.slice(ls, start + 1, e - start + 1), "\n").alias("body"), (e - start + 1).alias("n_lines"))

            return F.transform(es, body)

        return F.element_at(F.transform(F.array(ends), one), 1)

    return F.element_at(F.transform(F.array(lines), cut), 1)


REPORT = ("removed_chunks", "removed_lines")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, divisor: int = DIVISOR, report: bool = False) -> DataFrame:
    """`df` with repeated chunks taken out of `text`; with `report`, also removed_chunks and removed_lines."""
    tmp = Scratch(df.sparkSession, "line-dedup")
    # The caller's columns travel in one struct, so that none of their names can meet one of ours.
    carried = [c for c in df.columns if c != text]
    docs = df.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    docs = docs.withColumn("sha", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    all_chunks = chunks_of(lines_of(F.col("text")), window, divisor)
    multi = F.filter(all_chunks, lambda c: (c["n_lines"] > 1) & (F.trim(F.translate(c["body"], "\n\t\r", "   ")) != ""))
    places = docs.where(F.col("text").contains("\n")).select("id", "sha", F.explode(multi).alias("c"))
    places = tmp.save(places.select("id", "sha", F.col("c.no").alias("no"), F.md5(F.col("c.body").cast("binary")).alias("h")).distinct(), "places")
    repeated = tmp.save(places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "repeated")
    listed = places.join(repeated, "h").groupBy("id", "sha").agg(F.collect_set("no").alias("nos"))
    held = tmp.save(_beside(docs, tmp.save(listed, "listed"), "nos"), "held")
    tmp.drop(places)
    some = held.where("nos IS NOT NULL")
    both = some.select("id", "sha", F.explode(F.filter(all_chunks, lambda c: F.array_contains("nos", c["no"]))).alias("c"))
    both = tmp.save(both.select("id", "sha", F.col("c.no").alias("no"), F.col("c.body").alias("body")).distinct(), "both")
    # Byte comparison: occurrences are grouped by the chunk itself.
    first = both.groupBy("body").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha", "no")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    is_first = F.col("f.id").eqNullSafe(F.col("id")) & (F.col("f.sha") == F.col("sha")) & (F.col("f.no") == F.col("no"))
    gone = both.join(tmp.save(first, "first"), "body").where(~is_first).groupBy("id", "sha").agg(F.collect_set("no").alias("gone"))
    some = _beside(some, tmp.save(gone, "gone"), "gone")
    kept = F.array_join(F.transform(F.filter(all_chunks, lambda c: ~F.array_contains("gone", c["no"])), lambda c: c["body"]), "\n")
    lost = F.aggregate(F.filter(all_chunks, lambda c: F.array_contains("gone", c["no"])), F.lit(0), lambda a, c: a + c["n_lines"])
    none = F.col("gone").isNull()
    some = some.select("row", F.when(none, F.col("text")).otherwise(kept).alias("text"), F.when(none, 0).otherwise(F.size("gone")).alias(REPORT[0]), F.when(none, 0).otherwise(lost).alias(REPORT[1]))
    out = held.where("nos IS NULL").select("row", "text", *(F.lit(0).alias(c) for c in REPORT)).unionByName(some)

    def column(c: str) -> Column:
        if c == text:
            return F.col("text")
        return F.length("text").cast(df.schema[c].dataType) if c == "n_chars" else F.col("row").getField(c)

    told = [F.col(c) for c in REPORT] if report else []
    return out.select(*(column(c).alias(c) for c in df.columns if not (report and c in REPORT)), *told)


def _beside(docs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """`docs` with `column` of the row of `table` with the same identifier (null too) and digest. Always a
    merge join: the table grows with the documents, so a broadcast would fit small inputs only."""
    table = table.select(F.col("id").alias("i"), F.col("sha").alias("s"), column)
    return docs.join(table.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s")), "left").drop("i", "s")


ORACLE = """
WITH l AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
           FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
     h AS (SELECT *, CAST('0x' || left(md5(line), 7) AS BIGINT) AS h FROM l),
     e AS (SELECT *, coalesce(((lag(h) OVER w % 268435456 * 31 + h) % 268435456) % 4 = 0, FALSE) AS is_end FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
     n AS (SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM e),
     c AS (SELECT doc_id, no, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n_lines FROM n GROUP BY doc_id, no),
     r AS (SELECT *, n_lines > 1 AND trim(translate(body, chr(10) || chr(9) || chr(13), '   ')) <> ''
                     AND row_number() OVER (PARTITION BY body ORDER BY doc_id, no) > 1 AS gone FROM c)
SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text,
       CAST(sum(gone::INT) AS INTEGER) AS removed_chunks, CAST(sum(CASE WHEN gone THEN n_lines ELSE 0 END) AS INTEGER) AS removed_lines
FROM r GROUP BY doc_id
UNION ALL SELECT doc_id, text, 0, 0 FROM documents WHERE text IS NULL
"""
