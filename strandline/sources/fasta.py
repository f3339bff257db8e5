"""FASTA files of any size, read in splits.

Spark's text reader cuts files into byte ranges at ends of lines. A task turns the lines of its ranges into
pieces: the symbols between two headers, or between a header and the end of an Arrow batch. A range may begin
inside a record; how many headers lie before it in its file comes from a prefix sum over the ranges' header
counts, one row a range. With it a piece knows its record, and a record's pieces know their order: by range,
then by number. No task holds a file, and none a whole record but where `records` joins its pieces to one row.

A line that begins with `>`, blanks aside, is a header; symbols before a file's first header are a record of
their own, without a header. Carriage returns and blanks around a line go. Compressed files (by suffix) are one
range each. An empty file has no record."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.symbols import clean, organism_type

BLANKS = " \t\n\x0b\f\r"
PIECE = "path string, file string, range long, header_no long, piece long, header string, body string"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(meta["file_path"].alias("path"), meta["file_name"].alias("file"), meta["file_block_start"].alias("range"), F.regexp_replace("value", "\r", "").alias("value"))


def _is_header(line: Column) -> Column:
    return F.ltrim(line, F.lit(BLANKS)).startswith(">")


def _cut(batches):
    """Lines, in the order of their ranges, to pieces. A range's pieces are numbered from 0, its headers from 1:
    0 is the record that was open where the range begins."""
    here, headers, piece = None, 0, 0
    names = [c.split()[0] for c in PIECE.split(", ")]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        path, file, start, value = batch.columns
        at = np.asarray(start)
        fresh = np.ones(n, bool)
        fresh[1:] = at[1:] != at[:-1]
        if n > 1:
            fresh[1:] |= np.asarray(pc.not_equal(path.slice(1), path.slice(0, n - 1)).to_numpy(zero_copy_only=False))
        first = (path[0].as_py(), int(at[0]))
        fresh[0] = first != here
        stripped = pc.ascii_trim(value, BLANKS)
        head = pc.starts_with(stripped, ">").to_numpy(zero_copy_only=False)
        body = pc.if_else(pa.array(head), "", stripped)
        off = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + n + 1]
        data = body.buffers()[2]
        text = memoryview(data) if data is not None else memoryview(b"")
        cuts = np.flatnonzero(fresh | head)
        cuts = cuts if len(cuts) and cuts[0] == 0 else np.concatenate(([0], cuts))
        rows: list[tuple] = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), n], strict=True):
            if fresh[a]:
                headers, piece = 0, 0
            if head[a]:
                headers += 1
            symbols = bytes(text[off[a] : off[b]]).decode()
            if head[a] or symbols:
                rows.append((path[a].as_py(), file[a].as_py(), int(at[a]), headers, piece, stripped[a].as_py()[1:] if head[a] else None, symbols))
                piece += 1
        here = (path[n - 1].as_py(), int(at[-1]))
        if rows:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def pieces(spark: SparkSession, path: str | list[str], keep_symbols: bool = False) -> DataFrame:
    """path, file, record (number in its file), range, piece, header (on a record's first piece), body (its
    symbols: cleaned, or with `keep_symbols` in upper case with U as T) and raw (symbols before that)."""
    lines = _lines(spark, path)
    cut = lines.mapInArrow(_cut, PIECE)
    ranges = lines.groupBy("path", "range").agg(F.count_if(_is_header(F.col("value"))).alias("n"))
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("path", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    symbols = F.replace(F.upper("body"), F.lit("U"), F.lit("T")) if keep_symbols else clean(F.col("body"))
    return cut.join(ranges, ["path", "range"]).select("path", "file", (F.col("before") + F.col("header_no")).alias("record"), "range", "piece", "header", symbols.alias("body"), F.length("body").cast("long").alias("raw"))


def placed(rows: DataFrame) -> DataFrame:
    """path, file, record, base, body: pieces with the place of their first symbol in the record. Lengths are added
    up along a record without its symbols."""
    before = Window.partitionBy("path", "record").orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    key = ["path", "record", "range", "piece"]
    sizes = rows.select(*key, F.length("body").cast("long").alias("n")).select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.where("body <> ''").join(sizes, key).select("path", "file", "record", "base", "body")


def label(header: Column, file: Column) -> Column:
    """A record's name: its header, else its file without suffixes, with odd symbols as `_`, 80 at most."""
    stem = F.regexp_replace(F.regexp_replace(file, r"\.gz$", ""), r"\.[^.]*$", "")
    text = F.coalesce(F.nullif(F.trim(header, F.lit(BLANKS)), F.lit("")), stem)
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"), 1, 80)


def names(rows: DataFrame) -> DataFrame:
    """path, record, name: from headers alone."""
    return rows.groupBy("path", "record").agg(label(F.max("header"), F.min("file")).alias("name"))


def records(spark: SparkSession, path: str | list[str], split_records: bool = False, keep_symbols: bool = False) -> DataFrame:
    """One row a file, named by its first header, or with `split_records` one a header."""
    rows = pieces(spark, path, keep_symbols)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record", "range", "piece", "body"))), lambda x: x["body"]), "")
    first = F.min_by("header", F.when(F.col("header").isNotNull(), F.col("record")))
    got = rows.groupBy("path", *(["record"] * split_records)).agg(F.min("file").alias("accession"), first.alias("header"), whole.alias("sequence"), F.sum("raw").alias("raw_length"))
    got = got.withColumn("name", label(F.col("header"), F.col("accession")))
    return got.select("name", "accession", organism_type(F.col("name")).alias("organism_type"), "sequence", "raw_length", F.create_map().cast("map<string,string>").alias("metadata"))
