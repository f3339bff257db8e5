"""Token counts of documents in flat token files, by a separator scan.

A flat file is a stream of little-endian ids in which every document ends with one identifier; it has
no index and comes as numbered blocks that cut documents anywhere. Each block is searched for the
identifier with vector operations and returns its interior counts, the ids before its first separator
and those behind its last. A prefix scan over the blocks, native in Spark, then numbers the documents
and stitches those that cross blocks. Blocks are small rows, so the scan moves no tokens.

A text may hold the end identifier itself, as the string of a special token. Inside a text it is written
as the first id beyond the vocabulary and counts as one token, so an end identifier always ends a document.

Null and empty documents count 0 tokens. Very long texts go through whole; their tokens cross blocks.
Ids behind the last separator of a stream form an unended document, which is returned with ended = false.
An empty block is allowed anywhere, an empty table gives an empty table. Repeated rows are documents of
their own, known by their place in the stream, so ties need no rule. Extra columns, whatever their names,
are ignored. A scan that finds another number of documents in a stream than were written is an error.
"""

from __future__ import annotations

import posixpath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import bpe
from strandline.llm import vectext as V

NAME = r"stream-(\d+)-block-(\d+)\.bin$"


def layout(tokenizer_path: str, end_id: int) -> tuple[int, str]:
    """The id that stands for `end_id` inside a text, and the type that holds all ids of a flat file."""
    inside = max(bpe.vocabulary(tokenizer_path).size, end_id + 1)
    return inside, "<u4" if inside >= 1 << 16 else "<u2"


def write_stream(df: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Tokenises each partition into a stream of blocks under `path`, a folder that executors share.
    Returns stream, ordinal and key of every document; a repeated task writes the same blocks again."""
    kind = df.schema[key].dataType.simpleString()
    inside, dtype = layout(tokenizer_path, end_id)

    def work(batches):
        from pyarrow import fs

        stream, ordinal, block, waiting, out = None, 0, 0, [], None
        step = block_bytes // np.dtype(dtype).itemsize

        def put(ids):
            nonlocal block
            name = f"{folder}/stream-{stream:06d}-block-{block:06d}.bin"
            with store.open_output_stream(name) as f:
                f.write(ids.tobytes())
            block += 1

        for rows, flat, off in bpe.encoded(batches, "text", tokenizer_path, 3 << 20):
            if not rows.num_rows:
                continue
            if stream is None:
                stream = rows.column(2)[0].as_py()
                store, folder = fs.FileSystem.from_uri(path)
                store.create_dir(folder)
            ids = np.insert(np.where(flat == end_id, inside, flat), off[1:], end_id).astype(dtype)
            waiting.append(ids)
            if sum(map(len, waiting)) >= step:
                ids = np.concatenate(waiting)
                for a in range(0, len(ids) - step + 1, step):
                    put(ids[a : a + step])
                waiting = [ids[len(ids) // step * step :]]
            n = rows.num_rows
            out = [pa.array(np.full(n, stream), pa.int64()), pa.array(np.arange(ordinal, ordinal + n), pa.int64()), rows.column(0)]
            ordinal += n
            yield pa.RecordBatch.from_arrays(out, ["stream", "ordinal", key])
        if stream is not None:
            put(np.concatenate(waiting))

    cols = [F.col(key), F.col(text).alias("text"), F.spark_partition_id().cast("long").alias("part")]
    return df.select(*cols).mapInArrow(work, f"stream long, ordinal long, `{key}` {kind}")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """stream, block and content of the blocks under `path`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    return files.select(
        F.regexp_extract("path", NAME, 1).cast("long").alias("stream"), F.regexp_extract("path", NAME, 2).cast("long").alias("block"), "content"
    )


def scan(blocks: DataFrame, end_id: int, dtype: str = "<u2") -> DataFrame:
    """stream, ordinal, n_tokens (without the separator) and ended for every document."""

    def work(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for k in range(batch.num_rows):
                data = batch.column(2)[k].as_buffer()
                ids = np.frombuffer(data, dtype) if data is not None else np.zeros(0, dtype)
                at = np.flatnonzero(ids == end_id)
                head = int(at[0]) if len(at) else len(ids)
                tail = len(ids) - int(at[-1]) - 1 if len(at) else 0
                row = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), len(at), head, tail, np.diff(at) - 1)
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.list_(pa.int64()))], ["stream", "block", "n_ends", "head", "tail", "inner"])

    got = blocks.select("stream", "block", "content").mapInArrow(work, "stream long, block long, n_ends long, head long, tail long, inner array<long>")
    before = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # A block without separators hands on what it got; `epoch` groups it with the block that opened it.
    upto = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    small = got.withColumn("first", F.coalesce(F.sum("n_ends").over(before), F.lit(0))).withColumn("epoch", F.sum(F.when(F.col("n_ends") > 0, 1).otherwise(0)).over(upto))
    in_epoch = Window.partitionBy("stream", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    opened = small.withColumn("open", F.sum(F.when(F.col("n_ends") > 0, F.col("tail")).otherwise(F.col("head"))).over(in_epoch))
    by_block = Window.partitionBy("stream").orderBy("block")
    opened = opened.withColumn("carry", F.coalesce(F.lag("open").over(by_block), F.lit(0))).withColumn("last", F.lead("block").over(by_block).isNull())
    counts = F.when(F.col("n_ends") > 0, F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    ended = opened.select("stream", "first", F.posexplode(counts).alias("k", "n_tokens")).select("stream", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    rest = opened.where("last and open > 0").select("stream", (F.col("first") + F.col("n_ends")).alias("ordinal"), F.col("open").alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def count_documents(df: DataFrame, tokenizer_path: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Writes the documents as flat token files, scans these and returns key and n_tokens of every row."""
    from strandline.llm.storage import Scratch

    spark = df.sparkSession
    tmp = Scratch(spark, "token-counts")
    owners = tmp.save(write_stream(df, folder, tokenizer_path, end_id, key, text, block_bytes), "owners")
    _, dtype = layout(tokenizer_path, end_id)
    if not owners.head(1):
        return owners.select(key, F.lit(0).cast("long").alias("n_tokens"))
    found = scan(read_blocks(spark, folder), end_id, dtype).select(F.col("stream").alias("s"), F.col("ordinal").alias("o"), "n_tokens")
    both = owners.join(found, (F.col("stream") == F.col("s")) & (F.col("ordinal") == F.col("o")), "full")
    lone = F.col("stream").isNull() | F.col("s").isNull()
    told = F.when(lone, F.raise_error(F.lit("streams and documents differ"))).otherwise(F.col("n_tokens"))
    return both.select(F.col(f"`{key}`"), told.cast("long").alias("n_tokens"))
