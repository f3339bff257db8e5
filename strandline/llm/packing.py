"""Packing of tokenised examples into training sequences by vector bin packing.

An example asks for tokens, one segment and loss-bearing tokens; a sequence limits all three. Among
the waiting examples that fit, the one whose demand has the largest dot product with the room left
is placed next. When none fits, one is cut so that the sequence becomes full. What is left at the end
of a partition is cut into sequences whose lengths are powers of two, so that nothing is padded.

A partition is packed as it is read, without a shuffle; at most `pool` examples wait at a time.
Null texts count as empty; an empty example is its end token. Very long texts are cut into pieces, none
is lost; whole stretches of `seq_len` tokens without a prompt become sequences at once. Ties of the dot
product go to the first place of the pool. Repeated rows are packed each.
An empty table gives an empty table. Extra columns, whatever their names, are ignored; a key column may
not be named like one of the result's.

Without prompts every token bears loss, so the loss limit binds only where it is set below `seq_len`, and
two of the three demands are in effect in a packing of plain documents. `replies` makes examples of
conversations, whose prompts carry no loss: there all three are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import bpe

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


class Packer:
    """Places examples (key, ids, number of leading ids without loss); `done` gets finished pieces."""

    def __init__(self, seq_len: int, max_segments: int, max_loss: int, pool: int):
        self.cap = np.array([seq_len, max_segments, max_loss], float)
        self.pool = pool
        self.items: list[list] = []  # key, ids, prompt, start, end
        self.demand = np.zeros((2 * pool + 2, 3))
        self.sequence = 0
        self.done: list[tuple] = []

    def add(self, key, ids: np.ndarray, prompt: int = 0) -> None:
        if prompt == 0 and self.cap[2] >= self.cap[0]:
            start, size = 0, int(self.cap[0])
            while len(ids) - start >= size:
                self._emit([(key, ids, prompt, start, start + size)])
                start += size
            if start == len(ids):
                return
        else:
            start = 0
        self._wait([key, ids, prompt, start, len(ids)])
        if len(self.items) >= self.pool:
            while len(self.items) > self.pool // 2:
                self._fill()

    def _loss(self, item) -> int:
        _, _, prompt, start, end = item
        return end - max(start, min(prompt, end))

    def _wait(self, item) -> None:
        self.demand[len(self.items)] = (item[4] - item[3], 1, self._loss(item))
        self.items.append(item)

    def _take(self, k: int) -> list:
        item, last = self.items[k], len(self.items) - 1
        self.items[k], self.demand[k] = self.items[last], self.demand[last]
        self.items.pop()
        return item

    def _fill(self) -> None:
        room, placed = self.cap.copy(), []
        while self.items and room[0] >= 1 and room[1] >= 1:
            d = self.demand[: len(self.items)]
            fits = (d <= room).all(1)
            if fits.any():
                score = np.where(fits, (d / self.cap) @ (room / self.cap), -1)
                item = self._take(int(score.argmax()))
            else:
                item = self._cut(room)
                if item is None:
                    break
            placed.append(tuple(item))
            room -= (item[4] - item[3], 1, self._loss(item))
        self._emit(placed)

    def _cut(self, room: np.ndarray):
        """The longest head that fits of the example that leaves most behind."""
        k = int(self.demand[: len(self.items), 0].argmax())
        key, ids, prompt, start, end = self.items[k]
        stop = min(end, start + int(room[0]))
        if stop - max(start, min(prompt, stop)) > room[2]:
            stop = max(start, prompt) + int(room[2])
        if stop <= start:
            return None
        self.items[k][3] = stop
        self.demand[k] = (end - stop, 1, self._loss(self.items[k]))
        return [key, ids, prompt, start, stop]

    def _emit(self, placed: list[tuple]) -> None:
        """A full sequence, or several whose lengths are powers of two."""
        left = sum(x[4] - x[3] for x in placed)
        size, used = int(self.cap[0]), 0
        width = size if left == size else 1 << (left.bit_length() - 1) if left else 0
        for key, ids, prompt, start, end in placed:
            while start < end:
                stop = min(end, start + width - used)
                crc = zlib.crc32(ids[start:stop].tobytes())
                self.done.append((key, start, stop - start, crc, len(ids), self.sequence, used, self._loss((key, ids, prompt, start, stop)), ids[start:stop]))
                used += stop - start
                start = stop
                if used == width:
                    self.sequence, left, used = self.sequence + 1, left - width, 0
                    width = 1 << (left.bit_length() - 1) if left else 0

    def finish(self) -> None:
        while self.items:
            self._fill()


def pack(
    df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", prompt: str | None = None, end_id: int = 2,
    seq_len: int = 4096, max_segments: int = 256, max_loss: int | None = None, pool: int = 1024, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: key, start and length in its document, CRC-32 of its ids, the document's
    tokens, sequence_id, offset there, loss-bearing tokens, and the ids if asked for. `prompt` names a
    column whose tokens come first and carry no loss."""
    if key in names_of(PIECE):
        raise ValueError(f"a key column can't be named {key}")
    cols = [F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")]
    if prompt:
        cols.append(F.coalesce(F.col(prompt), F.lit("")).alias("prompt"))
    cols.append(F.spark_partition_id().cast("long").alias("part"))
    kind = df.schema[key].dataType.simpleString()
    names = [key, *names_of(PIECE)] + ["ids"] * with_ids

    def table(rows, part):
        out = list(zip(*rows, strict=True)) if rows else [[] for _ in range(9)]
        arrays = [pa.array(out[0]), *(pa.array(x, pa.int64()) for x in out[1:8])]
        arrays[5] = pa.array([part << 33 | s for s in out[5]], pa.int64())
        return pa.RecordBatch.from_arrays(arrays + [pa.array([x.tolist() for x in out[8]], pa.list_(pa.int32()))] * with_ids, names)

    def work(batches):
        packer, part = Packer(seq_len, max_segments, max_loss or seq_len, pool), 0
        enc = bpe.encoder(tokenizer_path)
        for rows, flat, off in bpe.encoded(batches, "text", tokenizer_path):
            keys = rows.column(0).to_pylist()
            part = rows.column(rows.num_columns - 1)[0].as_py() if len(keys) else part
            heads = enc.encode(rows.column(2).to_pylist()) if prompt else None
            flat = flat.astype("<u4")
            for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                head = heads[0][heads[1][k] : heads[1][k + 1]].astype("<u4") if heads else flat[:0]
                packer.add(keys[k], np.concatenate((head, flat[a:b], np.array([end_id], "<u4"))), len(head))
            if packer.done:
                yield _typed(table(packer.done, part), kind)
                packer.done = []
        packer.finish()
        if packer.done:
            yield _typed(table(packer.done, part), kind)

    return df.select(*cols).mapInArrow(work, f"`{key}` {kind}, {PIECE}" + ", ids array<int>" * with_ids)


def replies(turns: DataFrame) -> DataFrame:
    """key (conversation and turn), prompt and text of every assistant's turn of (conv_id, turn, role, text): the
    prompt is the turn before it, empty at a conversation's begin. Turns are joined by both columns, so that a long
    conversation is no hot key; of repeated turns before, the smallest text counts, and repeated replies stay each.
    Rows without a conversation or turn have no turn before them."""
    before = turns.groupBy(F.col("conv_id").alias("_c"), (F.col("turn") + 1).alias("_t")).agg(F.min("text").alias("prompt"))
    own = turns.where("role = 'assistant'").select("conv_id", "turn", "text")
    joined = own.join(before, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    return joined.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), "prompt", "text")


def _typed(batch: pa.RecordBatch, kind: str) -> pa.RecordBatch:
    want = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, batch.column(0).type)
    return pa.RecordBatch.from_arrays([batch.column(0).cast(want), *batch.columns[1:]], batch.schema.names)
