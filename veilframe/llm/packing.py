"""Packing by vector bins: sequences under limits on tokens, segments and loss-bearing tokens.

Texts longer than a sequence are cut into whole sequences and a rest. Rests are
placed by the dot-product heuristic: into the open sequence goes the fitting rest
whose demand, weighted by what is left in each dimension, is the largest.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from veilframe.llm.common import estimated_bytes, forget, name, small_batches
from veilframe.llm.tokens import MEMORY, encoder

POOL = 1024  # rests among which the heuristic chooses
PART_BYTES = 8 << 20  # least input of a task, so that its one half-filled sequence weighs little


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 4096
    segments: int = 128
    loss: int = 4096

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("every limit must be at least 1")


class Pool:
    """Pieces waiting for a place, with their demands in flat arrays."""

    def __init__(self, limits: Limits):
        self._limits = limits
        self._items: list = []
        self._tokens = np.zeros(2 * POOL, np.int64)
        self._loss = np.zeros(2 * POOL, np.int64)

    def __len__(self) -> int:
        return len(self._items)

    def add(self, tokens: int, loss: int, item) -> None:
        n = len(self._items)
        if n == len(self._tokens):
            self._tokens, self._loss = np.concatenate([self._tokens, self._tokens]), np.concatenate([self._loss, self._loss])
        self._tokens[n], self._loss[n] = tokens, loss
        self._items.append(item)

    def take(self, i: int):
        last = len(self._items) - 1
        item, self._items[i] = self._items[i], self._items[last]
        self._items.pop()
        self._tokens[i], self._loss[i] = self._tokens[last], self._loss[last]
        return item

    def filled(self) -> list:
        """The pieces of one sequence, taken out of the pool."""
        cap, placed = self._limits, []
        tokens, segments, loss = cap.tokens, cap.segments, cap.loss
        while self._items and segments and tokens:
            n = len(self._items)
            t, s = self._tokens[:n], self._loss[:n]
            score = t * (tokens / cap.tokens**2) + s * (loss / cap.loss**2) + segments / cap.segments**2
            score[(t > tokens) | (s > loss)] = -1.0
            best = int(score.argmax())
            if score[best] < 0:
                break
            tokens, segments, loss = tokens - int(t[best]), segments - 1, loss - int(s[best])
            placed.append(self.take(best))
        return placed


def cuts(n: int, loss_from: int, limits: Limits) -> Iterator[tuple[int, int, int]]:
    """(start, length, loss-bearing tokens) of the pieces of a document of ``n`` tokens.

    Every piece keeps within the limits on tokens and on loss by itself.
    """
    start = 0
    while start < n:
        quiet = max(0, min(n, loss_from) - start)
        length = min(limits.tokens, n - start, quiet + limits.loss)
        yield start, length, max(0, length - quiet)
        start += length


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: Limits = Limits(),
    end_id: int = 2,
    loss_from: Column | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids, loss_tokens, doc_tokens, sequence_id, offset.

    ``loss_from`` gives the first token of a row that bears loss (none: all do).
    A Python worker remembers encoded pieces from task to task; with ``pieces``
    it remembers no more than these and lets them go with each task, for a step
    among others that share its memory.
    ``ids`` holds little-endian unsigned 32-bit integers. Each id lies in exactly
    one piece; offsets within a sequence have no gaps.

    Null texts are empty: one piece with the end id alone. Repeated rows are
    packed as often as they come; texts of any length are encoded whole and cut.
    Rows without an id are packed under a null id. An empty table gives no piece. Tasks pack
    their rows without a shuffle, so the input should be a table or another
    source that gives a re-run task the same rows in the same order.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("loss_tokens", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    arrow, id_arrow, end = to_arrow_schema(schema), to_arrow_type(id_type), array("I", [end_id]).tobytes()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(columns[0], id_arrow), *[pa.array(c, f.type) for c, f in zip(columns[1:], list(arrow)[1:], strict=True)]]
        return pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        encode_one, pool, rows, size = encoder(tokenizer_path, pieces or MEMORY), Pool(limits), [], 0

        def place(pieces: list) -> None:
            nonlocal sequence, size
            offset = 0
            for doc, start, length, ids, loss, total in pieces:
                rows.append((doc, start, length, ids, loss, total, sequence, offset))
                offset += length
                size += len(ids)
            sequence += 1

        for batch in batches:
            for doc, value, quiet in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = encode_one(value.as_py() or "") + end
                total = len(ids) // 4
                for start, length, loss in cuts(total, quiet or 0, limits):
                    piece = (doc, start, length, ids[4 * start : 4 * (start + length)], loss, total)
                    if length == limits.tokens:
                        place([piece])
                    else:
                        pool.add(length, loss, piece)
                if len(pool) >= POOL:
                    while len(pool) > POOL // 2:
                        place(pool.filled())
                if size > 4 << 20:
                    yield batch_of(rows)
                    rows.clear()
                    size = 0
        while len(pool):
            place(pool.filled())
        if rows:
            yield batch_of(rows)
        if pieces is not None:
            del encode_one
            forget()

    quiet = F.lit(0).cast("long") if loss_from is None else F.coalesce(loss_from.cast("long"), F.lit(0))
    rows = docs.select(name(id_col), name(text_col).cast("string"), quiet)
    parts = max(1, -(-estimated_bytes(docs) // PART_BYTES))
    return rows.coalesce(min(parts, 1_000_000)).mapInArrow(run, schema)


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns of a result of :func:`pack`, and the loss-bearing tokens of each piece."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")
