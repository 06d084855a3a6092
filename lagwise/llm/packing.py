"""Packing: concatenate and cut.

Pass one encodes every document, numbers the tokens within its partition and
writes ids and partition totals.  A prefix sum over the totals, one row for
each partition, gives every partition its global offset.  Pass two cuts each
document at the multiples of the window; a document that crosses a boundary
gives one record for each window it touches.  No row is sorted or shuffled, and
a window never needs its documents together.

Defined cases: a null text is the empty text, one end id; repeated rows are
packed once each; a null id stays null; an empty table gives an empty table; a
document longer than a window spans as many as it needs; columns besides id and
text are not carried.  The last window alone may be short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import materialize, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Texts encoded at a time, in bytes; longer texts go alone.
STEP_BYTES = 2_000_000


def token_rows(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[list, list[bytes], np.dtype]]:
    """(doc ids, id bytes with the end id, type of the ids) of bounded slices."""
    enc = encoder(path)
    dtype = enc.dtype if end_id <= np.iinfo(enc.dtype).max else np.dtype("<u4")
    end = np.array([end_id], dtype).tobytes()

    def flush(keys: list, texts: list[str]) -> tuple[list, list[bytes], np.dtype]:
        ids = enc.encode(texts)
        if dtype != enc.dtype:
            ids = [np.frombuffer(x, enc.dtype).astype(dtype).tobytes() for x in ids]
        return keys, [x + end for x in ids], dtype

    for batch in batches:
        for part in slices(batch, 1, rows=2000, size=STEP_BYTES):
            yield flush(part.column(0).to_pylist(), [text or "" for text in part.column(1).to_pylist()])


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the windows of all documents, as ``PIECES``; ``path`` is the tokenizer's file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for keys, ids, dtype in token_rows(batches, path, end_id):
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // dtype.itemsize
            ends = at + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(keys, pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array(ids, pa.binary())],
                ["part", "doc_id", "local", "tokens", "ids"],
            )
            at = int(ends[-1])

    wide = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    rows = materialize(wide.mapInArrow(count, "part int, doc_id long, local long, tokens long, ids binary"), "tokens")
    totals = rows.groupBy("part").agg(F.sum("tokens").alias("tokens"))  # a row for each partition of the input
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, begins, sizes, blobs = (batch.column(i).to_pylist() for i in range(4))
            out: list[list] = [[] for _ in range(7)]
            for key, begin, n, blob in zip(keys, begins, sizes, blobs, strict=True):
                wide = np.frombuffer(blob, f"<u{len(blob) // n}").astype("<u4").tobytes()
                at = 0
                while at < n:
                    sequence, offset = divmod(begin + at, window)
                    length = min(window - offset, n - at)
                    row = (key, at, length, zlib.crc32(wide[4 * at : 4 * (at + length)]), n, sequence, offset)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [x.split()[0] for x in PIECES.split(", ")])

    placed = rows.join(F.broadcast(offsets), "part")  # bounded: two numbers for each partition of the input
    return placed.select("doc_id", (F.col("base") + F.col("local")).alias("begin"), "tokens", "ids").mapInArrow(cut, PIECES)
