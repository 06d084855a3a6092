"""Token-id files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file is a run of zstandard frames that hold the ids of whole documents, then a
frame with the index of its documents, then the seek table as a skippable frame
in the layout of the zstandard seekable format: compressed size, decompressed
size and the low half of the XXH64 of the content of every frame, the number of
frames, a descriptor and the magic number.  Any zstandard reader can decompress
a file as a whole; ``Reader`` fetches the tail and then only the frames that
hold the documents asked for.

Documents are dealt by ranges of ids to as many tasks as the input's size asks for, and a
task begins a new file whenever one has FILE_BYTES of ids, so files, their index and what a
writer holds are bounded whatever the input.

Defined cases: a null text is the empty text, one end id; ids ascend, null first,
equal ids by their text; an empty table writes no file and reads as no rows; a
document larger than a frame has a frame of its own; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_fs, materialize, scratch_path
from .packing import token_rows

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 18
#: Bytes of ids in a file, but for its last document, and bytes of input for a task.
FILE_BYTES = 1 << 27
TASK_BYTES = 1 << 28
ENTRY = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("offset", "<u4"), ("tokens", "<u8")])


class Writer:
    def __init__(self, out, id_bytes: int, level: int = 1):
        self.out, self.id_bytes = out, id_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.frames: list[tuple[int, int, int]] = []
        self.entries: list[tuple] = []
        self.held: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.size + len(ids) > FRAME_BYTES:
            self._flush()
        self.entries.append((doc_id or 0, doc_id is not None, len(self.frames), self.size, len(ids) // self.id_bytes))
        self.held.append(ids)
        self.size += len(ids)

    def _put(self, content: bytes) -> None:
        packed = self.zstd.compress(content)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.out.write(packed)

    def _flush(self) -> None:
        if self.held:
            self._put(b"".join(self.held))
        self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        self._put(struct.pack("<B", self.id_bytes) + np.array(self.entries, ENTRY).tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Random access to one file; ``read_bytes`` counts what was fetched."""

    def __init__(self, file, size: int):
        self.file, self.read_bytes = file, 0
        frames, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not descriptor & 0x80:
            raise ValueError("no seek table with checksums")
        raw = self._at(size - 9 - 12 * frames - 8, 12 * frames + 8)
        if struct.unpack_from("<II", raw) != (SKIPPABLE, 12 * frames + 9):
            raise ValueError("the seek table's size is wrong")
        self.table = np.frombuffer(raw, "<u4", offset=8).reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        index = self.frame(frames - 1)
        self.id_bytes = index[0]
        self.entries = np.frombuffer(index, ENTRY, offset=1)

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        out = self.file.read(length)
        if len(out) != length:
            raise ValueError("the file is cut")
        self.read_bytes += length
        return out

    def frame(self, k: int) -> bytes:
        packed, plain, check = (int(x) for x in self.table[k])
        out = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), packed), max_output_size=max(plain, 1))
        if len(out) != plain or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return out

    def documents(self, entries: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of the entries named, or of all, a frame in memory at a time."""
        at, content = -1, b""
        for i in range(len(self.entries)) if entries is None else entries:
            doc_id, known, frame, offset, n = self.entries[i].tolist()
            if frame != at:
                at, content = frame, self.frame(frame)
            yield doc_id if known else None, np.frombuffer(content, f"<u{self.id_bytes}", n, offset)

    def find(self, doc_ids: Iterable[int]) -> list[int]:
        """Entries of these documents; ids ascend, so a search, not a scan."""
        # null ids come first and hold 0: search behind them
        skip = int((self.entries["known"] == 0).argmin()) if len(self.entries) and not self.entries["known"].all() and self.entries["known"].any() else 0
        ids = self.entries["doc_id"][skip:]
        out = []
        for d in sorted(set(doc_ids)):
            out += range(skip + int(np.searchsorted(ids, d, "left")), skip + int(np.searchsorted(ids, d, "right")))
        return out


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write files of ascending ids; the manifest has a row for each file that a task committed.

    The manifest is a written table: a file that a lost or repeated task left is in no row of it.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // TASK_BYTES))
    file_bytes = FILE_BYTES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = arrow_fs(folder)
        part, number = TaskContext.get().partitionId(), 0
        writer = sink = name = None
        docs_n = tokens = 0

        def row() -> pa.RecordBatch:
            writer.close()
            sink.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([docs_n], pa.int64()), pa.array([tokens], pa.int64())],
                ["part", "number", "file", "docs", "tokens"],
            )

        for keys, ids, dtype in token_rows(batches, path, end_id):
            for key, x in zip(keys, ids, strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.tok.zst"
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                    writer = Writer(sink, dtype.itemsize)
                writer.add(key, x)
                tokens += len(x) // dtype.itemsize
                docs_n += 1
                if tokens * dtype.itemsize >= file_bytes:
                    yield row()
                    writer, number, docs_n, tokens = None, number + 1, 0, 0
        if writer is not None:
            yield row()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = ordered.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialize(ordered.mapInArrow(write, "part int, number int, file string, docs long, tokens long"), "manifest")


def input_bytes(docs: DataFrame) -> int:
    """The size of the input as the optimiser knows it; 0 where it doesn't."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def read_token_files(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the CRC-32 of the ids, from the files alone.

    With ``doc_ids``, only the frames that hold these are decompressed.
    """
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, where = arrow_fs(uri)
                with fs.open_input_file(where) as file:
                    reader = Reader(file, file.size())
                    sizes = reader.entries["tokens"].astype(np.int64)
                    starts = base + np.cumsum(sizes) - sizes
                    wanted = list(range(len(sizes))) if doc_ids is None else reader.find(doc_ids)
                    for at in range(0, len(wanted), 4096):
                        some = wanted[at : at + 4096]
                        found = [(d, zlib.crc32(ids.astype("<u4"))) for d, ids in reader.documents(some)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([d for d, _ in found], pa.int64()), pa.array(starts[some]), pa.array(sizes[some]), pa.array([c for _, c in found], pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    return read_token_files(write_token_files(docs, path, end_id))
