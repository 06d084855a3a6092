"""Line dedup with a sharded minimal perfect hash that documents probe.

A line's key is the line without white space at its ends, A-Z in lower case; its
hash is the MD5 of the key as two 64-bit words.  Pass one counts, for every
distinct line hash, the documents that hold it (a document names each of its
lines once, so a line that every document holds costs a count for each task).
All distinct hashes are dealt to shards of bounded size: first those that reach
the limit, then the rest, which no document needs to probe to lose a line.  Each
shard is a minimal perfect hash (levels of bit arrays; a key stands where it was
alone) that indexes an array of fingerprints, the other 64 bits of the hash, and
an array of counts.  The shards are a written table in the shared folder;
``line_counts`` looks any line up in both kinds.

Pass two reads the documents again and probes.  A task gathers documents until
their lines are many for each shard, or a bound of bytes, and sorts the hashes by
shard, so a shard is loaded once for many probes; a worker holds a bounded number
of shards.  No line is joined and no text is shuffled.  A line is dropped only if
shard, slot and all 64 bits of the fingerprint agree, so a false drop is a
collision of MD5 in effect.

Defined cases: a null or empty text is one empty line, and a null text stays null
in ``drop_lines``; empty keys are never dropped; repeated rows are documents each;
an empty table gives an empty table; other columns pass through unless they are
named like what is added.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE, arrow_fs, blobs, claim, drop, materialize, mix64, scratch_path, slices

#: Keys of a shard, but for chance, and shards that a worker holds: some 3 MB each.
SHARD_KEYS = 1 << 17
HELD_SHARDS = 64
LEVELS = 40
#: Lines that a task gathers for each shard before it probes, and the bytes of text that it holds for that at most.
PROBES = 4096
HELD_BYTES = 64_000_000


def keys_of(text: bytes | None) -> tuple[list[bytes], list[bytes]]:
    lines = (text or b"").split(b"\n")
    return lines, [x.strip(SPACE) for x in (text or b"").translate(LOWER).split(b"\n")]


def hashes(keys: list[bytes]) -> np.ndarray:
    """(n, 2) little-endian 64-bit words."""
    md5 = hashlib.md5
    return np.frombuffer(b"".join([md5(k).digest() for k in keys]), "<u8").reshape(-1, 2)


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: 0..n-1 for members, any slot or -1 for others."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, left = [], [], keys
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            size = max(8, 2 * len(left))
            at = _slot(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(bits) if bits else np.zeros(0, bool))

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.begins[level] + _slot(keys[open_], level, size)
            hit = self.bits[at]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit]
        return out


class Shard:
    def __init__(self, sizes: list[int], bits: bytes, fingerprints: bytes, counts: bytes):
        total = sum(sizes)
        self.hash = PerfectHash(sizes, np.unpackbits(np.frombuffer(bits, np.uint8), count=total).astype(bool))
        self.fingerprints, self.counts = np.frombuffer(fingerprints, "<u8"), np.frombuffer(counts, "<u4")

    @staticmethod
    def pack(lo: np.ndarray, hi: np.ndarray, counts: np.ndarray) -> tuple[list[int], bytes, bytes, bytes]:
        h = PerfectHash.build(lo)
        at = h.index(lo)
        prints, numbers = np.zeros(len(lo), "<u8"), np.zeros(len(lo), "<u4")
        prints[at], numbers[at] = hi, np.minimum(counts, 0xFFFFFFFF)
        return list(h.sizes), np.packbits(h.bits).tobytes(), prints.tobytes(), numbers.tobytes()

    def probe(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The count of each key, 0 where the shard doesn't hold it."""
        at = self.hash.index(lo)
        known = at >= 0
        out = np.zeros(len(lo), np.int64)
        if len(self.counts):
            at = np.where(known, at, 0)
            out = np.where(known & (self.fingerprints[at] == hi), self.counts[at], 0).astype(np.int64)
        return out


class Index:
    """The shards of a folder; a worker loads what it probes and drops the least recently used.

    Of ``frequent + rare`` shards the first hold the hashes that reach the limit.
    """

    def __init__(self, folder: str, frequent: int, rare: int):
        self.folder, self.frequent, self.rare = folder, frequent, rare
        self.held: OrderedDict[int, Shard | None] = OrderedDict()

    def shard(self, k: int) -> Shard | None:
        if k not in self.held:
            from pyarrow import fs as pfs

            fs, root = arrow_fs(self.folder)
            found = fs.get_file_info(pfs.FileSelector(f"{root}/shard={k}", allow_not_found=True))
            files = [f.path for f in found if f.path.endswith(".parquet")]
            self.held[k] = None
            for f in files:  # one file with one row
                row = pq.ParquetFile(fs.open_input_file(f)).read().to_pylist()[0]
                self.held[k] = Shard(row["sizes"], row["bits"], row["fingerprints"], row["counts"])
            if len(self.held) > HELD_SHARDS:
                self.held.popitem(last=False)
        self.held.move_to_end(k)
        return self.held[k]

    def counts(self, h: np.ndarray, rare: bool = False) -> np.ndarray:
        """The documents that hold each line; 0 for those under the limit unless ``rare``."""
        out = np.zeros(len(h), np.int64)
        lo, hi = h[:, 0], h[:, 1]
        for first, shards in ((0, self.frequent), (self.frequent, self.rare if rare else 0)):
            if not shards or not len(h):
                continue
            shard = first + (hi % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            for part in np.split(order, cuts):
                if found := self.shard(int(shard[part[0]])):
                    out[part] = np.maximum(out[part], found.probe(lo[part], hi[part]))
        return out


_indexes: OrderedDict[str, Index] = OrderedDict()


def _index(folder: str, frequent: int, rare: int) -> Index:
    if folder not in _indexes:
        _indexes.clear()
        _indexes[folder] = Index(folder, frequent, rare)
    return _indexes[folder]


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim()
    for batch in batches:
        keys: list[bytes] = []
        for text in blobs(batch.column(0)):
            keys += {k for k in keys_of(text)[1] if k}
            if len(keys) > 200_000:
                yield _pairs(keys)
                keys = []
        yield _pairs(keys)


def _pairs(keys: list[bytes]) -> pa.RecordBatch:
    h = hashes(keys).view("<i8")
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))], ["lo", "hi"])


def build_index(docs: DataFrame, min_docs: int, text_col: str = "text") -> tuple[str, int, int]:
    """(folder of the shards, number of those for lines found in at least ``min_docs`` documents, number of the others)."""
    spark = docs.sparkSession
    lines = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_line_rows, "lo long, hi long")
    found = materialize(lines.groupBy("lo", "hi").agg(F.count("*").alias("n")), "lines")
    rare = F.col("n") < min_docs
    n = {r.rare: r.n for r in found.groupBy(rare.alias("rare")).agg(F.count("*").alias("n")).collect()}  # two rows
    frequent, others = (-(-n.get(k, 0) // SHARD_KEYS) for k in (False, True))
    folder = scratch_path(spark, "shards")

    def dealt(shards: int) -> Column:  # the unsigned remainder
        m = max(shards, 1)
        return (F.col("hi") % m + F.lit(pow(2, 64, m)) * (F.col("hi") < 0).cast("long") + m) % m

    def pack(t: pa.Table) -> pa.Table:  # one shard, of bounded size
        lo, hi, c = (t.column(x).to_numpy() for x in ("lo", "hi", "n"))
        sizes, bits, prints, numbers = Shard.pack(lo.view("<u8"), hi.view("<u8"), c)
        return pa.table({"shard": t.column("shard").slice(0, 1), "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": [bits], "fingerprints": [prints], "counts": [numbers]})

    schema = "shard long, sizes array<long>, bits binary, fingerprints binary, counts binary"
    shard = F.when(rare, frequent + dealt(others)).otherwise(dealt(frequent)).cast("long")
    found.withColumn("shard", shard).groupBy("shard").applyInArrow(pack, schema).write.partitionBy("shard").option("compression", "none").parquet(folder)
    drop(found)
    return folder, frequent, others


def line_counts(lines: DataFrame, index: tuple[str, int, int], line_col: str = "line") -> DataFrame:
    """``lines`` with n_docs, in how many documents of the index each line is."""
    schema = T.StructType([*lines.schema.fields, T.StructField("n_docs", T.LongType())])
    place = lines.columns.index(line_col)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for batch in batches:
            keys = [(x or b"").translate(LOWER).strip(SPACE) for x in blobs(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_index(*index).counts(hashes(keys), rare=True))], [f.name for f in schema])

    return lines.mapInArrow(look, schema)


ADDED = ("n_lines", "n_dropped", "kept_text")


def drop_lines(docs: DataFrame, min_docs: int = 10, min_key: int = 1, text_col: str = "text", added: Sequence[str] = ADDED) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text, or what ``added`` names them: each text without the lines whose key at least ``min_docs`` documents hold."""
    built = build_index(docs, min_docs, text_col)
    docs = docs.drop(*added)
    names = [*docs.columns, *added]
    place = docs.columns.index(text_col)
    docs = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names may hold what Arrow functions can't resolve
    schema = T.StructType([*docs.schema.fields, *(T.StructField(f"a{name}", kind) for name, kind in zip(added, (T.LongType(), T.LongType(), T.StringType()), strict=True))])

    def judged(held: list[tuple[pa.RecordBatch, list[int], np.ndarray]], index: Index) -> Iterator[pa.RecordBatch]:
        gone = index.counts(np.concatenate([h for _, _, h in held])) >= min_docs
        at = 0
        for batch, sizes, _ in held:
            dropped, kept = [], []
            for text, n in zip(blobs(batch.column(place)), sizes, strict=True):
                out = gone[at : at + n]
                at += n
                less = 0
                if out.any():
                    lines, keys = keys_of(text)
                    stay = [x for x, k, g in zip(lines, keys, out.tolist(), strict=True) if not (g and k and (min_key <= 1 or len(k.decode()) >= min_key))]
                    less = n - len(stay)
                    text = b"\n".join(stay)
                dropped.append(less)
                kept.append(text)
            kept_col = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), kept_col], [f.name for f in schema])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        index = _index(*built)
        held: list = []
        lines = size = 0
        for batch in batches:
            for part in slices(batch, place, rows=2000):
                keys = [keys_of(t)[1] for t in blobs(part.column(place))]
                held.append((part, [len(k) for k in keys], hashes([k for x in keys for k in x])))
                lines += len(held[-1][2])
                size += part.nbytes
                if lines >= PROBES * index.frequent or size >= HELD_BYTES:
                    yield from judged(held, index)
                    held, lines, size = [], 0, 0
        if held:
            yield from judged(held, index)

    return docs.mapInArrow(probe, schema).toDF(*names)


def line_digests(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    kept = drop_lines(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), min_docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
