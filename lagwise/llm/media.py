"""Media columns: ISO media containers.

``encode`` stores bytes as 8-bit grey frames of 8 x 8 samples in a movie of one
track; ``probe`` walks the nested boxes of any such container, decodes the
sample tables, those of movie fragments too, and gives codec, duration and the byte
ranges of the keyframes without touching a payload; ``payload`` reads the stored samples back by those
tables.  ``media_columns`` applies all three to a text column in one pass over
the rows: no shuffle, memory of one Arrow batch.

Defined cases: a null text is the empty text; the empty text is one frame of
zeros; repeated rows give equal rows; an empty table gives an empty table;
columns other than the key and the text are not carried.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs

FRAME = 64
FRAMES_PER_CHUNK = 256
KEY_INTERVAL = 16
TIMESCALE = 25
#: Boxes that hold boxes, from ISO/IEC 14496-12; meta has four bytes of version and flags first.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pad(data: bytes) -> bytes:
    """Zeros up to a positive multiple of a frame."""
    return data + bytes(-len(data) % FRAME if data else FRAME)


def encode(data: bytes) -> bytes:
    """A movie whose frames are ``data``, a positive multiple of 64 bytes; equal data, equal bytes."""
    n = len(data) // FRAME
    chunks = -(-n // FRAMES_PER_CHUNK)
    last = n - (chunks - 1) * FRAMES_PER_CHUNK
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    head = 16 if len(data) + 8 >= 1 << 32 else 8
    entry = _box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 0x28, -1)
    )
    runs = [(1, FRAMES_PER_CHUNK if chunks > 1 else last, 1)] + ([(chunks, last, 1)] if chunks > 1 and last != FRAMES_PER_CHUNK else [])
    keys = range(1, n + 1, KEY_INTERVAL)

    def moov(first: int) -> bytes:
        offsets = [first + i * FRAMES_PER_CHUNK * FRAME for i in range(chunks)]
        wide = offsets[-1] >= 1 << 32
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        hdlr = _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0")
        mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0))
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhH", 0, 0, 0, 0), MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    size = len(moov(0))
    out = moov(len(ftyp) + size + head)
    if len(out) != size:  # the offsets needed 64 bits
        out = moov(len(ftyp) + len(out) + head)
    return ftyp + out + _box(b"mdat", data)


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, start and end of the body) of the boxes side by side; ValueError where a size can't be."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError(f"cut box header at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError(f"cut box header at {start}")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has size {size}")
        yield kind, start + head, start + size
        start += size


@dataclass
class Track:
    """One track as its sample tables tell it; ranges are (offset, length) in the file."""

    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: tuple[int, int, tuple[int, ...]] = (0, 0, ())
    chunks: tuple[int, ...] = ()
    per_chunk: tuple[tuple[int, int, int], ...] = ()
    sync: tuple[int, ...] | None = None
    times: list[tuple[int, int]] = field(default_factory=list)
    track_id: int = 0
    #: Runs of samples of movie fragments: first offset, sizes, which are keyframes, duration of all.
    runs: list[tuple[int, tuple[int, ...], tuple[bool, ...], int]] = field(default_factory=list)

    def samples(self) -> Iterator[tuple[int, int]]:
        yield from self._table_samples()
        for at, sizes, _, _ in self.runs:
            for n in sizes:
                yield at, n
                at += n

    def count(self) -> int:
        return self.sizes[1] + sum(len(sizes) for _, sizes, _, _ in self.runs)

    def length(self) -> int:
        """Units of the time scale: the header's, or what samples last where it has none because fragments follow."""
        return self.duration or sum(n * d for n, d in self.times) + sum(d for _, _, _, d in self.runs)

    def _table_samples(self) -> Iterator[tuple[int, int]]:
        fixed, count, each = self.sizes
        k = run = 0
        for c, at in enumerate(self.chunks, 1):
            while run + 1 < len(self.per_chunk) and self.per_chunk[run + 1][0] <= c:
                run += 1
            for _ in range(self.per_chunk[run][1] if self.per_chunk else 0):
                if k >= count:
                    return
                n = fixed or each[k]
                yield at, n
                at += n
                k += 1

    def chunk_ranges(self) -> list[tuple[int, int]]:
        fixed, count, each = self.sizes
        out, k, run = [], 0, 0
        for c, at in enumerate(self.chunks, 1):
            while run + 1 < len(self.per_chunk) and self.per_chunk[run + 1][0] <= c:
                run += 1
            m = min(self.per_chunk[run][1] if self.per_chunk else 0, count - k)
            out.append((at, fixed * m if fixed else sum(each[k : k + m])))
            k += m
        return out + [(at, sum(sizes)) for at, sizes, _, _ in self.runs]

    def keyframes(self) -> list[tuple[int, int]]:
        """Every sample is a keyframe where the table of sync samples is absent."""
        wanted = None if self.sync is None else set(self.sync)
        flags = [wanted is None or k in wanted for k in range(1, self.sizes[1] + 1)] + [f for _, _, keys, _ in self.runs for f in keys]
        return [r for r, f in zip(self.samples(), flags, strict=False) if f]


def _table(data: bytes, at: int, end: int, form: str) -> tuple[int, ...]:
    (n,) = struct.unpack_from(">I", data, at + 4)
    if at + 8 + n * struct.calcsize(">" + form) > end:
        raise ValueError("a sample table is longer than its box")
    return struct.unpack_from(">" + form * n if len(form) > 1 else f">{n}{form}", data, at + 8)


def _compact_sizes(data: bytes, at: int, end: int) -> tuple[int, int, tuple[int, ...]]:
    """The sizes of stz2: 4, 8 or 16 bits each."""
    bits, (count,) = data[at + 7], struct.unpack_from(">I", data, at + 8)
    if bits not in (4, 8, 16) or at + 12 + (count * bits + 7) // 8 > end:
        raise ValueError("a table of compact sizes is wrong")
    if bits == 4:
        each = tuple(x for b in data[at + 12 : at + 12 + (count + 1) // 2] for x in (b >> 4, b & 15))[:count]
    else:
        each = struct.unpack_from(f">{count}{'B' if bits == 8 else 'H'}", data, at + 12)
    return 0, count, each


#: Flag of a sample that is no keyframe, and the optional fields of tfhd and of a sample of trun by their flags (ISO/IEC 14496-12).
NOT_SYNC = 0x10000
TFHD = ((0x1, "base", "Q"), (0x2, "description", "I"), (0x8, "duration", "I"), (0x10, "size", "I"), (0x20, "flags", "I"))
TRUN = ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "composition"))


def _fields(data: bytes, at: int, end: int, flags: int, known) -> dict[str, int]:
    out = {}
    for flag, name, form in known:
        if flags & flag:
            if at + struct.calcsize(form) > end:
                raise ValueError("a fragment's header is longer than its box")
            (out[name],) = struct.unpack_from(">" + form, data, at)
            at += struct.calcsize(form)
    return out


def _fragment(data: bytes, moof: int, at: int, end: int, tracks: dict[int, Track], defaults: dict[int, dict[str, int]], follows: int) -> int:
    """Adds the runs of one traf to its track; the end of its data, where the next one's begins unless it says otherwise."""
    track = own = None
    place = follows
    for kind, start, stop in boxes(data, at, end):
        if kind not in (b"tfhd", b"trun"):
            continue
        flags = struct.unpack_from(">I", data, start)[0] & 0xFFFFFF
        if kind == b"tfhd":
            (number,) = struct.unpack_from(">I", data, start + 4)
            if number not in tracks:
                raise ValueError(f"a fragment of track {number}, which the movie doesn't have")
            track = tracks[number]
            given = _fields(data, start + 8, stop, flags, TFHD)
            own = defaults.get(number, {}) | given
            base = given.get("base", moof if flags & 0x20000 else follows)
            place = base
            continue
        if track is None:
            raise ValueError("a run of samples before its header")
        (count,) = struct.unpack_from(">I", data, start + 4)
        head = _fields(data, start + 8, stop, flags, ((0x1, "offset", "i"), (0x4, "first", "I")))
        if "offset" in head:
            place = base + head["offset"]
        names = [n for f, n in TRUN if flags & f]
        first = start + 8 + 4 * len(head)
        if first + 4 * len(names) * count > stop:
            raise ValueError("a run of samples is longer than its box")
        table = struct.unpack_from(f">{len(names) * count}I", data, first)
        column = {n: table[i :: len(names)] for i, n in enumerate(names)}
        sizes = column.get("size", (own.get("size", 0),) * count)
        marks = list(column.get("flags", (own.get("flags", 0),) * count))
        if "first" in head and marks:
            marks[0] = head["first"]
        lasts = sum(column.get("duration", (own.get("duration", 0),) * count))
        track.runs.append((place, tuple(sizes), tuple(not m & NOT_SYNC for m in marks), lasts))
        place += sum(sizes)
    return place


def probe(data: bytes) -> list[Track]:
    """The tracks of a container."""
    tracks: list[Track] = []
    defaults: dict[int, dict[str, int]] = {}

    def walk(start: int, end: int) -> None:
        for kind, at, stop in boxes(data, start, end):
            if kind == b"trak":
                tracks.append(Track())
            if kind == b"moof":
                follows = at - (16 if struct.unpack_from(">I", data, at - 16)[0] == 1 and data[at - 12 : at - 8] == b"moof" else 8)
                begin = follows
                for inner, a, z in boxes(data, at, stop):
                    if inner == b"traf":
                        follows = _fragment(data, begin, a, z, {t.track_id: t for t in tracks}, defaults, follows)
                continue
            if kind in CONTAINERS:
                walk(at, stop)
                continue
            if kind == b"trex":
                number, _, duration, size, flags = struct.unpack_from(">IIIII", data, at + 4)
                defaults[number] = {"duration": duration, "size": size, "flags": flags}
            if not tracks:
                continue
            t = tracks[-1]
            if kind == b"tkhd":
                (t.track_id,) = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))
            elif kind == b"mdhd":
                t.timescale, t.duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
            elif kind == b"hdlr" and not t.handler:
                t.handler = data[at + 8 : at + 12].decode("latin-1")
            elif kind == b"stsd":
                t.codec = next((k.decode("latin-1") for k, _, _ in boxes(data, at + 8, stop)), "")
            elif kind == b"stts":
                v = _table(data, at, stop, "II")
                t.times = list(zip(v[::2], v[1::2], strict=True))
            elif kind == b"stss":
                t.sync = _table(data, at, stop, "I")
            elif kind == b"stsc":
                v = _table(data, at, stop, "III")
                t.per_chunk = tuple(zip(v[::3], v[1::3], v[2::3], strict=True))
            elif kind == b"stsz":
                fixed, count = struct.unpack_from(">II", data, at + 4)
                t.sizes = (fixed, count, () if fixed else _table(data, at + 4, stop, "I"))
            elif kind == b"stz2":
                t.sizes = _compact_sizes(data, at, stop)
            elif kind == b"stco":
                t.chunks = _table(data, at, stop, "I")
            elif kind == b"co64":
                t.chunks = _table(data, at, stop, "Q")

    walk(0, len(data))
    return tracks


def payload(data: bytes, track: Track) -> bytes:
    """The stored samples, in order, from the places that the sample tables name."""
    return b"".join(data[a : a + n] for a, n in track.chunk_ranges())


def feature(track: Track) -> str:
    keys = track.keyframes()
    return f"codec={track.codec.strip()};seconds={track.length()}/{track.timescale};samples={track.count()};keyframes={len(keys)};ranges=" + ",".join(
        f"{a}+{n}" for a, n in keys
    )


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for raw in blobs(batch.column(1)):
            raw = raw or b""
            media = encode(pad(raw))
            (track,) = probe(media)
            back = payload(media, track)
            row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature(track))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text in a container, read it back, and return digests and the keyframe feature."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_rows, SCHEMA)
