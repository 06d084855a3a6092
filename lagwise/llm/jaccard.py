"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection.

1. Shingles.  A document's set holds the 64-bit hashes of its distinct five-word
   shingles.  Equal sets are one class; only classes are compared, so copies cost
   nothing further.  One pass writes classes' sorted arrays (48 bits a shingle) and
   names the shingles frequent within a batch.
2. Tiles.  Two sets with Jaccard t share one of the first n - ceil(t n) + 1 shingles
   of either in any fixed order.  The order has frequent shingles last (their number
   is bounded by FREQUENT), then goes by hash.  Classes with a prefix shingle in
   common, and of sizes that t allows, form a tile.
   Tiles of the same classes are one tile, told by count and two sums of hashes of
   their classes: texts that share a passage share tens of shingles.  Tiles of one cell go to tasks by their
   smallest class, so that a class's bitmap travels once for several of its tiles.
3. Links by leaders.  In each tile of more than LEAD and band of sizes every class is
   held against the smallest of them: a pair a row, not a pair a pair.  Bit counts of
   hashed bitmaps bound the overlap from above; the pairs left are verified on the
   sorted arrays.  Their components are joined, and tiles in one component need no more.
4. What is left is cut to cells of bounded size (blocks against blocks; of a large tile
   the largest component isn't held against itself).  Within a cell pairs of different
   components that pass size and bitmap bound are candidates.  A first round names the
   rows that have any, and of the candidates the most promising that join a task's
   components, a forest.  Once these are verified, a second round holds the rows named
   against each other by wider bitmaps, and all candidates that are still of different
   components go on to the exact intersection.  No pair is given up, no group is
   collected whole.
5. Components by alternating neighbourhood minima, in written tables.

The pair test is exact on the arrays: 100 * intersection >= 80 * union, with sizes
counted on 64 bits.

Defined cases: null or wordless texts have the empty set and link with nothing;
texts under five words are one shingle, the whole sequence; repeated rows are in one
component; null ids are passed over when a component is named, and a component of
null ids alone has a null name; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_rows, blobs, claim, drop, fresh, materialize, mix64, named, slices, sweep
from .words import N, Texts

#: Shingles that may count as frequent: their table goes to all tasks, 8 bytes each.
FREQUENT = 1 << 19
LOCAL = 2
#: Pairs of arrays handed to a worker at a time.
PAIR_ROWS = 256
#: Elements of arrays that are looked at together.
HELD_KEYS = 1 << 20
#: Rows that a pair with its arrays counts as where tasks are dealt.
PAIR_WEIGHT = 64
#: Parts that a frequent shingle's rows are dealt to.
SALTS = 63
#: Classes in a block of a cell; tiles of more than LEAD have leaders first.
BLOCK = 2048
LEAD = 2048


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of a text; of the whole sequence if it is shorter."""
    return sets_of([text])[0]


def sets_of(texts: list[bytes | None]) -> list[np.ndarray]:
    """The shingles of each text."""
    found = Texts(texts)
    flat = found.shingles()
    out = []
    for k, (b, e) in enumerate(zip(found.begins[:-1].tolist(), found.begins[1:].tolist(), strict=True)):
        if e - b >= N:
            out.append(distinct(np.sort(flat[b : e - N + 1])))
        else:
            out.append(np.array([found.short(k)] if e > b else [], np.uint64))
    return out


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted keys, each once."""
    if len(keys) < 2 or (other := keys[1:] != keys[:-1]).all():
        return keys
    return keys[np.concatenate([[True], other])]


def pack48(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes, each once."""
    return distinct(hashes >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def bitmap_words(n: int, wide: bool = False) -> int:
    """64-bit words of a set's bitmap, a power of two: 1024 bits at least; one to two bits an element up to 64 Kbit, or 8 to 16 up to 128 Kbit."""
    bits = (max(n, 1) - 1).bit_length()
    return min(2048, 1 << max(4, bits - 3)) if wide else min(1024, 1 << max(4, bits - 6))


def bitmap(keys: np.ndarray, wide: bool = False) -> bytes:
    bits = bitmap_words(len(keys), wide) * 64
    out = np.zeros(bits, bool)
    out[((keys >> np.uint64(6)) % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps cut to ``words`` words, a power of two: positions go modulo the length."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def need(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """The smallest intersection that links sets of these sizes: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def overlap_bound(x: np.ndarray, y: np.ndarray, a, b):
    """At most so many elements are common: the bits that differ come from elements that differ."""
    return (a + b - np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)) // 2


SETS = "doc_id long, rk long, n int, cls long, arr binary, hot array<long>, hot_n array<int>"


def _often(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that ``LOCAL`` of the sets hold and how many do, an eighth of the shingles at a time."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in range(8):
        some = [s[(s & np.uint64(7)) == np.uint64(part)] for s in sets]
        k, n = np.unique(np.concatenate(some), return_counts=True)
        keys.append(k[n >= LOCAL])
        counts.append(n[n >= LOCAL])
    return np.concatenate(keys), np.concatenate(counts)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim()
    for batch in batches:
        seen: set = set()
        kept: list[np.ndarray] = []  # of the batch, for the frequent ones among them
        done = 0
        for part in slices(batch, 2):
            done += part.num_rows
            sizes, classes, arrays = [], [], []
            for s in sets_of(blobs(part.column(2))):
                c = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None
                first = c is not None and c not in seen
                seen.add(c)
                sizes.append(len(s))
                classes.append(c)
                arrays.append(pack48(s) if first else None)
                if first:
                    kept.append(s >> np.uint64(16))
            hot: list = [None] * len(sizes)
            hot_n: list = [None] * len(sizes)
            if done == batch.num_rows and kept:
                keys, counts = _often(kept)
                hot[0], hot_n[0] = keys.astype(np.int64), counts.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(1), pa.array(sizes, pa.int32()), pa.array(classes, pa.int64()), pa.array(arrays, pa.binary()),
                    pa.array(hot, pa.list_(pa.int64())), pa.array(hot_n, pa.list_(pa.int32())),
                ],
                [x.split()[0] for x in SETS.split(", ")],
            )


def _entry_rows(frequent, percent: int):
    """Prefix shingles of the classes: token, salt (0, or by class where the shingle is frequent), n, cls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        hot = frequent.value
        for batch in batches:
            for part in slices(batch, 2):
                n, cls, raw = part.column(0).to_numpy().astype(np.int64), part.column(1).to_numpy(), part.column(2).to_pylist()
                held = np.array([len(x) // 6 for x in raw], np.int64)
                keys, of = unpack48(b"".join(raw)), np.repeat(np.arange(len(raw)), held)
                late = np.zeros(len(keys), bool)
                if len(hot):
                    late = hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys
                # ranks within a class: by hash, frequent shingles after the others
                begin = (np.cumsum(held) - held)[of]
                before = np.cumsum(late) - late  # frequent ones before, over all
                lates = before - before[begin]
                rare = held - np.bincount(of[late], minlength=len(held))
                rank = np.where(late, rare[of] + lates, np.arange(len(keys)) - begin - lates)
                some = np.flatnonzero(rank < (n - -(-percent * n // 100) + 1)[of])
                of = of[some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[some].view(np.int64)), pa.array(np.where(late[some], 1 + cls[of] % SALTS, 0).astype(np.int8)), pa.array(n[of].astype(np.int32)), pa.array(cls[of])], ["token", "salt", "n", "cls"]
                )

    return run


PAIR = "a long, an int, b long, bn int"


def _bound_rows(percent: int):
    """Pairs whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for batch in batches:
            a, an, b, bn, x, y = (batch.column(i).to_pylist() for i in range(6))
            keep = []
            for k in range(len(a)):
                p, q = np.frombuffer(x[k], np.uint64), np.frombuffer(y[k], np.uint64)
                w = min(len(p), len(q))
                keep.append(bool(overlap_bound(fold(p, w), fold(q, w), an[k], bn[k]) >= need(an[k], bn[k], percent)))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    return run


def overlaps(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """How many elements each two packed arrays have in common, many pairs at a time."""
    out = np.zeros(len(x), np.int64)
    held = [np.array([len(k) // 6 for k in side], np.int64) for side in (x, y)]
    for s, e in spans(held[0] + held[1] + (HELD_KEYS >> 16), HELD_KEYS):
        # the pair's number is in the upper 16 bits
        both = [unpack48(b"".join(side[s:e])) | (np.repeat(np.arange(e - s, dtype=np.uint64), n[s:e]) << np.uint64(48)) for side, n in zip((x, y), held, strict=True)]
        keys = np.sort(np.concatenate(both))
        out[s:e] = np.bincount((keys[1:][keys[1:] == keys[:-1]] >> np.uint64(48)).astype(np.int64), minlength=e - s)
    return out


def _exact_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for batch in batches:
            an, bn, x, y = (batch.column(i).to_pylist() for i in (1, 3, 4, 5))
            common = overlaps(x, y)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(100 * common >= percent * (np.array(an, np.int64) + np.array(bn, np.int64) - common)))

    return run


class ClassFilter:
    """Bits of bounded number that stand for a set of classes: no false no, few false yes."""

    def __init__(self, shared, bits: int):
        self.shared, self.bits = shared, bits

    def value(self, cls: np.ndarray) -> np.ndarray:
        at = (mix64(cls.view(np.uint64)) & np.uint64(self.bits - 1)).astype(np.int64)
        return (self.shared.value[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)


def class_filter(ids: DataFrame, each: int = 16) -> ClassFilter:
    """A filter for the column ``cls``; the bits number ``each`` a class, up to 16 MB in all."""
    ids = ids.distinct()
    n = ids.count()
    bits = min(1 << 27, max(1 << 12, 1 << (each * max(n, 1)).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(mix64(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
            word, begin = np.unique(at >> 5, return_index=True)
            value = np.bitwise_or.reduceat(np.left_shift(1, at & 31), begin) if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(value)], ["word", "value"])

    found = ids.mapInArrow(slots, "word int, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()  # a row a word, at most
    table = np.zeros(bits // 32, np.uint32)
    table[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint32)
    return ClassFilter(ids.sparkSession.sparkContext.broadcast(table), bits)


def spans(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of rows that weigh at most so much together, but for rows that do so alone."""
    total = np.cumsum(weights)
    at = 0
    while at < len(total):
        to = max(at + 1, int(np.searchsorted(total, most + (total[at - 1] if at else 0), "right")))
        yield at, to
        at = to


def bitmaps(raw: list[bytes], wide: bool) -> list[bytes]:
    """``bitmap`` of each packed array, many at a time."""
    held = np.array([len(x) // 6 for x in raw], np.int64)
    bits = 64 << np.clip(np.frexp(np.maximum(held, 1) - 1.0)[1].astype(np.int64) - (3 if wide else 6), 4, 11 if wide else 10)
    out = []
    for s, e in spans(held + bits // 16, HELD_KEYS):
        to = np.cumsum(bits[s:e])
        keys = unpack48(b"".join(raw[s:e]))
        at = (keys >> np.uint64(6)).astype(np.int64) & np.repeat(bits[s:e] - 1, held[s:e])
        found = np.zeros(int(to[-1]), bool)
        found[at + np.repeat(to - bits[s:e], held[s:e])] = True
        packed, ends = np.packbits(found, bitorder="little").tobytes(), (to // 8).tolist()
        out += [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return out


def _bitmap_rows(wide: bool) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array(bitmaps(batch.column(1).to_pylist(), wide), pa.binary())], ["cls", "bits"])


def _maps(classes: DataFrame, held: DataFrame, wide: bool) -> DataFrame:
    return materialize(_needed(classes.select("cls"), held, _bitmap_rows(wide), "cls long, bits binary"), "bitmaps")


def _needed(classes: DataFrame, sets: DataFrame, shape: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda batch: batch, schema: str = "cls long, arr binary") -> DataFrame:
    """The arrays of these classes (cls), and of a few more, or what ``shape`` makes of them."""
    wanted = class_filter(classes, 64)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield shape(batch.filter(pa.array(wanted.value(batch.column(0).to_numpy()))))

    return sets.where(F.col("arr").isNotNull()).select("cls", "arr").mapInArrow(keep, schema).dropDuplicates(["cls"])


def _merged(table: DataFrame, key: str, value: str) -> DataFrame:
    """Bitmaps or arrays by class, under these names; they grow with the corpus, so they are merged and not broadcast, at any size."""
    return table.toDF(key, value).hint("merge")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs that link, as a written table (a, b)."""
    pairs = materialize(pairs, f"{name}-candidates")
    n = pairs.count()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    arrays = _needed(ends, sets)  # dealt by class once, for both joins
    both = pairs.join(_merged(arrays, "a", "x"), "a").join(_merged(arrays, "b", "y"), "b")
    linked = both.select("a", "an", "b", "bn", "x", "y").mapInArrow(_exact_rows(percent), PAIR)
    with batch_rows(pairs.sparkSession, PAIR_ROWS):
        out = materialize(linked.select("a", "b"), name, rows=PAIR_WEIGHT * n)
    del ends, arrays, both, linked  # else their shuffles stay
    drop(pairs)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that edges (a, b) reach; nodes with an edge only.

    Each round every node takes the smallest of its neighbours' roots, and roots follow theirs; rounds grow with the
    logarithm of the longest path.  Every round is a written table.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    n = 2 * edges.count()
    links = materialize(both, "links", rows=n)
    roots = materialize(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots", rows=n)
    last = roots
    while True:
        near = links.join(roots.select(F.col("node").alias("b"), F.col("root").alias("of_b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("of_b").alias("near"))
        seen = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        # the old root hears of the new one, too, so trees merge at their roots
        told = seen.where("new < root").groupBy(F.col("root").alias("node")).agg(F.min("new").alias("told"))
        best = seen.join(told, "node", "left").select("node", "root", F.least("new", F.coalesce("told", "new")).alias("new"))
        jump = best.select(F.col("node").alias("new"), F.col("new").alias("further"))
        after = best.join(jump, "new", "left").select("node", "root", F.least("new", F.coalesce("further", "new")).alias("new"))
        after = materialize(after, "round", rows=n)
        changed = after.where("new <> root").limit(1).count()
        roots = after.select("node", F.col("new").alias("root"))
        drop(*([last] if changed else [last, links]), sweeps=not changed)
        last = after
        if not changed:
            return roots


def joined(roots: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, root) of the graph that has these roots, with more edges (a, b), written: rounds are of the roots that the edges join alone."""
    if roots is None:
        return components(edges)
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"of_{x}"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    ends = materialize(ends.where("a <> b"), "ends", rows=edges.count())
    top = components(ends)
    drop(ends, sweeps=False)
    below = roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return materialize(below.union(top.join(roots, "node", "left_anti").select("node", "root")), "joined", rows=roots.count() + top.count())


#: Tiles up to this size have their pairs listed at once; pairs held before their bounds are taken.
SMALL = 64
HELD_PAIRS = 400_000
#: Words of bitmaps that are held against each other at a time.
HELD_WORDS = 1 << 19


class _Bitmaps:
    """The bitmaps of a batch, folded to the width that a pair has in common."""

    def __init__(self, raw: list[bytes], percent: int):
        self.raw = raw
        #: Sets of a pair have widths that differ by so many times at most.
        self.ratio = 1 << math.ceil(math.log2(100 / percent))
        self.width = np.array([len(x) // 8 for x in raw])
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        if w not in self.folded:
            rows = np.flatnonzero((self.width >= w) & (self.width <= w * self.ratio))
            place = np.zeros(len(self.raw), np.int64)
            place[rows] = np.arange(len(rows))
            out = np.zeros((len(rows), w), np.uint64)
            for wide in np.unique(self.width[rows]):
                some = rows[self.width[rows] == wide]
                out[place[some]] = fold(np.frombuffer(b"".join([self.raw[k] for k in some]), np.uint64).reshape(-1, wide), w)
            self.folded[w] = place, out
        return self.folded[w]

    def slack(self, p: np.ndarray, q: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
        """By how much the bound on the overlap is above what a link needs; negative where it isn't."""
        out = np.zeros(len(p), np.int64)
        width = np.minimum(self.width[p], self.width[q])
        for w in np.unique(width):
            some = np.flatnonzero(width == w)
            place, bits = self.at(int(w))
            a, b = p[some], q[some]
            step = max(64, HELD_WORDS // int(w))
            for s in range(0, len(some), step):
                x, y = a[s : s + step], b[s : s + step]
                out[some[s : s + step]] = overlap_bound(bits[place[x]], bits[place[y]], n[x], n[y]) - need(n[x], n[y], percent)
        return out


def forest(a: np.ndarray, b: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """The places of the pairs that join what those of greater worth have not."""
    over: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := over.get(x, x)) != x:
            over[x] = x = over.get(y, y)
        return x

    keep = []
    order = np.argsort(-worth, kind="stable")
    for k, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            over[x] = y
            keep.append(k)
    return np.array(keep, np.int64)


def _cell_rows(percent: int, first: bool):
    """Pairs of different components within a cell that pass size and bitmap bound; rows come sorted by cell.

    In the ``first`` round a forest of them, and as rows without b the (token, a) that have any.
    """
    small = {m: np.triu_indices(m, 1) for m in range(2, SMALL + 1)}

    def allowed(rows: pa.Table, begins: list[int]) -> Iterator[pa.RecordBatch]:
        cls, n, root, block, i, j, token = (rows.column(x).to_numpy() for x in ("cls", "n", "root", "block", "i", "j", "token"))
        n = n.astype(np.int64)
        maps = _Bitmaps(rows.column("bits").to_pylist(), percent)
        held_p: list[np.ndarray] = []
        held_q: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            p, q = np.concatenate(held_p), np.concatenate(held_q)
            fits = (root[p] != root[q]) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q]))
            p, q = p[fits], q[fits]
            slack = maps.slack(p, q, n, percent)
            ok = np.flatnonzero(slack >= 0)
            p, q, slack = p[ok], q[ok], slack[ok]
            some = np.unique(np.concatenate([p, q])) if first else np.zeros(0, np.int64)
            if first:
                best = forest(root[p], root[q], slack / n[p])
                p, q = p[best], q[best]
            swap = cls[p] > cls[q]
            p, q = np.where(swap, q, p), np.where(swap, p, q)
            none = pa.nulls(len(some), pa.int64())
            ends = [pa.array(cls[p]), pa.array(n[p].astype(np.int32)), pa.array(cls[q]), pa.array(n[q].astype(np.int32)), pa.nulls(len(p), pa.int64())]
            rows_ = [pa.array(cls[some]), pa.array(n[some].astype(np.int32)), none, none.cast(pa.int32()), pa.array(token[some])]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(ends, rows_, strict=True)], ["a", "an", "b", "bn", "token"])

        for s, e in zip(begins, begins[1:], strict=False):
            if e - s < 2:
                continue
            if e - s <= SMALL and i[s] == j[s]:
                p, q = small[e - s]
                held_p.append(s + p)
                held_q.append(s + q)
                held += len(p)
            else:
                left = s + np.flatnonzero(block[s:e] == i[s])
                right = left if i[s] == j[s] else s + np.flatnonzero(block[s:e] == j[s])
                right = right[np.argsort(n[right], kind="stable")]
                sizes = n[right]
                for k in left:
                    lo, hi = np.searchsorted(sizes, -(-percent * n[k] // 100)), np.searchsorted(sizes, 100 * n[k] // percent, "right")
                    some = right[lo:hi]
                    some = some[(root[some] != root[k]) & ((i[s] != j[s]) | (cls[some] > cls[k]))]
                    held_p.append(np.full(len(some), k))
                    held_q.append(some)
                    held += len(some)
                    if held > HELD_PAIRS:
                        yield flush()
                        held_p, held_q, held = [], [], 0
            if held > HELD_PAIRS:
                yield flush()
                held_p, held_q, held = [], [], 0
        if held:
            yield flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            key = [held.column(x).to_numpy() for x in ("token", "i", "j")]
            begins = [0, *(np.flatnonzero(np.any([np.diff(k) != 0 for k in key], axis=0)) + 1).tolist()]
            if len(begins) > 1:
                yield from allowed(held.slice(0, begins[-1]), begins)
                held = held.slice(begins[-1])
        if held is not None and held.num_rows:
            yield from allowed(held, [0, held.num_rows])

    return run


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def distinct_tiles(tiles: DataFrame) -> DataFrame:
    """(token, n, cls, of, home) of the tiles of several classes, one tile of all that have the same; rows (token, n, cls) are distinct.

    ``home`` is a tile's smallest class: tiles that share classes often share it.
    """
    some = [F.try_sum(F.shiftright(F.xxhash64(F.lit(seed), "cls"), 24)) for seed in (1, 2)]  # null where 2**23 rows overflow
    sums = tiles.groupBy("token").agg(F.count("*").alias("of"), F.min("cls").alias("home"), *(F.coalesce(x, F.col("token")).alias(f"sum{k}") for k, x in enumerate(some)))
    one = sums.where("of > 1").groupBy("of", "sum0", "sum1").agg(F.min("token").alias("token"), F.min("home").alias("home"))
    one = materialize(one.select("token", "of", "home"), "distinct", rows=tiles.count())
    # most tiles have the same classes as another, and their rows needn't be dealt
    wanted = class_filter(one.select(F.col("token").alias("cls")), 64)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.value(batch.column(0).to_numpy())))

    return tiles.select("token", "n", "cls").mapInArrow(keep, "token long, n int, cls long").join(one, "token").select("token", "n", "cls", "of", "home")


def _cells(mixed: DataFrame, maps: DataFrame) -> DataFrame:
    """The rows of mixed tiles by cell (token, i, j).

    Blocks below ``rest`` hold classes outside the largest component of a tile of more than BLOCK, the others that
    component; a cell has a block of the former on one side.  Tiles of one cell are dealt by home, to so many more places
    as they have SMALL rows: a class stands in several of them, and its bitmap, side by side in what one task gets, is
    stored once.
    """
    large = mixed.where(F.col("of") > BLOCK).groupBy("token", "root").agg(F.count("*").alias("held"))
    main = large.groupBy("token").agg(F.max(F.struct("held", "root")).alias("main")).select("token", F.col("main.held").alias("held"), F.col("main.root").alias("largest"))
    of = mixed.join(main, "token", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    blocks = [F.ceil(x / float(BLOCK)).cast("int") for x in (F.col("of") - F.col("held"), F.col("held"))]
    of = of.withColumns({"rest": blocks[0], "upper": blocks[1], "inside": F.coalesce(F.col("root") == F.col("largest"), F.lit(False))})
    block = F.when(F.col("inside"), F.col("rest") + F.pmod(F.hash("cls"), F.greatest("upper", F.lit(1)))).otherwise(F.pmod(F.hash("cls"), F.greatest("rest", F.lit(1))))
    others = F.sequence(F.lit(0), F.when(F.col("inside"), F.col("rest")).otherwise(F.col("rest") + F.col("upper")) - 1)
    dealt = of.withColumn("block", block.cast("int")).withColumn("other", F.explode(others)).join(_merged(maps, "cls", "bits"), "cls")
    i, j = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    part = F.pmod(F.xxhash64("token"), F.ceil(F.col("of") / float(SMALL)))
    place = F.when(F.col("of") <= BLOCK, F.xxhash64("home", part)).otherwise(F.xxhash64("token", i, j)).alias("place")
    cells = dealt.select("token", i, j, "block", "n", "cls", "root", "bits", place)
    return cells.repartition("place").drop("place").sortWithinPartitions("token", "i", "j")


def link(tiles: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the classes that links join.

    ``tiles``: written distinct rows (token, n, cls), the classes that share a token, dropped here; ``held``: (cls, arr), classes repeated or not.
    """
    given = tiles
    tiles = materialize(distinct_tiles(given).withColumn("root", F.col("cls")), "tiles", rows=given.count())
    drop(given)
    maps = _maps(tiles, held, wide=False)
    sweep(tiles.sparkSession)

    open_, roots = tiles, None
    large = tiles.where(F.col("of") > LEAD)
    if not large.isEmpty():  # leaders of every large tile and band of sizes
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int").alias("band")
        lead = large.groupBy("token", band).agg(F.min(F.struct("n", "cls")).alias("lead"))
        led = large.select("token", band, "n", "cls").join(lead, ["token", "band"]).where(F.col("lead.cls") != F.col("cls"))
        swap = F.col("lead.cls") < F.col("cls")
        star = led.select(
            F.least("lead.cls", "cls").alias("a"), F.when(swap, F.col("lead.n")).otherwise(F.col("n")).alias("an"),
            F.greatest("lead.cls", "cls").alias("b"), F.when(swap, F.col("n")).otherwise(F.col("lead.n")).alias("bn"),
        )
        star = star.where(F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent).distinct()
        mapped = star.join(_merged(maps, "a", "x"), "a").join(_merged(maps, "b", "y"), "b")
        roots = components(_verify(mapped.select("a", "an", "b", "bn", "x", "y").mapInArrow(_bound_rows(percent), PAIR), held, percent, "leaders"))
        open_ = _still_open(tiles, roots, tiles.count())
        drop(tiles)
    found = materialize(_cells(open_, maps).mapInArrow(_cell_rows(percent, True), PAIR + ", token long"), "forest")
    drop(maps)
    roots = joined(roots, _verify(found.where("b is not null").drop("token").distinct(), held, percent, "trees"))
    named_ = found.where("b is null").select("token", F.col("a").alias("cls")).distinct()
    # fewer classes stand in each tile now, and more tiles have the same
    again = materialize(open_.select("token", "n", "cls").join(named_, ["token", "cls"], "left_semi"), "named", rows=found.count())
    left = _still_open(distinct_tiles(again).withColumn("root", F.col("cls")), roots, again.count())
    drop(open_, found, again)
    maps = _maps(left, held, wide=True)
    more = _cells(left, maps).mapInArrow(_cell_rows(percent, False), PAIR + ", token long").drop("token").distinct()
    linked = _verify(more, held, percent, "cells")
    drop(left, maps)
    return joined(roots, linked)


def _still_open(tiles: DataFrame, roots: DataFrame, rows: int) -> DataFrame:
    """The tiles (token, n, cls, of, root), of at most ``rows`` rows, of several components, with these roots."""
    now = tiles.drop("root").join(roots.select(F.col("node").alias("cls"), F.col("root").alias("of_cls")), "cls", "left")
    placed = materialize(now.withColumn("root", F.coalesce("of_cls", "cls")).drop("of_cls"), "placed", rows=rows)
    mixed = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    out = materialize(placed.join(mixed, "token", "left_semi"), "open", rows=rows)
    drop(placed)
    return out


def join(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rk (a hash of id and text), n_shingles, component_id, root; a row for each row of ``docs``.

    ``root`` tells components apart, which names don't: null ids and ids that stand twice can name several.
    """
    spark = docs.sparkSession
    wide = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("rk"), F.col(text_col).cast("string").alias("text"))
    sets = materialize(wide.mapInArrow(_set_rows, SETS), "sets")

    often = sets.where(F.col("hot").isNotNull()).select(F.explode(F.arrays_zip("hot", "hot_n")).alias("x")).groupBy(F.col("x.hot").alias("token")).agg(F.sum("x.hot_n").alias("n"))
    often = materialize(often.where(F.col("n") >= 32), "often")
    # the smallest power of two that at most FREQUENT shingles reach
    steps = {r.step: r.n for r in often.groupBy(F.floor(F.log2("n")).alias("step")).agg(F.count("*").alias("n")).collect()}  # a row a power of two
    least = next(k for k in range(5, 65) if sum(n for step, n in steps.items() if step >= k) <= FREQUENT)
    hot = often.where(F.floor(F.log2("n")) >= least).select("token").toArrow().column(0).to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(hot.astype(np.uint64)))

    held = sets.where(F.col("arr").isNotNull())
    entries = held.select("n", "cls", "arr").mapInArrow(_entry_rows(frequent, percent), "token long, salt byte, n int, cls long")
    # a frequent shingle's rows are dealt by class, too, and counted by the tiles' sums
    by_token = Window.partitionBy("token", "salt")
    # sorted by class, repeated entries of a class are side by side
    marked = entries.withColumn("before", F.lag("cls").over(by_token.orderBy("cls"))).where(F.col("before").isNull() | (F.col("before") != F.col("cls")))
    shared = marked.withColumn("of", F.count("*").over(by_token)).where((F.col("of") > 1) | (F.col("salt") > 0))
    shared = materialize(shared.select("token", "n", "cls"), "shared")
    drop(often)

    roots = link(shared, held, percent)

    n = sets.count()
    named_ = sets.select("doc_id", "rk", "n", "cls").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named_ = materialize(named_.select("doc_id", "rk", "n", "root"), "named", rows=n)
    drop(sets)
    # written, so that a large component is split between the tasks of the join
    names = materialize(named_.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("name")), "names", rows=n)
    out = named_.join(names, "root", "left")
    return out.select("doc_id", "rk", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("component_id"), "root")


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component stays, the one with the smallest id; documents without a word all stay."""
    found = join(docs, percent, id_col, text_col).select("doc_id", "rk", "n_shingles", "root")
    linked = found.where(F.col("n_shingles") > 0)
    key, rk, one, copy = fresh(docs, "key", "rk", "one", "copy")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("rk").alias("k"))).alias("x")
    keep = linked.groupBy("root").agg(least).select(F.coalesce("x.id", F.lit(-1)).alias(key), F.col("x.k").alias(rk), F.lit(True).alias(one))
    empty = found.where(F.col("n_shingles") == 0).select(F.coalesce("doc_id", F.lit(-1)).alias(key), F.col("rk").alias(rk), F.lit(False).alias(one)).distinct()
    rows = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), rk: row_key(id_col, text_col)})
    both = rows.join(keep.union(empty), [key, rk])
    same = Window.partitionBy(key, rk).orderBy(one)
    return both.withColumn(copy, F.row_number().over(same)).where(~F.col(one) | (F.col(copy) == 1)).select(*named(docs.columns))
