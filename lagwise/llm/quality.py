"""Quality rules: cross-document line frequency on top of rules for one document.

One pass over the texts gives each document the figures of the plain rules and the
64-bit hashes of its normalised lines (white space at the ends off, A-Z in lower
case, runs of digits as one 0), written as a slim table without text.  The hashes
are counted by host: how many distinct documents of the host hold a line.
Documents with the same set of lines count once for a line, so a document isn't
boilerplate because it was copied; the count is over sketches, a sketch being a hash
of all of a document's line hashes.  Documents that differ in any line count each:
pages of one template with a line or two of their own can't be told from near copies
by their lines.

A line is removed if its documents in the host are more than ``max_docs`` and more
than ``max_share`` of all of the host's distinct documents.  A document is rejected
if fewer than ``min_left`` of its words stay.  The plain rules reject short and
repetitive documents first.

A document for each (host, sketch) is picked first; its lines are counted by
(host, line), partly before the shuffle; lines above the limits are few by the limits themselves, and join the
documents' lines as a side whose size Spark knows.

Defined cases: a null text has no words and fails the plain rules; a null host is a
host; repeated rows are judged each and count as one document for the lines; an empty
table gives an empty table; other columns pass through ``keep_good`` untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, blobs, claim, fresh, materialize, mix64, named, slices
from .words import Texts

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOCS = 20
MAX_SHARE = 0.02
MIN_LEFT = 0.3
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(c for c in range(256) if c not in _SYMBOLS)
#: What doesn't begin a code point of a word.
_NOT_CHARS = SPACE + bytes(range(0x80, 0xC0))
_DIGITS = re.compile(rb"[0-9]+")
FEATURES = "doc_id long, host string, rk long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, sketch long, lines array<long>, line_words array<int>"


def repeat_words(words: np.ndarray, n: int = 3) -> int:
    """Words, given by hashes, that stand in windows of ``n`` words found at least twice."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    windows = np.zeros(m, np.uint64)
    for i in range(n):
        windows = mix64(windows + words[i : i + m])
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    begins = np.zeros(m + n, np.int64)
    found = np.flatnonzero(np.isin(windows, twice))
    begins[found] += 1
    begins[found + n] -= 1
    return int(np.count_nonzero(np.cumsum(begins)))


def features(texts: list[bytes | None]) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; a row for each text."""
    words = Texts(texts, fold=False)
    out = np.zeros((len(texts), 5), np.int64)
    out[:, 0] = words.counts
    for k, text in enumerate(texts):
        if not text:
            continue
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        out[k, 1:4] = len(text.translate(None, _NOT_CHARS)), len(text.translate(None, _NOT_SYMBOL)), len(lines) - len(set(lines))
        out[k, 4] = repeat_words(words.hashes[words.begins[k] : words.begins[k + 1]])
    return out


def line_hashes(text: bytes | None) -> tuple[list[int], list[int]]:
    """The distinct hashes of a text's normalised lines and the words under each."""
    found: dict[int, int] = {}
    for line in (text or b"").translate(LOWER).split(b"\n"):
        if words := len(line.split()):
            h = int.from_bytes(hashlib.md5(_DIGITS.sub(b"0", line.strip(SPACE))).digest()[:8], "big", signed=True)
            found[h] = found.get(h, 0) + words
    return list(found), list(found.values())


def line_set(hashes: list[int]) -> int | None:
    """A hash of a set of line hashes."""
    return int.from_bytes(hashlib.md5(np.sort(np.array(hashes, np.int64)).astype("<i8").tobytes()).digest()[:8], "big", signed=True) if hashes else None


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim()
    for batch in batches:
        for part in slices(batch, 3):
            texts = blobs(part.column(3))
            table = features(texts)
            hashes, counts = zip(*map(line_hashes, texts), strict=True)
            sketch = [line_set(h) for h in hashes]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], *(pa.array(np.ascontiguousarray(table[:, i])) for i in range(5)), pa.array(sketch, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))],
                [x.split()[0] for x in FEATURES.split(", ")],
            )


def host_key(host_col: str) -> Column:
    return F.when(F.col(host_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(host_col).cast("string")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, rk (a hash of host and text), the figures of the plain rules, base_failed, n_removed_words and kept; a row for each row of ``docs``."""
    text, host = F.col(text_col).cast("string"), host_key(host_col)
    wide = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.alias("host"), F.xxhash64(host, text).alias("rk"), text.alias("text"))
    slim = materialize(wide.mapInArrow(_feature_rows, FEATURES).withColumn("row", F.monotonically_increasing_id()), "quality")

    one = slim.where(F.col("sketch").isNotNull()).groupBy("host", "sketch").agg(F.min("row").alias("row"))
    by_line = slim.select("row", "host", "lines").join(one.select("row"), "row", "left_semi").select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    by_host = one.groupBy("host").agg(F.count("*").alias("of"))
    frequent = by_line.where(F.col("n") > max_docs).join(by_host, "host").where(F.col("n") > max_share * F.col("of")).select("host", "line")

    lines = slim.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    removed = lines.join(frequent, ["host", "line"], "left_semi").groupBy("row").agg(F.sum("words").cast("long").alias("n_removed_words"))
    out = slim.drop("lines", "line_words", "sketch", "host").join(removed, "row", "left").drop("row").fillna(0, ["n_removed_words"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words") >= min_left * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & left)


def quality(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns and repeated rows as they are.

    Rows with the same id, host and text have the same verdict, so a row is told by (id, hash of host and text).
    """
    verdict = judge(docs, id_col, text_col, host_col)
    key, rk = fresh(docs, "key", "rk")
    bad = verdict.where(~F.col("kept")).select(F.coalesce("doc_id", F.lit(-1)).alias(key), F.col("rk").alias(rk)).distinct()
    rows = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), rk: F.xxhash64(host_key(host_col), F.col(text_col).cast("string"))})
    return rows.join(bad, [key, rk], "left_anti").select(*named(docs.columns))
