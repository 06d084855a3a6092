"""Language identification as inference of a mixture.

Training: smoothed frequencies of byte trigrams for every language, from a sample
of the labelled rows that the caller allows for training.  The sample is chosen by
a hash of the id and holds about ``SAMPLE_ROWS`` rows of a language at most; this
bound is the documented parameter.  Trigrams are counted on executors and hashed to
``BUCKETS``, so the table that goes to all tasks has ``BUCKETS`` floats a language.

Prediction: a document is a mixture of languages, its words the draws.  Expectation
maximisation over the words' likelihoods gives the proportions.  Sets of languages are
compared by likelihood less a penalty for each further language: from all languages the
one with the smallest share goes, again and again, and the best set on the way stays.  No
set can have a larger likelihood than that of all languages, so sizes whose penalty
alone puts them below the best so far are passed over.  The language with the largest
share is the prediction, its share the score.  Each text is read whole, ``CHUNK`` characters
at a time, its words held once each, and nothing is shuffled.

Defined cases: null text or text without a letter is ``und`` with score 0, as is all
text where nothing was learnt; rows with a null id count as crc32('') and belong to
the training side; repeated rows give equal rows; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

SAMPLE_ROWS = 3000
BUCKETS = 1 << 15
SMOOTH = 0.5
PENALTY = 3.0
EM_ROUNDS = 12
#: Characters of a text that are taken apart together.
CHUNK = 1 << 20
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = re.compile(r"\s")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of the words, each with a space at both ends, and the place where each word begins."""
    raw = np.frombuffer((" " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    begins = np.flatnonzero(raw[:-2] == 32)
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), begins


def chunks(text: str) -> Iterator[str]:
    """A text in parts cut at white space; a longer run without any is cut as it stands."""
    at = 0
    while at < len(text):
        to = at + CHUNK
        if to < len(text):
            space = _SPACE.search(text, to, to + CHUNK)
            to = space.start() if space else to + CHUNK
        yield text[at:to]
        at = to


def em(like: np.ndarray, weight: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of a mixture of the rows of ``like``, the log-likelihoods by component and kind of draw; kinds are drawn ``weight`` times."""
    top = like.max(axis=0)
    p = np.exp(like - top)
    share = np.full(len(like), 1 / len(like))
    if len(like) > 1:
        part = weight / weight.sum()
        for _ in range(rounds):
            joint = share[:, None] * p
            new = joint @ (part / joint.sum(axis=0))
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
    return share, float((np.log(share @ p) + top) @ weight)


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        if langs:
            smooth = counts + SMOOTH
            self.logs = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32))

    def likelihoods(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of the text's distinct words by language and word, and how often each word stands."""
        keys, like, counts = np.zeros(0, np.uint64), np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64)
        for part in chunks(text):
            codes, begins = grams(part)
            if not len(begins):
                continue
            words = np.add.reduceat(mix64(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (np.arange(len(codes)) - np.repeat(begins, np.diff(np.append(begins, len(codes))))).astype(np.uint64)), begins)
            k, at, n = np.unique(words, return_index=True, return_counts=True)
            ends = np.append(begins[1:], len(codes))[at]
            sizes = ends - begins[at]
            starts = np.cumsum(sizes) - sizes
            where = np.repeat(begins[at] - starts, sizes) + np.arange(int(sizes.sum()))
            found = np.add.reduceat(self.logs[codes[where]], starts, axis=0)
            if not len(keys):
                keys, like, counts = k, found, n
                continue
            keys, first, of = np.unique(np.concatenate([keys, k]), return_index=True, return_inverse=True)
            like, counts = np.concatenate([like, found])[first], np.bincount(of, np.concatenate([counts, n])).astype(np.int64)
        return like.T.astype(np.float64), counts

    def mixture(self, text: str | None) -> list[tuple[str, float]]:
        """The selected languages with their shares, the largest first."""
        if not self.langs or not text or not _LETTER.search(text):
            return []
        like, weight = self.likelihoods(text)
        if not len(weight):
            return []
        chosen, share = select(like, weight.astype(np.float64))
        return sorted(((self.langs[i], float(min(1.0, s))) for i, s in zip(chosen, share, strict=True)), key=lambda x: (-x[1], x[0]))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.mixture(text)
        return found[0] if found else ("und", 0.0)


def select(like: np.ndarray, weight: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The components of the best penalised set, and their shares."""
    alone = like @ weight
    single = int(np.argmax(alone))
    best, chosen, out = float(alone[single]), [single], np.array([1.0])
    penalty = PENALTY * np.log(weight.sum() + 1)
    left = np.arange(len(like))
    most = None
    while len(left) > 1:
        if most is not None and most - penalty <= best:
            break  # no set of two or more can be better
        share, value = em(like[left], weight)
        most = value if most is None else most
        if value - penalty * (len(left) - 1) > best:
            best, chosen, out = value - penalty * (len(left) - 1), left.tolist(), share
        left = np.delete(left, np.argmin(share))
    return chosen, out


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the rows of ``docs``; the caller leaves out what must not be learnt from."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), share.alias("at"))
    # a row for each language, less than the model that follows has for each
    sample = rows.join(F.broadcast(sizes), "lang").where(F.col("at") * F.col("n") < sample_rows).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                found[lang] += np.bincount(grams(text)[0], minlength=BUCKETS)
        for lang, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # BUCKETS rows a language at most
    langs = sorted(set(table.column("lang").to_pylist()), key=lambda x: x.encode())
    counts = np.zeros((len(langs), BUCKETS))
    if langs:
        place = {x: i for i, x in enumerate(langs)}
        counts[[place[x] for x in table.column("lang").to_pylist()], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and the selected set with its shares."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats a language
    schema = "doc_id long, held_out boolean, lang_pred string, score double, languages string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.mixture(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([f[0][0] if f else "und" for f in found], pa.string()),
                    pa.array([f[0][1] if f else 0.0 for f in found], pa.float64()),
                    pa.array([",".join(f"{x}:{s:.3f}" for x, s in f) for f in found], pa.string()),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "languages"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def language(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs.where(~held_out())))
