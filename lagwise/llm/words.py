"""Hashes of all words of many texts at once, in arrays.

A word's hash is a polynomial over its bytes, each byte replaced by a random 64-bit
number, mixed at the end.  Prefix sums give the polynomials of all words of a buffer
together, so no word becomes a Python object.  Buffers are of bounded size and cut at
white space; a longer word is hashed on its own.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .common import LOWER, SPACE, mix64

#: Bytes hashed together.
CHUNK = 1 << 18
N = 5
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE)] = True
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if _powers is None:
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            p = np.ones(CHUNK + 1, np.uint64)
            p[1:] = np.uint64(b)
            out.append(np.multiply.accumulate(p))
        _powers = out[0], out[1]
    return _powers


def _chunk(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, hashes) of the words of a buffer of at most CHUNK bytes, none of them cut."""
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    begins, ends = edge[::2], edge[1::2]
    power, inverse = _power_tables()
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * power[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[begins]) * inverse[begins]
    return begins, mix64(h + (ends - begins).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


class Texts:
    """The words of texts in one row of arrays; A-Z count as a-z unless ``fold`` is off, words end at SPACE.

    ``hashes``: by word; ``begins``: the first word of each text, and the number of words at the end;
    ``line``: (if asked for) the number of the line that a word stands in, over all texts.
    """

    def __init__(self, texts: list[bytes | None], lines: bool = False, fold: bool = True):
        raw = b"\n".join([t or b"" for t in texts])
        raw = raw.translate(LOWER) if fold else raw
        buf = np.frombuffer(raw, np.uint8)
        begins, hashes = [], []
        at = 0
        while at < len(raw):
            to = at + CHUNK
            if to < len(raw):
                inside = np.flatnonzero(_SPACE[buf[at : to + 1]])
                if len(inside):
                    to = at + int(inside[-1])
                else:  # a word longer than a chunk
                    rest = np.flatnonzero(_SPACE[buf[to:]])
                    to = to + int(rest[0]) if len(rest) else len(raw)
                    begins.append(np.array([at]))
                    hashes.append(np.frombuffer(hashlib.blake2b(raw[at:to], digest_size=8).digest(), np.uint64))
                    at = to
                    continue
            b, h = _chunk(buf[at:to])
            begins.append(b + at)
            hashes.append(h)
            at = max(to, at + 1)
        where = np.concatenate(begins) if begins else np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        starts = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])[: len(texts)]
        self.begins = np.append(np.searchsorted(where, starts), len(where))
        self.counts = np.diff(self.begins)
        if lines:
            self.line = np.searchsorted(np.flatnonzero(buf == 10), where)

    def shingles(self) -> np.ndarray:
        """By word, the hash of the five words that begin there; meaningless for the last four words of a text."""
        n = len(self.hashes)
        out = np.full(n, np.uint64(N), np.uint64)
        for i in range(N):
            out[: n - i] += self.hashes[i:] * _MULTIPLIERS[i]
        return mix64(out)

    def short(self, k: int) -> np.uint64:
        """The hash of all the words of a text of fewer than five."""
        h = self.hashes[self.begins[k] : self.begins[k + 1]]
        return mix64(np.array([int((h * _MULTIPLIERS[: len(h)]).sum(dtype=np.uint64)) + len(h) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]


def sliding(choose: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """The smallest or largest of each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = choose(x[:-step], x[step:])
        done += step
    return x
