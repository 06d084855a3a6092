"""Byte-level BPE through the tokenizers library, pieces cached.

The library's pre-tokenizer never lets a token reach from a character that is no
white space over a space after it, and takes at most one space in front of a
word.  Where no piece between two spaces is empty or has white space at its
ends, the ids of a text are therefore the joined ids of its pieces, each with
its space.  Pieces recur, so every worker keeps their ids.  New pieces are
encoded by the library as one text, whose ids are dealt to the pieces by their
bytes: every id stands for a known number of bytes.  All other texts go to the
library whole.
"""

from __future__ import annotations

import os

import numpy as np

from .common import cached, claim, give_back

#: Pieces kept by a worker, and the longest piece that is kept; together they bound its memory.
MAX_PIECES = 1_200_000
MAX_PIECE_CHARS = 48
#: What one definition of white space or another counts besides str.isspace().
ODD = "᠎​⁠﻿"
#: Punctuation that ends words; none of it takes part in a contraction.
END = ".,!?;:"
#: Stands for the first piece of a text, which has no space before it; no piece holds a space.
HEAD = " "
#: The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 up, in order.
_PRINTABLE = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_encoders: dict[str, Encoder] = {}
cached("pieces", _encoders.clear)


def ragged(piece: str) -> bool:
    """Whether white space, by any definition, is all there is or at an end."""
    return not piece or piece[0].isspace() or piece[-1].isspace() or piece[0] in ODD or piece[-1] in ODD


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        pre = self.tokenizer.pre_tokenizer
        self.by_piece = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and self.tokenizer.normalizer is None
        self.vocab = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocab <= 1 << 16 else np.dtype("<u4")
        self.lengths = np.zeros(self.vocab, np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.lengths[k] = len(token)  # a character of a token stands for a byte
        #: The same merges over words that are split and mapped to characters already.
        self.words = Tokenizer(self.tokenizer.model)
        self.ends = dict(zip(END, self.whole(list(END)), strict=True))
        #: Ids of " " + piece; False where the piece is ragged.
        self.known: dict[str, bytes | bool] = {HEAD: b""}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> dict[str, bytes | bool]:
        out: dict[str, bytes | bool] = {}
        words = {p for p in pieces if p.isalpha()}  # one pre-token each
        ended: list[str] = []  # a word and one more character: never one token, so the word may be known
        rest: list[str] = []
        for p in pieces:
            if p in words:
                continue
            if p[-1:] in self.ends and p[:-1].isalpha():
                ended.append(p)
            elif ragged(p):
                out[p] = False
            else:
                rest.append(p)
        words.update([p[:-1] for p in ended if p[:-1] not in self.known])
        out.update(self._encode(list(words), self.words))
        out.update(self._encode(rest, self.tokenizer))
        for p in ended:
            stem = p[:-1]
            out[p] = (out.get(stem) or self.known[stem]) + self.ends[p[-1]]  # type: ignore[operator]
        return out

    def _encode(self, pieces: list[str], tokenizer) -> dict[str, bytes]:
        """Ids of " " + piece for pieces that aren't ragged."""
        out: dict[str, bytes] = {}
        for at in range(0, len(pieces), 5000):
            some = pieces[at : at + 5000]
            text = "".join([" " + p for p in some])
            if tokenizer is self.words:
                split = text.encode().decode("latin-1").translate(BYTE_CHARS).split(BYTE_CHARS[0x20])
                found = tokenizer.encode_batch_fast([[BYTE_CHARS[0x20] + x for x in split[1:]]], is_pretokenized=True, add_special_tokens=False)
            else:
                found = tokenizer.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(found[0].ids, self.dtype)
            bounds = np.cumsum([1 + (len(p) if p.isascii() else len(p.encode())) for p in some])
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), bounds) + 1
            raw, size, begin = ids.tobytes(), self.dtype.itemsize, 0
            for p, end in zip(some, (ends * size).tolist(), strict=True):
                out[p] = raw[begin:end]
                begin = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of ``dtype``."""
        if not self.by_piece:
            return self.whole(texts)
        get, split = self.known.get, []
        heads: list[str] = []
        missing: set[str] = set()
        for text in texts:
            pieces = text.split(" ")
            heads.append(pieces[0])
            pieces[0] = HEAD
            ids = list(map(get, pieces))
            new = [i for i, x in enumerate(ids) if x is None]
            missing.update([pieces[i] for i in new])
            split.append((pieces, ids, new))
        learnt = self._learn(missing)
        out: list[bytes] = []
        for text, head, first, (pieces, ids, new) in zip(texts, heads, self.whole(heads), split, strict=True):
            for i in new:
                ids[i] = learnt[pieces[i]]
            try:
                if ragged(head) and text:
                    raise TypeError
                out.append(first + b"".join(ids))
            except TypeError:  # white space that isn't a lone space between words
                out.append(self.whole([text])[0])
        if len(self.known) + len(learnt) > MAX_PIECES:
            self.known.clear()
            self.known[HEAD] = b""
        self.known.update(learnt)
        for p in [p for p in learnt if len(p) > MAX_PIECE_CHARS]:
            del self.known[p]
        return out


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    claim("pieces")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        give_back()  # what reading the vocabulary took
    return _encoders[path]
