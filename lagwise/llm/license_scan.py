"""License scans: ordered signature rules over whole texts.

``rules.txt`` has the signatures, written by hand: label, priority, confidence, the
keyword that gates the rule, and a regex over the text's words (lower-case, letters
and digits only, one space between).  One automaton of all keywords goes over the
words; only rules whose keyword is there run their regex.  Detections are taken by
priority, then length; one that lies within the interval of a detection taken before
is suppressed, so "gnu general public license version 3" isn't reported as the bare
family, too.  Detections that overlap otherwise both stay.

Base phrases are reported in any case: suppression never takes their labels.

No shuffle; memory of one Arrow batch.  Defined cases: a null text is empty; without
detections the labels are empty strings, the places null, the score 0; repeated rows
give equal rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_LOWER, blobs

#: Phrase of words -> label: the base of the scan.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: re.Pattern[bytes]


@dataclass(frozen=True)
class Detection:
    """Words ``start`` to ``end`` (exclusive) match a rule."""

    label: str
    priority: int
    confidence: float
    start: int
    end: int


def parse_rules(text: str) -> list[Rule]:
    out = []
    for line in text.splitlines():
        if line.strip() and not line.startswith("#"):
            label, priority, confidence, keyword, pattern = line.split("|", 4)
            out.append(Rule(label, int(priority), float(confidence), keyword, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode())))
    return out


class Scanner:
    def __init__(self, rules: list[Rule]):
        import ahocorasick

        self.rules = rules
        self.keywords = ahocorasick.Automaton()
        by_keyword: dict[str, list[int]] = {}
        for k, rule in enumerate(rules):
            by_keyword.setdefault(rule.keyword, []).append(k)
        for word, which in by_keyword.items():
            self.keywords.add_word(word, which)
        if by_keyword:
            self.keywords.make_automaton()

    def gated(self, words: bytes) -> list[Rule]:
        """The rules whose keyword is among the words, in their order."""
        if not len(self.keywords):
            return []
        open_: set[int] = set()
        for _, which in self.keywords.iter(words.decode("latin-1")):
            open_.update(which)
        return [self.rules[k] for k in sorted(open_)]

    def detect(self, words: bytes) -> list[Detection]:
        """Detections that stay, by place; ``words`` are joined by single spaces."""
        found = []
        for rule in self.gated(words):
            at = counted = 0
            for m in rule.pattern.finditer(words):
                at += words.count(b" ", counted, m.start())
                counted = m.start()
                found.append(Detection(rule.label, rule.priority, rule.confidence, at, at + m[0].count(b" ") + 1))
        return suppress(found)


def suppress(found: list[Detection]) -> list[Detection]:
    """Detections not contained in one taken before them, by priority, then length, then place."""
    starts: list[int] = []  # of the largest intervals taken; their ends ascend with them
    ends: list[int] = []
    kept = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        k = bisect.bisect_right(starts, d.start) - 1
        if k >= 0 and ends[k] >= d.end:
            continue
        kept.append(d)
        lo = bisect.bisect_left(starts, d.start)
        hi = bisect.bisect_right(ends, d.end)
        starts[lo:hi], ends[lo:hi] = [d.start], [d.end]
    return sorted(kept, key=lambda d: (d.start, d.end, d.label))


@cache
def scanner() -> Scanner:
    return Scanner(parse_rules(Path(__file__).with_name("rules.txt").read_text()))


def word_line(text: bytes | None) -> tuple[bytes, int]:
    """The words of a text joined by spaces, and their number."""
    words = (text or b"").translate(ALNUM_LOWER).split(b" ")
    words = [w for w in words if w]
    return b" ".join(words), len(words)


def base_places(words: bytes) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase stands."""
    out = []
    for phrase, label in BASE.items():
        raw, at, counted = phrase.encode(), 0, 0
        k = words.find(raw)
        while k >= 0:
            if (k == 0 or words[k - 1] == 32) and (k + len(raw) == len(words) or words[k + len(raw)] == 32):
                at += words.count(b" ", counted, k)
                counted = k
                out.append((at, label))
            k = words.find(raw, k + 1)
    return sorted(out)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def scan_text(text: bytes | None, rules: Scanner) -> tuple:
    words, n = word_line(text)
    base = base_places(words)
    found = rules.detect(words)
    base_labels = sorted({x for _, x in base})
    labels = sorted({*base_labels, *(d.label for d in found)})
    score = max([0.5 if base else 0.0, *(d.confidence for d in found)])
    spans = ";".join(f"{d.label}@{d.start}-{d.end}" for d in found)
    return n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(base_labels), ",".join(labels), score, spans


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = scanner()
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string()]
    for batch in batches:
        rows = [scan_text(t, rules) for t in blobs(batch.column(1))]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base places, labels of all detections that stay and their spans, for every document."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_rows, SCHEMA)
