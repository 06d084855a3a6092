"""Parts of the Jaccard join: the same components with and without leaders, forests, tiles told apart by their classes, words in arrays."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagwise.llm import jaccard, words
from lagwise.llm.common import LOWER, fresh

from test_pairs_and_lines import brute_components


@pytest.mark.parametrize("lead", [4, 1 << 30])
def test_leaders_change_nothing(spark, monkeypatch, lead):
    """Groups of near copies near the threshold, texts that share passages, chains."""
    rng = np.random.default_rng(12)
    word = [f"v{i}" for i in range(3000)]
    rows = []
    for g in range(4):
        base = [word[k] for k in rng.integers(0, 3000, 70)]
        for k in range(25):
            copy = list(base)
            for at in rng.choice(70, int(rng.integers(0, 4)), replace=False):
                copy[at] = f"x{g}-{k}-{at}"
            rows.append((100 * g + k, " ".join(copy)))
    monkeypatch.setattr(jaccard, "LEAD", lead)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "SMALL", 4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == brute_components(rows)


def test_forest():
    a, b = np.array([1, 2, 1, 4, 5]), np.array([2, 3, 3, 5, 6])
    kept = jaccard.forest(a, b, np.array([0.1, 0.9, 0.5, 0.3, 0.2]))
    assert sorted(kept.tolist()) == [1, 2, 3, 4]
    assert len(jaccard.forest(a[:0], b[:0], np.zeros(0))) == 0


def test_distinct_tiles(spark):
    rows = [(t, 10, c) for t, cs in {1: [5, 6], 2: [5, 6], 3: [5, 6, 7], 4: [7], 5: [6, 7], 6: [5, 6, 7]}.items() for c in cs]
    got = jaccard.distinct_tiles(spark.createDataFrame(rows, "token long, n int, cls long")).collect()
    tiles = {}
    for r in got:
        tiles.setdefault(r.token, []).append(r.cls)
        assert r.of == {1: 2, 3: 3, 5: 2}[r.token]
    assert {k: sorted(v) for k, v in tiles.items()} == {1: [5, 6], 3: [5, 6, 7], 5: [6, 7]}


def test_slack_is_the_bound(spark):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 48, int(n), dtype=np.uint64)) for n in rng.integers(5, 3000, 40)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.95)], rng.integers(0, 1 << 48, len(s) // 20, dtype=np.uint64)])) for s in sets]
    n = np.array([len(s) for s in sets])
    for wide in (False, True):
        maps = jaccard._Bitmaps([jaccard.bitmap(s, wide) for s in sets], 80)
        p, q = (x.astype(np.int64) for x in np.triu_indices(len(sets), 1))
        fits = 100 * np.minimum(n[p], n[q]) >= 80 * np.maximum(n[p], n[q])
        p, q = p[fits], q[fits]
        slack = maps.slack(p, q, n, 80)
        for k in range(len(p)):
            common = len(np.intersect1d(sets[p[k]], sets[q[k]]))
            assert slack[k] >= common - jaccard.need(n[p[k]], n[q[k]], 80)


def test_words_equal_split(monkeypatch):
    """Texts cut anywhere, words longer than a buffer, all kinds of white space."""
    texts = [b"One two\tTHREE\x0bfour", None, b"", b" \n ", "Ünï çödé 漢字".encode(), b"a" * 100, b"x y " * 40, b"one TWO three four", b"\x1cfield"]
    flat = [w for t in texts for w in (t or b"").translate(LOWER).split()]
    want = words.Texts(texts)
    for size in (16, 31, 1 << 18):
        monkeypatch.setattr(words, "CHUNK", size)
        monkeypatch.setattr(words, "_powers", None)
        got = words.Texts(texts, lines=True)
        assert got.counts.tolist() == [len((t or b"").split()) for t in texts]
        assert np.bincount(got.line, minlength=0).sum() == len(flat)
        seen = {}
        for w, h in zip(flat, got.hashes.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)
    assert want.counts.tolist() == got.counts.tolist()
    assert words.Texts([b"A a"], fold=False).hashes.tolist() != words.Texts([b"a a"], fold=False).hashes.tolist()


def test_fresh_names(spark):
    df = spark.range(1).select(F.lit(1).alias("Key"), F.lit(1).alias("key_"), F.lit(1).alias("other"))
    assert fresh(df, "key", "rk", "rk") == ["key__", "rk", "rk_"]
