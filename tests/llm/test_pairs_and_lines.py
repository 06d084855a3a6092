import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from lagwise.llm import jaccard, line_dedup, quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                c = len(a & b)
                if 100 * c >= 80 * (len(a) + len(b) - c):
                    root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return Counter(out)


@pytest.mark.parametrize("which", ["edge", "small"])
def test_jaccard_components(request, which):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect())
    assert got == brute_components(rows)


def test_jaccard_large_tiles(spark, monkeypatch):
    """Cells of many blocks, frequent shingles last, chains of links: the same components."""
    rng = np.random.default_rng(3)
    words = [f"q{i}" for i in range(4000)]
    passage = [words[i] for i in rng.integers(0, 4000, 30)]
    rows = []
    for i in range(150):
        own = [words[k] for k in rng.integers(0, 4000, int(rng.integers(3, 60)))]
        rows.append((i, " ".join(own[:2] + passage + own[2:])))
    chain = [words[k] for k in rng.integers(0, 4000, 100)]
    for i in range(40):
        chain = list(chain)
        chain[(7 * i) % 100] = f"new{i}"
        rows.append((200 + i, " ".join(chain)))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "SMALL", 8)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_jaccard_empty_and_keep_one(empty, edge, edge_rows):
    assert jaccard.join(empty).count() == 0
    assert jaccard.keep_one(empty).count() == 0
    kept = jaccard.keep_one(edge)
    assert kept.columns == edge.columns
    rows = [(r[0], r[1]) for r in edge_rows]
    brute = brute_components(rows)
    wanted = len({c for (d, n, c), _ in brute.items() if n and c is not None}) + sum(k for (d, n, c), k in brute.items() if not n) + (1 if any(n and c is None for _, n, c in brute) else 0)
    assert kept.count() == wanted


def test_bitmap_bound_holds():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 48, int(rng.integers(1, 500)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) // 2], rng.integers(0, 1 << 48, int(rng.integers(1, 500)), dtype=np.uint64)]))
        x, y = (np.frombuffer(jaccard.bitmap(k), np.uint64) for k in (a, b))
        w = min(len(x), len(y))
        assert jaccard.overlap_bound(jaccard.fold(x, w), jaccard.fold(y, w), len(a), len(b)) >= len(np.intersect1d(a, b))
        assert (jaccard.unpack48(jaccard.pack48(a << np.uint64(16))) == a).all()


def brute_lines(rows):
    keys = [[k.strip(" \t\n\x0b\x0c\r").translate(LOWER) for k in (t or "").split("\n")] for _, t in rows]
    found = Counter(k for ks in keys for k in set(ks))
    out = []
    for (d, t), ks in zip(rows, keys):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, ks) if not (k and found[k] >= 10)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("which", ["edge", "small", "empty"])
def test_lines(request, which):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter(tuple(r) for r in line_dedup.line_digests(docs).collect())
    assert got == brute_lines(rows)


def test_perfect_hash():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 64, 50_000, dtype=np.uint64))
    h = line_dedup.PerfectHash.build(keys)
    assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
    others = rng.integers(0, 1 << 64, 50_000, dtype=np.uint64)
    shard = line_dedup.Shard(*line_dedup.Shard.pack(keys, keys ^ np.uint64(5), np.arange(len(keys))))
    assert (shard.probe(keys, keys ^ np.uint64(5)) == np.arange(len(keys))).all()
    assert (shard.probe(others, others) == 0).all()


def brute_quality(rows):
    """Documents of a host that hold a line are counted one by one, documents with the same set of lines once."""
    feats, sets, lines = [], [], []
    for _, t, _ in rows:
        w = WORD.findall(t or "")
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        ls = [x for x in (t or "").split("\n") if WORD.search(x)]
        feats.append((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), len(rep)))
        norm = [(re.sub("[0-9]+", "0", x.strip(" \t\n\x0b\x0c\r").translate(LOWER)), len(WORD.findall(x))) for x in ls]
        lines.append(norm)
        sets.append(frozenset(x for x, _ in norm))
    held, hosts = {}, {}
    for (_, _, host), s in zip(rows, sets):
        if s:
            hosts.setdefault(host, set()).add(s)
        for x in s:
            held.setdefault((host, x), set()).add(s)
    out = []
    for (d, _, host), f, hs in zip(rows, feats, lines):
        gone = sum(n for h, n in hs if len(held[host, h]) > quality.MAX_DOCS and len(held[host, h]) > quality.MAX_SHARE * len(hosts[host]))
        failed = f[0] < 50 or 100 * f[4] > 50 * f[0]
        out.append((d, *f, failed, not failed and f[0] - gone >= quality.MIN_LEFT * f[0], gone))
    return Counter(out)


@pytest.mark.parametrize("which", ["edge", "small", "empty"])
def test_quality(request, which, monkeypatch):
    monkeypatch.setattr(quality, "MAX_DOCS", 2)
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = Counter(tuple(r) for r in quality.judge(docs, max_docs=2).drop("rk").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words").collect())
    assert got == brute_quality(rows)


def test_keep_good(edge):
    kept = quality.keep_good(edge)
    assert kept.columns == edge.columns
    assert kept.count() == quality.judge(edge).where("kept").count()


def test_line_counts(spark, small):
    """The index answers for every line, frequent or not, and for none else."""
    index = line_dedup.build_index(small, 10)
    keys = [{k for k in (x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (r.text or "").split("\n")) if k} for r in small.collect()]
    held = Counter(k for ks in keys for k in ks)
    rows = [(k, n) for k, n in held.items()] + [("not a line of any document", 0)]
    lines = spark.createDataFrame(rows, "line string, n_true long")
    assert line_dedup.line_counts(lines, index).where("n_docs <> n_true").count() == 0
    assert min(held.values()) == 1 and max(held.values()) >= 10


@pytest.mark.parametrize("probes", [0, 1 << 30])
def test_lines_whatever_a_task_holds(small, monkeypatch, probes):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    monkeypatch.setattr(line_dedup, "PROBES", probes)
    assert Counter(tuple(r) for r in line_dedup.line_digests(small).collect()) == brute_lines(rows)
