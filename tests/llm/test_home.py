"""Tiles that share classes are dealt together; bitmaps and overlaps of many arrays at once."""

import numpy as np
from pyspark.sql import functions as F

from lagwise.llm import jaccard


def test_tiles_of_the_same_classes_meet(spark):
    """Small tiles with the same smallest class are in one partition; larger ones are whole, and none loses a row."""
    rows = [(1000 * home + t, 20, c) for home in range(40) for t in range(6) for c in (100 * home, 100 * home + 1 + t, 100 * home + 20 + t)]
    rows += [(10**6 + t, 20, -1 - c) for t in range(3) for c in range(100 + t)]
    tiles = jaccard.distinct_tiles(spark.createDataFrame(rows, "token long, n int, cls long")).withColumn("root", F.col("cls"))
    maps = spark.createDataFrame([(c, bytes(128)) for c in {c for _, _, c in rows}], "cls long, bits binary")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = jaccard._cells(tiles, maps).select("token", "i", "j", "cls", F.spark_partition_id().alias("at")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.token, r.cls) for r in got) == sorted((t, c) for t, _, c in rows)
    at = {}
    for r in got:
        at.setdefault(r.token // 1000 if r.token < 10**6 else (r.token, r.i, r.j), set()).add(r.at)
    assert all(len(x) == 1 for x in at.values())
    assert len({min(x) for x in at.values()}) > 8


def test_rows_of_merged_tiles_are_not_dealt(spark, monkeypatch):
    """Of tiles with the same classes only the rows of one reach the join."""
    met = []
    real = jaccard.class_filter
    monkeypatch.setattr(jaccard, "class_filter", lambda ids, *a: met.append(sorted(r.cls for r in ids.collect())) or real(ids, *a))
    rows = [(t, 9, c) for t in range(50) for c in (1, 2, 3)] + [(100, 9, 4)]
    got = jaccard.distinct_tiles(spark.createDataFrame(rows, "token long, n int, cls long")).collect()
    assert met == [[0]]
    assert sorted((r.token, r.cls, r.of, r.home) for r in got) == [(0, 1, 3, 1), (0, 2, 3, 1), (0, 3, 3, 1)]


def test_many_arrays_at_once(monkeypatch):
    """As one by one, for sizes at every edge, whatever is looked at together."""
    rng = np.random.default_rng(8)
    sizes = [0, 1, 2, 46, 63, 64, 65, 1023, 1024, 1025, 2047, 2049, 70000, 16384, 16385, 5]
    raw = [jaccard.pack48(np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))) for n in sizes]
    half = [jaccard.pack48(np.sort(np.concatenate([jaccard.unpack48(x)[::2] << np.uint64(16), rng.integers(0, 1 << 63, 30, dtype=np.uint64)]))) for x in raw]
    for most in (1, 3000, 1 << 20):
        monkeypatch.setattr(jaccard, "HELD_KEYS", most)
        for wide in (False, True):
            assert jaccard.bitmaps(raw, wide) == [jaccard.bitmap(jaccard.unpack48(x), wide) for x in raw]
        assert jaccard.overlaps(raw, half).tolist() == [len(np.intersect1d(jaccard.unpack48(x), jaccard.unpack48(y))) for x, y in zip(raw, half, strict=True)]
    assert jaccard.bitmaps([], False) == [] and len(jaccard.overlaps([], [])) == 0
