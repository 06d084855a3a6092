"""Trailing windows and block resamples as tables: what follows carries their key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trailing(panel: DataFrame, width: int, step: int, ahead: int = 0, closed: bool = False) -> DataFrame:
    """(wid, start, end): windows [start, end) of ``width`` times, ``step`` apart, with more than ``ahead`` times after each, or as many if ``closed``."""
    n = F.max("t") + 1
    last = n - ahead - (0 if closed else 1)
    ends = F.when(last >= width, F.sequence(F.lit(width), F.greatest(last, F.lit(width)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return panel.agg(ends.alias("ends")).select(F.posexplode("ends").alias("wid", "end")).select("wid", (F.col("end") - width).alias("start"), "end")


def walk_forward(panel: DataFrame, train: int, test: int, step: int | None = None) -> DataFrame:
    """(wid, start, end, test_end): trains of ``train`` times, each followed by a test of ``test``, as many as fit."""
    return trailing(panel, train, step or test, test, closed=True).withColumn("test_end", F.col("end") + test)


def within(panel: DataFrame, windows: DataFrame, begin="start", end="end") -> DataFrame:
    """The rows of the panel in every window, by an equi-join on time."""
    w = windows.select("wid", F.expr(begin).alias("__a"), F.expr(end).alias("__b")).where("__a < __b")
    times = w.select("wid", F.explode(F.sequence(F.col("__a").cast("long"), F.col("__b").cast("long") - 1)).alias("__t"))
    return panel.join(times, F.col("t") == F.col("__t")).drop("__t")


def blocks(panel: DataFrame, boots: int, block: int, seed: int = 0) -> DataFrame:
    """The panel's rows by (boot, t): blocks of consecutive times from drawn starts, cut to as many times as the panel has.

    A start is drawn by a hash of seed, resample and block, evenly from those before n - block, so the last time is never
    drawn where there are more times than a block has.
    """
    n = panel.agg((F.max("t") + 1).alias("n"))
    room, many = F.greatest(F.col("n") - block, F.lit(1)), F.ceil(F.col("n") / block)
    starts = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(boots - 1))).alias("boot"), room.alias("room"), many.alias("many"))
    starts = starts.select("n", "boot", "room", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("many") - 1)).alias("k"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "boot", "k").cast("binary")), 1, 8), 16, 10).cast("bigint")
    starts = starts.withColumn("start", F.pmod(drawn, F.col("room")))
    rows = starts.select("n", "boot", "k", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("o")).where("start + o < n")
    rows = rows.select("boot", (F.col("k") * block + F.col("o")).cast("int").alias("pos"), (F.col("start") + F.col("o")).alias("src"), "n").where("pos < n")
    return panel.join(rows.select("boot", "pos", "src"), F.col("t") == F.col("src")).drop("t", "src").withColumnRenamed("pos", "t")
