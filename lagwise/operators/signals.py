"""Pairs to trade: orientation, selection, information coefficient, mean reversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import average_rank, guarded_corr
from .gram import moments, pair_sums
from .graphs import TINY


def split(panel: DataFrame, train: float = 0.6, val: float = 0.2, with_val: bool = False) -> tuple[DataFrame, DataFrame]:
    """Train and test rows in time order, the rows between with the former if asked for; sizes are rounded half to even."""
    n = F.broadcast(panel.agg(F.countDistinct("t").alias("n")))
    rows = panel.crossJoin(n)  # one row
    a, b = F.bround(F.col("n") * train), F.bround(F.col("n") * train) + F.bround(F.col("n") * val)
    return rows.where(F.col("t") < (b if with_val else a)).drop("n"), rows.where(F.col("t") >= b).drop("n")


def correlation(panel: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, i, j, c) for i < j at the same time, over times when both are there; null without variance."""
    sums = pair_sums(panel, (0,), by).where("i < j")
    n = F.greatest("nxy", F.lit(1))
    cov, vx, vy = moments(n)
    some = (vx > TINY * F.col("sxx") / n) & (vy > TINY * F.col("syy") / n) & (F.col("sxx") > 0) & (F.col("syy") > 0)
    return sums.select(*by, "i", "j", F.when(some, F.try_divide(cov, F.sqrt(vx * vy))).alias("c"))


def grouped_lagged_correlation(panel: DataFrame, lags: tuple[int, ...]) -> DataFrame:
    """(lag, i, j, c): z-scores over all times (n - 1), products of pairs of times in one ``grp``, over their number less 1.

    A column with a missing value or without variance gives 0; the position ``t`` and not the place in the group is shifted.
    """
    of = panel.groupBy("asset_idx").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), (F.count("r") == F.count(F.lit(1))).alias("whole"))
    z = F.when(F.col("whole") & (F.col("sd") > 0), (F.col("r") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    rows = panel.join(of, "asset_idx").select("t", "grp", "asset_idx", z.alias("r"))
    sums = pair_sums(rows, lags, within="grp").where("i <> j")  # z-scores have the mean 0 already
    return sums.select("lag", "i", "j", F.coalesce(F.try_divide(F.col("sxy"), F.col("n") - 1), F.lit(0.0)).alias("c"))


def orient(pairs: DataFrame, lagged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, leader, lagger, lag, a, b) of unordered pairs (a, b): the direction and lag of the largest absolute correlation; ties go to the first lag, then to a."""
    found = lagged.select(*by, F.col("i"), F.col("j"), "lag", F.round(F.abs("c"), 9).alias("s"), F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    mine = pairs.select(*by, "a", "b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).join(found, [*by, "lo", "hi"])
    best = F.max_by(F.struct("i", "j", "lag"), F.struct("s", -F.col("lag"), F.col("i") == F.col("a")))
    return mine.groupBy(*by, "a", "b").agg(best.alias("x")).select(*by, F.col("x.i").alias("leader"), F.col("x.j").alias("lagger"), "x.lag", "a", "b")


def _shifted(panel: DataFrame, pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    keys = pairs.select("leader", "lagger", "lag").distinct()
    a = panel.select(*by, F.col("t").alias("ta"), F.col("asset_idx").alias("leader"), F.col("r").alias("x")).join(keys, "leader").withColumn("t", F.col("ta") + F.col("lag"))
    return a.join(panel.select(*by, "t", F.col("asset_idx").alias("lagger"), F.col("r").alias("y")), [*by, "t", "lagger"])


def signs(train: DataFrame, pairs: DataFrame) -> DataFrame:
    """(leader, lagger, lag, sign): of the correlation on the train rows, 1 where it is 0; pairs without one go."""
    c = _shifted(train, pairs).groupBy("leader", "lagger", "lag").agg(guarded_corr(F.col("x"), F.col("y")).alias("c")).where("c is not null")
    return c.select("leader", "lagger", "lag", F.when(F.round("c", 9) < 0, -1.0).otherwise(1.0).alias("sign"))


def forecasts(train: DataFrame, test: DataFrame, pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(leader, lagger, lag, fore, real) on the test rows; the sign comes from the train rows.

    ``by`` keeps a forecast and what came true in one group (a day); the sign is fitted on all train rows.
    """
    rows = _shifted(test, pairs, by).join(signs(train, pairs), ["leader", "lagger", "lag"])
    return rows.select("leader", "lagger", "lag", (F.col("sign") * F.col("x")).alias("fore"), F.col("y").alias("real"))


def forecasts_by(train: DataFrame, test: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, leader, lagger, lag, fore, real): forecasts of each window's own pairs, signs from its own train rows."""
    keys = [key, "leader", "lagger", "lag"]
    some = pairs.select(*keys).distinct()

    def shifted(panel: DataFrame) -> DataFrame:
        a = panel.select(key, F.col("t").alias("ta"), F.col("asset_idx").alias("leader"), F.col("r").alias("x")).join(some, [key, "leader"]).withColumn("t", F.col("ta") + F.col("lag"))
        return a.join(panel.select(key, "t", F.col("asset_idx").alias("lagger"), F.col("r").alias("y")), [key, "t", "lagger"])

    c = shifted(train).groupBy(*keys).agg(guarded_corr(F.col("x"), F.col("y")).alias("c")).where("c is not null")
    sign = c.select(*keys, F.when(F.round("c", 9) < 0, -1.0).otherwise(1.0).alias("sign"))
    return shifted(test).join(sign, keys).select(*keys, (F.col("sign") * F.col("x")).alias("fore"), F.col("y").alias("real"))


def pair_ic(rows: DataFrame) -> DataFrame:
    """(leader, lagger, lag, ic, n): rank correlation of each pair with five or more forecasts."""
    key = ["leader", "lagger", "lag"]
    d = rows.select(*key, average_rank("fore", key).alias("a"), average_rank("real", key).alias("b"))
    return d.groupBy(*key).agg(guarded_corr(F.col("a"), F.col("b")).alias("ic"), F.count("*").alias("n")).where("n >= 5 and ic is not null")


def mean_reversion(test: DataFrame, pairs: DataFrame, z_entry: float = 2.0, lookback: int = 30) -> DataFrame:
    """(sharpe, mean_daily): spread of the running sums, position against its z-score a time later, mean over pairs, sqrt(252) a year."""
    p = test.select("t", "asset_idx", "r")
    a, b = p.toDF("t", "leader", "x"), p.toDF("t", "lagger", "y")
    rows = a.join(pairs.select("leader", "lagger", "lag"), "leader").join(b, ["t", "lagger"])
    key = Window.partitionBy("leader", "lagger", "lag").orderBy("t")
    back = key.rowsBetween(1 - lookback, 0)
    rows = rows.withColumn("spread", F.sum(F.col("x") - F.col("y")).over(key.rowsBetween(Window.unboundedPreceding, 0)))
    full = F.count("spread").over(back) == lookback
    z = F.when(full, F.try_divide(F.col("spread") - F.avg("spread").over(back), F.stddev_samp("spread").over(back)))
    rows = rows.withColumn("z", F.round(z, 9))
    position = F.when(F.abs("z") > z_entry, -F.signum("z")).otherwise(0.0)
    rows = rows.withColumn("p", position).withColumn("gain", F.coalesce(F.lag("p").over(key), F.lit(0.0)) * (F.col("x") - F.col("y")))
    book = rows.groupBy("t").agg(F.avg("gain").alias("gain"))
    sd = F.stddev_samp("gain")
    return book.agg(F.when(sd > 0, F.sqrt(F.lit(252.0)) * F.avg("gain") / sd).alias("sharpe"), F.avg("gain").alias("mean_daily"))
