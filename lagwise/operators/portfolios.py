"""Sets of assets to hold: least correlated, one of each community; and what they risk afterwards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def least_correlated(correlation: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(wid, asset_idx, place): from an asset drawn by a hash of seed and window on, the one with the least mean |rho| to those chosen, by the lowest place on ties.

    ``correlation`` is (wid, i, j, c) for i < j; a window is a task and holds a number for each pair.
    """

    def run(t: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([t["i"], t["j"]]), return_inverse=True)
        m = np.zeros((len(names), len(names)))
        i, j = at[: len(t)], at[len(t) :]
        m[i, j] = m[j, i] = np.abs(t["c"].to_numpy(float))
        wid = int(t["wid"].iloc[0])
        chosen = [int(np.random.default_rng([seed, wid]).integers(len(names)))]
        free = np.ones(len(names), bool)
        free[chosen[0]] = False
        total = m[chosen[0]].copy()
        while len(chosen) < min(k, len(names)):
            best = int(np.where(free, total, np.inf).argmin())
            chosen.append(best)
            free[best] = False
            total += m[best]
        return pd.DataFrame({"wid": wid, "asset_idx": names[chosen], "place": range(len(chosen))})

    return correlation.select("wid", "i", "j", F.coalesce("c", F.lit(0.0)).alias("c")).groupBy("wid").applyInPandas(run, "wid int, asset_idx int, place int")


def representatives(communities: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(wid, asset_idx, place): in rounds over the communities, the largest first, the vertex of each with the most edges that is left."""
    degree = edges.select("wid", F.explode(F.array("src", "dst")).alias("v")).groupBy("wid", "v").agg(F.count("*").alias("d"))
    size = Window.partitionBy("wid", "root")
    rows = communities.join(degree, ["wid", "v"], "left").fillna(0, ["d"]).withColumn("size", F.count("*").over(size))
    rows = rows.withColumn("round", F.row_number().over(size.orderBy(F.desc("d"), "v")))
    place = F.row_number().over(Window.partitionBy("wid").orderBy("round", F.desc("size"), "root")) - 1
    return rows.withColumn("place", place).where(F.col("place") < k).select("wid", F.col("v").alias("asset_idx"), "place")


def risk(returns: DataFrame, held: DataFrame, periods: int) -> DataFrame:
    """(method, wid, vol, drawdown): of the mean return of what each method holds; returns are (wid, t, asset_idx, r) of the times held."""
    book = returns.join(held.select("method", "wid", "asset_idx"), ["wid", "asset_idx"]).groupBy("method", "wid", "t").agg(F.avg("r").alias("r"))
    along = Window.partitionBy("method", "wid").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    level = book.withColumn("level", F.product(1 + F.col("r")).over(along))
    fall = level.withColumn("fall", F.col("level") / F.max("level").over(along) - 1)
    return fall.groupBy("method", "wid").agg((F.stddev_samp("r") * F.sqrt(F.lit(float(periods)))).alias("vol"), F.min("fall").alias("drawdown"))
