"""Sums over pairs of assets by matrix products of blocks, in place of a join on time.

A panel's rows are dealt to blocks of ``BLOCK`` assets and chunks of ``CHUNK`` times; a task has two blocks of one chunk and, for
lags, the times that follow, and gives the products' sums of each pair.  A row is copied once for each block of the other
side, and what leaves a task is a row a pair and lag, summed over chunks after it: no row for each pair and time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512
CHUNK = 4096


def pair_sums(panel: DataFrame, lags: tuple[int, ...], by: tuple[str, ...] = (), within: str | None = None) -> DataFrame:
    """(*by, lag, i, j, n, nx, ny, nxy, sx, sy, sxx, syy, sxy): over the times t when i has a row at t and j one at t + lag.

    n counts them; nx, ny and nxy those with a value of i, of j and of both; the sums are over times when both have one, of values less the asset's mean.
    ``within`` names a column: both rows are of one value of it.
    """
    mean = panel.groupBy(*by, "asset_idx").agg(F.avg("r").alias("mean"))
    rows = panel.join(mean, [*by, "asset_idx"]).select(*by, "t", "asset_idx", (F.col("r") - F.col("mean")).alias("r"), *([F.col(within).alias("__g")] if within else [F.lit(0).alias("__g")]))
    # a block of 2**31 times and assets more is none; a task's chunk has the times that lags reach beyond it
    most = max(lags)
    block, chunk = F.floor(F.col("asset_idx") / BLOCK).cast("int"), F.floor(F.col("t") / CHUNK).cast("long")
    blocks = F.broadcast(panel.agg(F.floor(F.max("asset_idx") / BLOCK).cast("int").alias("last")))  # one row
    sides = rows.crossJoin(blocks).withColumns({"block": block, "other": F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0))))})
    left = sides.select(*by, "t", "asset_idx", "r", "__g", F.col("block").alias("bi"), F.col("other").alias("bj"), chunk.alias("chunk"), F.lit(0).alias("side"))
    back = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(-(-most // CHUNK) if most else 0)), lambda k: F.floor(F.greatest(F.col("t") - k * CHUNK, F.lit(-CHUNK)) / CHUNK).cast("long")))
    right = sides.select(*by, "t", "asset_idx", "r", "__g", F.col("other").alias("bi"), F.col("block").alias("bj"), F.explode(back).alias("chunk"), F.lit(1).alias("side")).where("chunk >= 0")
    kinds = ", ".join(f"{c} {panel.schema[c].dataType.simpleString()}" for c in by)
    schema = (kinds + ", " if by else "") + "lag int, i int, j int, n long, nx long, ny long, nxy long, sx double, sy double, sxx double, syy double, sxy double"

    def run(t: pd.DataFrame) -> pd.DataFrame:
        here = t["side"].to_numpy() == 0
        times = np.unique(t["t"].to_numpy())
        groups = pd.factorize(t["__g"])[0] if within else np.zeros(len(t), np.int64)
        of_time = np.zeros(len(times), np.int64)
        of_time[np.searchsorted(times, t["t"].to_numpy())] = groups
        ends = []
        for side in (here, ~here):
            some = t[side]
            names = np.unique(some["asset_idx"].to_numpy())
            value = np.full((len(times), len(names)), np.nan)
            there = np.zeros_like(value)
            at = np.searchsorted(times, some["t"].to_numpy()), np.searchsorted(names, some["asset_idx"].to_numpy())
            value[at], there[at] = some["r"].to_numpy(float), 1.0
            ends.append((names, value, there))
        (ni, x, rx), (nj, y, ry) = ends
        out = []
        if len(ni) and len(nj):
            own = np.isin(times, t["t"].to_numpy()[here])
            for lag in lags:
                p = np.flatnonzero(own)
                q = np.searchsorted(times, times[p] + lag)
                ok = (q < len(times)) & (times[np.minimum(q, len(times) - 1)] == times[p] + lag)
                p, q = p[ok], q[ok]
                if within:
                    same = of_time[p] == of_time[q]
                    p, q = p[same], q[same]
                vx, vy = np.isfinite(x[p]).astype(float), np.isfinite(y[q]).astype(float)
                a, b = np.nan_to_num(x[p]), np.nan_to_num(y[q])
                n, nx, ny, nxy = rx[p].T @ ry[q], vx.T @ ry[q], rx[p].T @ vy, vx.T @ vy
                sums = [a.T @ vy, vx.T @ b, (a * a).T @ vy, vx.T @ (b * b), a.T @ b]
                k, m = np.nonzero(n)
                out.append(pd.DataFrame({"lag": lag, "i": ni[k], "j": nj[m], **{c: z[k, m].round().astype(np.int64) for c, z in (("n", n), ("nx", nx), ("ny", ny), ("nxy", nxy))}, **dict(zip(("sx", "sy", "sxx", "syy", "sxy"), (z[k, m] for z in sums), strict=True))}))
        made = pd.concat(out, ignore_index=True) if out else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")[len(by) :]})
        return made.assign(**{c: t[c].iloc[0] for c in by})[[c.split()[0] for c in schema.split(", ")]]

    parts = left.union(right).groupBy(*by, "bi", "bj", "chunk").applyInPandas(run, schema)
    whole = ("n", "nx", "ny", "nxy", "sx", "sy", "sxx", "syy", "sxy")
    return parts.groupBy(*by, "lag", "i", "j").agg(*(F.sum(c).alias(c) for c in whole))


def moments(n):
    """(covariance, variance of x, variance of y) of the sums, over their number."""
    cov = F.col("sxy") / n - F.col("sx") / n * (F.col("sy") / n)
    return cov, F.col("sxx") / n - F.pow(F.col("sx") / n, F.lit(2)), F.col("syy") / n - F.pow(F.col("sy") / n, F.lit(2))
