"""Engle and Granger's test of pairs, on cumulative returns: a regression, and a unit-root test of what it leaves.

A pair is a group of two series; pairs run side by side.  Lags of the unit-root test are chosen by Akaike's criterion over one
sample, then the test runs on all times that the chosen lags leave.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# MacKinnon's (1994) response surface for two variables and a constant.
TAU_STAR, TAU_MIN, TAU_MAX = -2.62, -18.86, 0.92
SMALL_P = (2.92, 1.5012, 0.039796)
LARGE_P = (2.1945, 0.64695, -0.29198, -0.042377)


def p_value(tau: float) -> float:
    if not tau < TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    z = sum(c * tau**k for k, c in enumerate(SMALL_P if tau <= TAU_STAR else LARGE_P))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    left = y - x @ beta
    return beta, float(left @ left), left


def unit_root(u: np.ndarray) -> float:
    """The t statistic of the level in a regression of changes on it and lagged changes, without a constant."""
    n = len(u)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 1)
    if most < 0:
        raise ValueError("too few times")
    change = np.diff(u)

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Level and ``lags`` lagged changes, from the time on that ``skip`` lags leave."""
        y = change[skip:]
        return np.column_stack([u[skip:-1], *(change[skip - k : len(change) - k] for k in range(1, lags + 1))]), y

    best, chosen = np.inf, 0
    for lags in range(most + 1):
        x, y = design(lags, most)
        _, rss, _ = _fit(x, y)
        aic = len(y) * (math.log(2 * math.pi * max(rss, 1e-300) / len(y)) + 1) + 2 * x.shape[1]
        if aic < best:
            best, chosen = aic, lags
    x, y = design(chosen, chosen)
    beta, rss, _ = _fit(x, y)
    error = math.sqrt(rss / (len(y) - x.shape[1]) * np.linalg.pinv(x.T @ x)[0, 0])
    return float(beta[0] / error)


def engle_granger(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(t, p) of the pair; series that are one line of each other are cointegrated, and what can't be tested is not."""
    try:
        x = np.column_stack([b, np.ones(len(b))])
        _, rss, left = _fit(x, a)
        total = float(((a - a.mean()) ** 2).sum())
        if total > 0 and 1 - rss / total >= 1 - 100 * math.sqrt(np.finfo(float).eps):
            return -math.inf, 0.0
        tau = unit_root(left)
    except (ValueError, ZeroDivisionError, np.linalg.LinAlgError):
        return math.nan, 1.0
    return (tau, p_value(tau)) if math.isfinite(tau) else (math.nan, 1.0)


def cointegration(panel: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, tau, p) of pairs (a, b) of places of assets, on running sums of their returns."""
    level = panel.select("t", "asset_idx", F.sum("r").over(Window.partitionBy("asset_idx").orderBy("t")).alias("level"))
    rows = pairs.select("a", "b").join(level.toDF("t", "a", "x"), "a").join(level.toDF("t", "b", "y"), ["b", "t"])

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("t")
        tau, p = engle_granger(t["x"].to_numpy(float), t["y"].to_numpy(float))
        return pd.DataFrame({"a": t["a"].iloc[:1], "b": t["b"].iloc[:1], "tau": [tau], "p": [p]})

    return rows.select("a", "b", "t", "x", "y").groupBy("a", "b").applyInPandas(run, "a int, b int, tau double, p double")


def candidates(panel: DataFrame, most: int | None = None, seed: int = 0) -> DataFrame:
    """(a, b), a < b: all pairs of assets, or ``most`` of them drawn by a hash of the seed."""
    assets = panel.select(F.col("asset_idx").alias("a")).distinct()
    pairs = assets.join(assets.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    if most is None:
        return pairs
    drawn = F.md5(F.concat_ws("-", F.lit(seed), "a", "b").cast("binary"))
    return pairs.orderBy(drawn, "a", "b").limit(most)


def most_cointegrated(panel: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    return cointegration(panel, pairs).orderBy("p", "a", "b").limit(k).select("a", "b")
