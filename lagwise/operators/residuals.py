"""Common factors and what is left of returns without them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gram import pair_sums


def market_factor(panel: DataFrame) -> DataFrame:
    """(t, market): the mean over assets; null if any return is missing, as a missing value poisons the mean."""
    mean = F.when(F.count("r") == F.count(F.lit(1)), F.avg("r"))
    return panel.groupBy("t").agg(mean.alias("market"))


def sector_factors(panel: DataFrame) -> DataFrame:
    return panel.groupBy("t", "sector").agg(F.avg("r").alias("factor"))


def leave_one_out(panel: DataFrame) -> DataFrame:
    """Each asset's sector mean without itself; null for an asset alone in its sector."""
    w = Window.partitionBy("t", "sector")
    rest = F.try_divide(F.sum("r").over(w) - F.col("r"), F.count("r").over(w) - 1)
    return panel.withColumn("peers", rest)


def _slope(x, y, w):
    """Least squares with intercept over a window: (slope, intercept)."""
    n, sx, sy = F.count(x).over(w), F.avg(x).over(w), F.avg(y).over(w)
    cov = F.avg(x * y).over(w) - sx * sy
    var = F.avg(x * x).over(w) - sx * sx
    b = F.coalesce(F.try_divide(cov, var), F.lit(0.0))
    return n, b, sy - b * sx


def residualize(panel: DataFrame, method: str = "market_sector") -> DataFrame:
    """``panel`` with r replaced by its residual on the market, or on the market and the peers of the sector."""
    if method not in ("market", "market_sector"):
        raise ValueError(f"unknown method {method!r}")
    w = Window.partitionBy("asset")
    rows = panel.join(market_factor(panel), "t")
    if method == "market":
        _, b, a = _slope(F.col("market"), F.col("r"), w)
        return rows.withColumn("r", F.col("r") - a - b * F.col("market")).drop("market")
    # peers alone in their sector fall back on the market
    return _two_regressors(leave_one_out(rows).withColumn("peers", F.coalesce("peers", F.lit(0.0))), "market", "peers").select(*panel.columns)


def _two_regressors(rows: DataFrame, x: str, z: str) -> DataFrame:
    """``rows`` with r less its fit on two regressors and a constant for each asset: demeaned normal equations."""
    w = Window.partitionBy("asset")
    for c in ("r", x, z):
        rows = rows.withColumn(f"d_{c}", F.col(c) - F.avg(c).over(w))
    s = lambda a, b: F.sum(F.col(f"d_{a}") * F.col(f"d_{b}")).over(w)
    rows = rows.withColumns({"xx": s(x, x), "zz": s(z, z), "xz": s(x, z), "rx": s("r", x), "rz": s("r", z), "n": F.count("r").over(w)})
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    whole = F.abs(det) > 1e-12 * F.col("xx") * F.col("zz")
    # a regressor without variance is left out; of two that tell the same the first stays
    flat_x = F.col("xx") <= 1e-24 * F.col("n")
    alone = lambda r, v: F.coalesce(F.try_divide(F.col(r), F.when(F.col(v) > 1e-24 * F.col("n"), F.col(v))), F.lit(0.0))
    bx = F.when(whole, F.try_divide(F.col("rx") * F.col("zz") - F.col("rz") * F.col("xz"), det)).otherwise(alone("rx", "xx"))
    bz = F.when(whole, F.try_divide(F.col("rz") * F.col("xx") - F.col("rx") * F.col("xz"), det)).otherwise(F.when(flat_x, alone("rz", "zz")).otherwise(0.0))
    return rows.withColumn("r", F.col("d_r") - bx * F.col(f"d_{x}") - bz * F.col(f"d_{z}"))


def on_two_factors(panel: DataFrame, factors: DataFrame) -> DataFrame:
    """``panel`` with r replaced by its residual on the factors f1 and f2 of (t, f1, f2)."""
    return _two_regressors(panel.join(factors, "t"), "f1", "f2").select(*panel.columns)


def principal(panel: DataFrame, k: int) -> DataFrame:
    """``panel`` with r replaced by its residual on the k largest principal components of the demeaned columns.

    The Gram matrix of the assets is summed by products of blocks; only it (assets squared) comes to the driver, and
    only the loadings go back, so no axis of time is ever in one place.
    """
    w = Window.partitionBy("asset_idx")
    rows = panel.withColumn("__d", F.col("r") - F.avg("r").over(w))
    sums = pair_sums(rows.withColumn("r", F.col("__d")), (0,)).select("i", "j", F.col("sxy").alias("g"))
    gram = sums.toPandas().pivot(index="i", columns="j", values="g").fillna(0.0)  # assets squared
    vectors = np.linalg.eigh(gram.to_numpy())[1][:, ::-1][:, :k]
    loads = panel.sparkSession.createDataFrame([(int(v), c, float(vectors[n, c])) for n, v in enumerate(gram.index) for c in range(vectors.shape[1])], "asset_idx int, c int, load double")
    scores = rows.join(loads, "asset_idx").groupBy("t", "c").agg(F.sum(F.col("__d") * F.col("load")).alias("score"))
    fit = scores.join(loads, "c").groupBy("t", "asset_idx").agg(F.sum(F.col("score") * F.col("load")).alias("fit"))
    return rows.join(fit, ["t", "asset_idx"]).withColumn("r", F.col("__d") - F.col("fit")).select(*panel.columns)
