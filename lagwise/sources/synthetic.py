"""Synthetic sources with a known truth, made on the executors from hashes of a seed and a place: no order, no state.

Two runs with one seed agree, whatever the partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FLOOR = 1e-3


def uniform(seed: int, *place) -> Column:
    """In (0, 1), by a hash of seed and place."""
    h = F.xxhash64(F.lit(seed).cast("long"), *(F.lit(p) if isinstance(p, str) else p for p in place))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, *place) -> Column:
    radius = F.sqrt(-2 * F.log(uniform(seed, "radius", *place)))
    return radius * F.cos(2 * math.pi * uniform(seed, "angle", *place))


def block_graph(spark: SparkSession, sizes: list[int], p_in: float = 0.45, p_out: float = 0.03, weight_in: tuple[float, float] = (1.0, 0.25), weight_out: tuple[float, float] = (0.4, 0.2), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(edges (src, dst, weight), labels (v, label)) of a directed graph with planted blocks; weights are positive."""
    if any(s <= 0 for s in sizes):
        raise ValueError("blocks have at least one vertex")
    if not 0.0 <= p_out <= p_in <= 1.0:
        raise ValueError("0 <= p_out <= p_in <= 1")
    n, begins = sum(sizes), list(accumulate(sizes[:-1]))

    def block(v: str) -> Column:
        return sum((F.when(F.col(v) >= b, 1).otherwise(0) for b in begins), F.lit(0)).cast("int")

    vertices = spark.range(n).select(F.col("id").cast("int").alias("v"))
    pairs = vertices.select(F.col("v").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("dst")).where("src <> dst")
    pairs = pairs.withColumns({"la": block("src"), "lb": block("dst")})
    same = F.col("la") == F.col("lb")
    pairs = pairs.where(uniform(seed, "edge", F.col("src"), F.col("dst")) < F.when(same, p_in).otherwise(p_out))
    mean, deviation = (F.when(same, weight_in[k]).otherwise(weight_out[k]) for k in (0, 1))
    weight = F.greatest(F.lit(FLOOR), mean + deviation * normal(seed, "weight", F.col("src"), F.col("dst")))
    return pairs.select("src", "dst", weight.alias("weight")), vertices.withColumn("label", block("v"))


@dataclass
class LeadLag:
    """``returns``: (t, asset, asset_idx, sector, r); ``pairs``: (leader, lagger, lag), the truth."""

    returns: DataFrame
    pairs: DataFrame
    market: DataFrame


def lead_lag_panel(
    spark: SparkSession, n_assets: int = 40, n_periods: int = 1500, n_sectors: int = 4, market_beta: float = 1.0, market_vol: float = 0.01, sector_vol: float = 0.008,
    idio_vol: float = 0.012, n_pairs: int = 8, strength: float = 0.5, lag: int = 1, seed: int = 0,
) -> LeadLag:
    """Returns of market, sector and own noise, and of disjoint pairs of which one follows what the other's own noise did ``lag`` before.

    Pairs are of one sector as far as there are such, so that they outlive the removal of market and sectors.
    """
    if 2 * n_pairs > n_assets:
        raise ValueError("two assets for each pair are needed")
    if lag < 1:
        raise ValueError("lags start at 1")
    i, t = F.col("asset_idx"), F.col("t")
    assets = spark.range(n_assets).select(F.col("id").cast("int").alias("asset_idx"))
    assets = assets.select(F.format_string("A%03d", i).alias("asset"), "asset_idx", F.floor(uniform(seed, "sector", i) * n_sectors).cast("int").alias("sector"), (market_beta + 0.2 * normal(seed, "beta", i)).alias("beta"))
    # two by two within a sector in the order of a hash; those left over two by two across sectors after them
    place = F.row_number().over(Window.partitionBy("sector").orderBy(uniform(seed, "pair", i), i)) - 1
    held = F.count("*").over(Window.partitionBy("sector"))
    placed = assets.withColumn("place", place).withColumn("odd", (F.col("place") == held - 1) & (held % 2 == 1))
    inner = placed.where(~F.col("odd")).withColumn("group", F.concat_ws("-", "sector", F.floor(F.col("place") / 2).cast("string")))
    left = placed.where("odd").withColumn("group", F.concat(F.lit("x-"), F.floor((F.row_number().over(Window.orderBy("sector")) - 1) / 2).cast("string")))  # one a sector at most
    grouped = inner.unionByName(left).groupBy("group").agg(F.min(F.struct(uniform(seed, "lead", i).alias("u"), i)).alias("a"), F.max(F.struct(uniform(seed, "lead", i).alias("u"), i)).alias("b"), F.count("*").alias("n"))
    order = F.struct(F.col("group").startswith("x-").alias("across"), F.xxhash64(F.lit(seed), "group").alias("h"), "group")
    pairs = grouped.where("n = 2").orderBy(order).limit(n_pairs).select(F.col("a.asset_idx").alias("leader"), F.col("b.asset_idx").alias("lagger"), F.lit(lag).alias("lag"))

    times = spark.range(n_periods).select(F.col("id").cast("int").alias("t"))
    rows = assets.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n_periods - 1))))
    own = idio_vol * normal(seed, "own", t, i)
    rows = rows.withColumn("market", market_vol * normal(seed, "market", t)).withColumn("base", F.col("beta") * F.col("market") + sector_vol * normal(seed, "sectors", t, F.col("sector")) + own)
    rows = rows.join(pairs.select(F.col("lagger").alias("asset_idx"), "leader"), "asset_idx", "left")
    follows = F.when(F.col("leader").isNotNull() & (t >= lag), strength * idio_vol * normal(seed, "own", t - lag, F.col("leader"))).otherwise(0.0)
    returns = rows.select("t", "asset", "asset_idx", "sector", (F.col("base") + follows).alias("r"))
    return LeadLag(returns, pairs, times.select("t", (market_vol * normal(seed, "market", t)).alias("market")))
