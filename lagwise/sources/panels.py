"""Panels and bars from the fixture tables, long form: one row for each time and asset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordinal(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): dense positions from 0 of the distinct values, few by nature (times or assets)."""
    return df.select(column).distinct().withColumn(name, F.row_number().over(Window.orderBy(column)) - 1)


def week_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(wk, asset, sector, v): what the customers of a nation ordered in a week; only weeks and nations that have orders."""
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return joined.groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("wk"), F.col("n_name").alias("asset"), F.col("r_name").alias("sector")).agg(F.sum("o_totalprice").alias("v"))


def week_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, asset_idx, asset, sector, r): weekly change of ln(1 + v) on the dense grid, missing weeks as 0."""
    sales = materialize(week_sales(spark, sf_dir), "sales")
    weeks, assets = ordinal(sales, "wk", "t"), sales.select("asset", "sector").distinct()
    assets = assets.withColumn("asset_idx", F.row_number().over(Window.orderBy("asset")) - 1)
    grid = weeks.crossJoin(assets).join(sales.select("wk", "asset", "v"), ["wk", "asset"], "left").fillna(0.0, ["v"])
    change = F.log1p("v") - F.lag(F.log1p("v")).over(Window.partitionBy("asset").orderBy("t"))
    return grid.withColumn("r", change).where("r is not null").select((F.col("t") - 1).cast("int").alias("t"), F.col("asset_idx").cast("int").alias("asset_idx"), "asset", "sector", "r")


def bars(events: DataFrame, minutes: int = 360, assets: int = 20) -> DataFrame:
    """(asset, bar, price, volume, n): the last price of each tumbling window, by time and then sequence."""
    start = F.window("ts", f"{minutes} minutes").start
    return (
        events.groupBy((F.col("user_id") % assets).alias("asset"), start.alias("bar"))
        .agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"), F.sum("value").alias("volume"), F.count("*").alias("n"))
    )


def within_day_returns(bars_: DataFrame) -> DataFrame:
    """Simple change from the bar before in the same day; the first bar of a day has none."""
    along = Window.partitionBy("asset", F.to_date("bar")).orderBy("bar")
    return bars_.withColumn("r", F.try_divide(F.col("price"), F.lag("price").over(along)) - 1).where("r is not null")


def membership(facts: DataFrame, members: DataFrame, key: str, date: str) -> DataFrame:
    """Facts within the validity of their key's membership; a null end is open."""
    inside = (facts[date] >= members["start"]) & (members["end"].isNull() | (facts[date] <= members["end"]))
    return facts.join(members, (facts[key] == members[key]) & inside).drop(members[key])


def splice(ret, last):
    """A return that a final return compounds, replaces or leaves."""
    return F.when(ret.isNotNull() & last.isNotNull(), (1 + ret) * (1 + last) - 1).when(last.isNotNull(), last).otherwise(ret)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def present(panel: DataFrame, share: float) -> DataFrame:
    """The rows of assets with values in at least this share of all times."""
    of = panel.agg(F.countDistinct("t").alias("of"))
    good = panel.groupBy("asset").agg(F.count("r").alias("n")).crossJoin(F.broadcast(of)).where(F.col("n") >= share * F.col("of")).select("asset")
    return panel.join(good, "asset", "left_semi")


def normalized(name):
    """Upper case, punctuation as spaces, without the words that only say what kind of company it is."""
    bare = F.regexp_replace(F.upper(name), "[^A-Z0-9 ]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(CL A|CORP|INC|CO|LTD|PLC|GROUP|HOLDINGS)\b", " "), " +", " "))


def contained(names: DataFrame, others: DataFrame, name: str, other: str, order: str, least: int = 4) -> DataFrame:
    """(name, other): for each name of at least ``least`` characters the first of the others, as long, that it holds or that holds it.

    A text of four characters or more that stands in another has its first four there, so candidates come from an equi-join
    on four neighbouring characters; containment is checked on those alone.
    """
    n = names.select(F.col(name).alias("n")).where(F.length("n") >= least).distinct()
    o = others.select(F.col(other).alias("o"), F.col(order).alias("k")).where(F.length("o") >= least)
    grams = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 3), lambda i: F.substring(c, i, F.lit(4))))).alias("g")
    holds = n.select("n", grams(F.col("n"))).join(o.select("o", "k", F.substring("o", 1, 4).alias("g")), "g").where(F.contains("n", "o"))
    held = n.select("n", F.substring("n", 1, 4).alias("g")).join(o.select("o", "k", grams(F.col("o"))), "g").where(F.contains("o", "n"))
    both = holds.select("n", "o", "k").union(held.select("n", "o", "k"))
    return both.groupBy("n").agg(F.min_by("o", F.struct("k", "o")).alias("o")).toDF(name, other)
