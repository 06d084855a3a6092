"""Panels from a database, by JDBC: a universe as it was on each day, and bars of trades by day, to be taken up again.

The statements do on the server what shrinks the data there: windows of membership, delisting returns, the last price of a
bar.  Spark reads the ranges of days in parallel, one connection a range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .panels import within_day_returns

#: Daily returns of members on each day they were one, the delisting return compounded into the last.
UNIVERSE = """
SELECT a.date AS t, a.permno AS asset,
  CASE WHEN d.dlret IS NULL THEN a.ret WHEN a.ret IS NULL THEN d.dlret ELSE (1 + a.ret) * (1 + d.dlret) - 1 END AS r
FROM {daily} a JOIN {members} m ON m.permno = a.permno AND a.date BETWEEN m.start AND m.ending
LEFT JOIN {delisted} d ON d.permno = a.permno AND d.dlstdt = a.date
WHERE coalesce(a.ret, d.dlret) IS NOT NULL"""

#: The last price of each bar of a day in trading hours.
BARS = """
SELECT asset, bucket, price, volume FROM (
  SELECT sym_root AS asset, floor(sec / {seconds}) * {seconds} AS bucket, price,
    row_number() OVER (PARTITION BY sym_root, floor(sec / {seconds}) ORDER BY sec DESC, tr_seqnum DESC) AS k,
    sum(size) OVER (PARTITION BY sym_root, floor(sec / {seconds})) AS volume
  FROM {trades} WHERE day = {day} AND price > 0 AND sec BETWEEN 34200 AND 57600 AND sym_root IN ({symbols})) x
WHERE k = 1"""


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def universe_sql(start: str, end: str, daily: str = "daily", members: str = "members", delisted: str = "delisted") -> str:
    return f"SELECT * FROM ({UNIVERSE.format(daily=daily, members=members, delisted=delisted)}) u WHERE t BETWEEN {quoted(start)} AND {quoted(end)}"


def bars_sql(trades: str, day: str, symbols: Iterable[str], minutes: int = 30) -> str:
    return BARS.format(trades=trades, day=quoted(day), seconds=60 * minutes, symbols=", ".join(map(quoted, symbols)))


def universe(spark: SparkSession, url: str, start: str, end: str, parts: int = 16, properties: dict[str, str] | None = None, **tables: str) -> DataFrame:
    """(t, asset, r) between two days, read by ranges of days in parallel."""
    reader = spark.read.format("jdbc").options(**(properties or {})).option("url", url).option("dbtable", f"({universe_sql(start, end, **tables)}) u")
    return reader.option("partitionColumn", "t").option("lowerBound", start).option("upperBound", end).option("numPartitions", parts).load()


def jdbc_query(spark: SparkSession, url: str, properties: dict[str, str] | None = None, timeout: int = 300) -> Callable[[str], DataFrame]:
    """Runs a statement there; one that takes longer than ``timeout`` seconds is given up."""
    return lambda sql: spark.read.format("jdbc").options(**(properties or {})).option("url", url).option("queryTimeout", timeout).option("query", sql).load()


def done_days(spark: SparkSession, folder: str) -> set[str]:
    """The days that are in the folder whole, a subfolder each with Spark's mark of success."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/day=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return {x.getPath().getParent().getName().removeprefix("day=") for x in found or ()}


def pull_bars(spark: SparkSession, run: Callable[[str], DataFrame], folder: str, trades: str, symbols: Iterable[str], days: Iterable[str], minutes: int = 30, resume: bool = True) -> dict[str, str]:
    """Write the bars of each day to its folder; {day: why} of those that could not be read, which a later call tries again.

    A day is there or not: what a broken call has left has no mark of success and is written anew.
    """
    symbols, failed = list(symbols), {}
    there = done_days(spark, folder) if resume else set()
    for day in days:
        if day in there:
            continue
        try:
            run(bars_sql(trades, day, symbols, minutes)).write.mode("overwrite").parquet(f"{folder}/day={day}")
        except Exception as e:  # a holiday, a missing table, a timeout: the others go on
            failed[day] = str(e).splitlines()[0][:200]
    return failed


def pulled_bars(spark: SparkSession, folder: str) -> DataFrame:
    """(asset, bar, price, volume) of all days that are whole."""
    days = sorted(done_days(spark, folder))
    if not days:
        return spark.createDataFrame([], "asset string, bar timestamp, price double, volume double")
    rows = spark.read.option("basePath", folder).parquet(*(f"{folder}/day={d}" for d in days))
    bar = F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + F.col("bucket").cast("long"))
    return rows.select("asset", bar.alias("bar"), F.col("price").cast("double").alias("price"), F.col("volume").cast("double").alias("volume"))


def pulled_returns(spark: SparkSession, folder: str) -> DataFrame:
    """(asset, bar, r): returns within each day."""
    return within_day_returns(pulled_bars(spark, folder))
