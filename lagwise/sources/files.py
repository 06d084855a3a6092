"""Panels from files: wide or long CSV, matrices, exports in three files, series, headerless tables; folders as a catalog; reports.

Everything is read by Spark's own readers with a schema of strings and cast with ``try_cast``, so no file is read twice
to guess types and a value that is no number is null.  Panels stay in long form (t, asset, r), one row a value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import synthetic

#: Names of columns by meaning, the preferred first.
DATES = ("date", "datadate", "caldt")
IDS = ("ticker", "permno", "cusip", "id")
RETURNS = ("ret", "return", "returns")
SECTORS = ("sector", "gsector", "gics", "ggroup")
BEGINS = ("mbrstartdt", "start", "from", "linkdt")
ENDS = ("mbrenddt", "end", "thru", "linkenddt")
OPEN_END = "2100-01-01"


@dataclass
class Bundle:
    """A panel (t, asset, r) and, if known, the sector of each asset (asset, sector)."""

    returns: DataFrame
    sectors: DataFrame | None = None


def q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def column(df: DataFrame, *names: str) -> str:
    """The first of these names that a column has, whatever its case."""
    by = {c.lower(): c for c in df.columns}
    for name in names:
        if name in by:
            return by[name]
    raise KeyError(f"none of {names} among {df.columns}")


def number(x: Column) -> Column:
    """A finite number, or null."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value), value)


def whole_id(x: Column) -> Column:
    """An id that came as a number, without its decimals: 10107.0 is 10107; other ids as they are."""
    value = x.try_cast("double")
    return F.when(value.isNotNull(), value.try_cast("bigint").cast("string")).otherwise(F.trim(x.cast("string")))


def day(x: Column) -> Column:
    text = x.cast("string")
    return F.coalesce(text.try_cast("date"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"), F.try_to_timestamp(text, F.lit("MM/dd/yyyy")).cast("date"), text.try_cast("timestamp").cast("date"))


def csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return spark.read.option("header", header).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)


def headerless(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """A table without a header; columns beyond the names keep _c0, _c1, ..."""
    df = csv(spark, path, header=False)
    return df.toDF(*names, *df.columns[len(names) :])


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """(t, asset, r): a long table, told by a column of returns and one of ids, is averaged over repeated (t, asset); of a
    wide one the first column is t.  Values that are no number are absent, and so are assets without any."""
    df = csv(spark, path)
    low = {c.lower() for c in df.columns}
    if low & set(RETURNS) and low & set(IDS):
        t = next((column(df, x) for x in DATES if x in low), df.columns[0])
        rows = df.select(q(t).alias("t"), q(column(df, *IDS)).cast("string").alias("asset"), number(q(column(df, *RETURNS))).alias("r"))
        return rows.where("t is not null and asset is not null").groupBy("t", "asset").agg(F.avg("r").alias("r")).where("r is not null")
    first, *assets = df.columns
    cells = df.select(q(first).alias("t"), F.explode(F.array(*(F.struct(F.lit(a).alias("asset"), number(q(a)).alias("r")) for a in assets))).alias("x"))
    return cells.select("t", "x.asset", "x.r").where("r is not null")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(t, asset, r) of a matrix whose rows are assets and whose columns are days named XYYYYMMDD; a missing value is 0."""
    df = csv(spark, path)
    first, *days = df.columns
    cells = df.select(q(first).cast("string").alias("asset"), F.explode(F.array(*(F.struct(F.lit(d.lstrip("X")).alias("d"), number(q(d)).alias("r")) for d in days))).alias("x"))
    return cells.select(F.to_date("x.d", "yyyyMMdd").alias("t"), "asset", F.coalesce("x.r", F.lit(0.0)).alias("r"))


def read_sectors(spark: SparkSession, path: str, sector: str | None = None) -> DataFrame:
    """(asset, sector): the first row of an asset by sector; ``sector`` names the column, else one of SECTORS."""
    df = csv(spark, path)
    chosen = sector if sector in df.columns else column(df, *SECTORS)
    rows = df.select(whole_id(q(column(df, *IDS, "lpermno"))).alias("asset"), q(chosen).alias("sector"))
    return rows.where("asset is not null and sector is not null").groupBy("asset").agg(F.min("sector").alias("sector"))


def read_series(spark: SparkSession, path: str, t: str = "t", value: str = "v") -> DataFrame:
    """(t, v) of the first and the last column; rows without a number or a day go."""
    df = csv(spark, path)
    rows = df.select(day(q(df.columns[0])).alias(t), number(q(df.columns[-1])).alias(value))
    return rows.where(F.col(t).isNotNull() & F.col(value).isNotNull())


def inside(facts: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``facts`` (asset, t, ...) within a window (asset, start, end) of their asset; an open end reaches OPEN_END."""
    m = members.select(F.col("asset").alias("__a"), "start", F.coalesce("end", F.lit(OPEN_END).cast("date")).alias("end"))
    return facts.join(m, (F.col("asset") == F.col("__a")) & F.col("t").between(F.col("start"), F.col("end"))).drop("__a", "start", "end")


def assemble(spark: SparkSession, returns: str, members: str | None = None, sectors: str | None = None) -> Bundle:
    """A bundle of up to three exports: returns, windows of membership, sectors; names of columns are found by meaning."""
    raw = csv(spark, returns)
    facts = raw.select(whole_id(q(column(raw, "permno"))).alias("asset"), day(q(column(raw, "date", "caldt", "datadate"))).alias("t"), number(q(column(raw, *RETURNS))).alias("r"))
    if members is not None:
        m = csv(spark, members)
        windows = m.select(whole_id(q(column(m, "permno"))).alias("asset"), day(q(column(m, *BEGINS))).alias("start"), day(F.when(~q(column(m, *ENDS)).isin("E", ""), q(column(m, *ENDS)))).alias("end"))
        facts = inside(facts, windows)
    panel = facts.groupBy("t", "asset").agg(F.avg("r").alias("r")).where("r is not null")
    return Bundle(panel, None if sectors is None else labelled(panel, read_sectors(spark, sectors)))


def labelled(panel: DataFrame, *chain: DataFrame, other: str = "OTHER") -> DataFrame:
    """(asset, sector) for every asset of the panel: from the first table of the chain that knows it, else ``other``."""
    out = panel.select("asset").distinct()
    for k, known in enumerate(chain):
        out = out.join(known.select("asset", F.col("sector").alias(f"s{k}")), "asset", "left")
    return out.select("asset", F.coalesce(*(F.col(f"s{k}").cast("string") for k in range(len(chain))), F.lit(other)).alias("sector"))


def cross_sector(edges: DataFrame, sectors: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The edges whose ends are known to be of one sector go; an end without a sector is of none."""
    s = sectors.select("asset", "sector")
    both = edges.join(s.toDF(src, "__a"), src, "left").join(s.toDF(dst, "__b"), dst, "left")
    return both.where("__a is null or __b is null or __a <> __b").select(*edges.columns)


def load(spark: SparkSession, kind: str, *paths: str, **options) -> Bundle:
    """One door to all sources: csv, matrix, exports, synthetic."""
    if kind == "csv":
        panel = read_panel(spark, paths[0])
        return Bundle(panel, labelled(panel, read_sectors(spark, paths[1], options.get("sector"))) if len(paths) > 1 else None)
    if kind == "matrix":
        panel = read_matrix(spark, paths[0])
        return Bundle(panel, labelled(panel, read_sectors(spark, paths[1], options.get("sector"))) if len(paths) > 1 else None)
    if kind == "exports":
        return assemble(spark, *paths)
    if kind == "synthetic":
        made = synthetic.lead_lag_panel(spark, **options)
        return Bundle(made.returns.select("t", "asset", "r"), made.returns.select("asset", "sector").distinct())
    raise ValueError(f"unknown source {kind!r}")


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """(name, format) of the tables of a folder: its Parquet and CSV files or folders."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(x.getPath().getName() for x in fs.listStatus(path))
    rows = [(n.rpartition(".")[0], n.rpartition(".")[2]) for n in found if n.endswith((".parquet", ".csv"))]
    return spark.createDataFrame(rows, "name string, format string")


def describe(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(position, column, type) of a table of the catalog."""
    kind = {r.name: r.format for r in catalog(spark, folder).collect()}[name]  # a row a file
    path = f"{folder}/{name}.{kind}"
    df = spark.read.parquet(path) if kind == "parquet" else csv(spark, path)
    return spark.createDataFrame([(k, f.name, f.dataType.simpleString()) for k, f in enumerate(df.schema)], "position int, column string, type string")


def markdown(df: DataFrame, path: str, title: str, limit: int = 1000) -> str:
    """Write a short result as a report; a table of more than ``limit`` rows is none."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    said = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(said, r)) + " |" for r in rows)]
    text = "\n".join(lines) + "\n"
    spark = df.sparkSession
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text
