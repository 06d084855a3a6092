"""Ranks, rank correlation, overlap of leaders, multiplicity control."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize


def average_rank(column: str, by: list[str] | None = None):
    """Ranks from 1, ties sharing their mean."""
    parts = by or []
    w = Window.partitionBy(*parts).orderBy(column) if parts else Window.orderBy(column)
    ties = Window.partitionBy(*parts, column)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


#: Ranges that a whole column is dealt to for its ranks.
RANGES = 64


def _range(df: DataFrame, column: str):
    """How many of the approximate quantiles a value reaches."""
    cuts = sorted(set(df.approxQuantile(column, [k / RANGES for k in range(1, RANGES)], 0.005)))
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(column))) if cuts else F.lit(0)


def average_ranks(df: DataFrame, names: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """``df`` with average ranks {name: column}.  Without ``by`` no task has a whole column: values are dealt to ranges by
    approximate quantiles, ranked within a range, and what stands in the ranges before is added."""
    if by:
        return df.withColumns({name: average_rank(column, by) for name, column in names.items()})
    for name, column in names.items():
        df = df.withColumn("__range", _range(df, column))
        held = df.groupBy("__range").agg(F.count("*").alias("__n"))
        before = held.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row a range
        df = df.withColumn(name, average_rank(column, ["__range"])).join(before, "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")
    return df


def guarded_corr(x, y):
    """Pearson correlation of rows where both are there; null without variance."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    vx, vy = F.var_pop(x), F.var_pop(y)
    return F.when((vx > 0) & (vy > 0), F.try_divide(F.covar_pop(x, y), F.sqrt(vx * vy)))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """One row (for each group): rho over the rows where both are there, and how many; null for fewer than three or without variance."""
    by = by or []
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    d = average_ranks(rows, {"__a": "__x", "__b": "__y"}, by)
    rho = F.when(F.count("*") >= 3, guarded_corr(F.col("__a"), F.col("__b")))
    return d.groupBy(*by).agg(rho.alias("rho"), F.count("*").alias("n"))


def summary(df: DataFrame, x: str, by: list[str], periods: int) -> DataFrame:
    """(*by, n, mean, t, sharpe, wins, low, high) of a series: deviations are those of the population for t and Sharpe, of the sample for the interval mean +- 1.96 sd / sqrt(n)."""
    n, mean, sd, wide = F.count(x), F.avg(x), F.stddev_pop(x), 1.96 * F.stddev_samp(x) / F.sqrt(F.count(x))
    wins = F.avg((F.col(x) > 0).cast("double"))
    return df.groupBy(*by).agg(
        n.alias("n"), mean.alias("mean"), F.try_divide(mean, sd / F.sqrt(n)).alias("t"), (F.try_divide(mean, sd) * math.sqrt(periods)).alias("sharpe"), wins.alias("wins"), (mean - wide).alias("low"), (mean + wide).alias("high"),
    )


def residuals(df: DataFrame, columns: list[str], controls: list[str]) -> DataFrame:
    """``df`` with each column replaced by what a least-squares fit on the controls and a constant leaves of it."""
    fresh = {c: f"__{k}" for k, c in enumerate(controls)}
    df = df.withColumns({new: F.col(c).cast("double") for c, new in fresh.items()})
    done: list[str] = []
    for name in [*fresh.values(), *columns]:  # Gram and Schmidt: controls first, each without those before it
        for basis in [None, *done]:
            fit = df.agg(F.avg(name).alias("__b")) if basis is None else df.agg(F.coalesce(F.when(F.sum(F.col(basis) ** 2) > 1e-20, F.sum(F.col(name) * F.col(basis)) / F.sum(F.col(basis) ** 2)), F.lit(0.0)).alias("__b"))
            df = df.crossJoin(F.broadcast(fit)).withColumn(name, F.col(name) - F.col("__b") * (F.lit(1.0) if basis is None else F.col(basis))).drop("__b")  # one row
        if name in fresh.values():
            done.append(name)
    return df.drop(*fresh.values())


def partial_spearman(df: DataFrame, x: str, y: str, *controls: str) -> DataFrame:
    """One row: rank correlation of what linear fits on the controls leave of x and y."""
    d = df.where(" and ".join(f"{c} is not null" for c in (x, y, *controls))).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *(F.col(c).alias(f"z{k}") for k, c in enumerate(controls)))
    left = materialize(residuals(d, ["x", "y"], [f"z{k}" for k in range(len(controls))]).select(F.round("x", 9).alias("x"), F.round("y", 9).alias("y")), "residuals")
    return spearman(left, "x", "y")


def r_squared(y, x1, x2):
    """Share of y's variance that two regressors and a constant explain; 1 where y has none."""
    a, b, c = (F.coalesce(guarded_corr(p, q), F.lit(0.0)) for p, q in ((y, x1), (y, x2), (x1, x2)))
    two = (a * a + b * b - 2 * a * b * c) / F.when(1 - c * c > 1e-9, 1 - c * c)
    return F.when(F.var_pop(y) > 0, F.coalesce(two, F.greatest(a * a, b * b))).otherwise(1.0)


def topk_jaccard(df: DataFrame, x: str, y: str, keys: list[str], k: float) -> DataFrame:
    """One row: overlap of the k smallest by x and by y over their union; k up to 1 is a share of all rows, so 1 means all."""
    n = df.count() if 0 < k <= 1 else 0
    size = max(1, math.ceil(k * n)) if 0 < k <= 1 else int(k)
    top = lambda c, name: df.orderBy(F.col(c).asc_nulls_last(), *keys).limit(size).select(*keys, F.lit(1).alias(name))
    d = top(x, "a").join(top(y, "b"), keys, "full")
    return d.agg(F.coalesce(F.try_divide(F.sum(F.col("a") * F.col("b")).cast("double"), F.count("*")), F.lit(0.0)).alias("jaccard"))


def benjamini_hochberg(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """``df`` with p_adj and reject: the least of p n / rank over this and larger p.

    Ranks count ties at their last place; ranges of values are ranked and minimised apart, then joined by a row a range.
    """
    d = df.withColumn("__range", _range(df, p))
    upward = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    held = d.groupBy("__range").agg(F.count("*").alias("__n"))
    held = held.select("__range", F.coalesce(F.sum("__n").over(upward), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    at = Window.partitionBy("__range")
    last = F.count("*").over(at.orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
    d = d.join(held, "__range").withColumn("__raw", F.least(F.lit(1.0), F.col(p) * F.col("__all") / (F.col("__before") + last)))
    d = d.withColumn("__here", F.min("__raw").over(at.orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, 0)))
    later = d.groupBy("__range").agg(F.min("__raw").alias("__least")).select("__range", F.min("__least").over(Window.orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("__later"))
    d = d.join(later, "__range").withColumn("p_adj", F.least("__here", F.coalesce("__later", F.lit(1.0))))
    return d.withColumn("reject", F.col("p_adj") <= alpha).select(*df.columns, "p_adj", "reject")


#: ln n! of the first sixteen n.
_SMALL = [math.lgamma(n + 1) for n in range(16)]


def log_factorial(n):
    """ln n!, by Stirling's series from 16 on: exact to 1e-13."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n < 16, F.element_at(F.array(*map(F.lit, _SMALL)), (F.greatest(F.least(n, F.lit(15)), F.lit(0)) + 1).cast("int"))).otherwise(series)


def _log_choose(n, k):
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric_tail(hits, drawn, marked, of):
    """Chance of as many hits or more among ``drawn`` of ``of``, ``marked`` of which count."""
    total = _log_choose(of, drawn)
    term = lambda x: F.exp(_log_choose(marked, x) + _log_choose(of - marked, drawn - x) - total)
    first, last = F.greatest(hits, drawn + marked - of), F.least(drawn, marked)
    xs = F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(F.transform(xs, term), F.lit(0.0), lambda acc, x: acc + x)
