"""Directed lead-lag graphs: lagged correlation, sparsification, edge curvature, triangles.

Pairs of assets at a lag come from products of blocks (``gram``); all else is grouped sums and equi-joins on vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .gram import moments, pair_sums

#: A variance under this share of the mean square is none.
TINY = 1e-12
LAGS = (1, 2, 3, 5)


def lagged_correlation(panel: DataFrame, lags: tuple[int, ...] = LAGS, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, lag, i, j, c): Pearson correlation of asset i with asset j ``lag`` later; 0 without variance or with missing values."""
    if any(k < 1 for k in lags):
        raise ValueError("lags start at 1")
    sums = pair_sums(panel, tuple(lags), by).where("i <> j")
    n = F.col("n")
    cov, vx, vy = moments(n)
    whole = (F.col("nx") == n) & (F.col("ny") == n) & (F.col("sxx") > 0) & (F.col("syy") > 0) & (vx > TINY * F.col("sxx") / n) & (vy > TINY * F.col("syy") / n)
    c = F.when(whole, F.try_divide(cov, F.sqrt(vx * vy))).otherwise(F.lit(0.0))
    return sums.select(*by, "lag", "i", "j", F.coalesce(c, F.lit(0.0)).alias("c"))


def signed_lead_lag(correlation: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, i, j, w, lag) for i < j: the antisymmetric part at the lag where it is largest, the first such lag on ties."""
    gain = F.when(F.col("i") < F.col("j"), F.col("c")).otherwise(-F.col("c"))
    both = correlation.groupBy(*by, "lag", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.round(F.sum(gain), 9).alias("s"), F.count("*").alias("n"))
    s = both.where("n = 2").select(*by, "lag", F.col("a").alias("i"), F.col("b").alias("j"), "s")
    best = F.max_by(F.struct("s", "lag"), F.struct(F.abs("s"), -F.col("lag")))
    return s.groupBy(*by, "i", "j").agg(best.alias("x")).select(*by, "i", "j", F.col("x.s").alias("w"), F.col("x.lag").alias("lag"))


def sparsify(pairs: DataFrame, mode: str = "quantile", threshold: float = 0.9, min_abs: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, src, dst, weight, signed, lag): pairs strictly above the cut, from the leader to the lagger."""
    if mode == "quantile":
        cut = pairs.groupBy(*by).agg(F.percentile(F.abs("w"), F.lit(threshold)).alias("cut"))
        kept = pairs.join(cut, list(by)) if by else pairs.crossJoin(F.broadcast(cut))  # one row
    elif mode in ("absolute", "none"):
        kept = pairs.withColumn("cut", F.lit(float(threshold if mode == "absolute" else min_abs)))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    kept = kept.where((F.abs("w") > F.greatest("cut", F.lit(min_abs))) & (F.col("w") != 0))
    ahead = F.col("w") > 0
    return kept.select(
        *by, F.when(ahead, F.col("i")).otherwise(F.col("j")).alias("src"), F.when(ahead, F.col("j")).otherwise(F.col("i")).alias("dst"), F.abs("w").alias("weight"), F.col("w").alias("signed"), "lag"
    )


def positive(weight):
    """The weight; a plan fails where it isn't positive."""
    return F.when(weight > 0, weight).otherwise(F.raise_error(F.lit("edge weights must be positive")).cast("double"))


def forman_undirected(edges: DataFrame, weighted: bool = True, name: str = "f") -> DataFrame:
    """``edges`` with 4 - sqrt(w) (S[src] + S[dst]), S the sum of w^-1/2 at a vertex."""
    w = positive(F.col("weight")) if weighted else F.lit(1.0)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v"), (1 / F.sqrt(w)).alias("h"))
    at = ends.groupBy("v").agg(F.sum("h").alias("s"))
    e = edges.join(at.toDF("src", "s_src"), "src").join(at.toDF("dst", "s_dst"), "dst")
    return e.withColumn(name, 4 - F.sqrt(w) * (F.col("s_src") + F.col("s_dst"))).select(*edges.columns, name)


def forman(edges: DataFrame, weighted: bool = True, flow: str = "bottleneck", name: str = "f") -> DataFrame:
    """``edges`` with the directed Forman curvature: 2 - sqrt(w) (I[src] + O[dst] - 2 w_rev^-1/2), or through flow: 4 - sqrt(w) (O[src] + I[dst])."""
    if flow not in ("bottleneck", "through"):
        raise ValueError(f"unknown flow {flow!r}")
    w = positive(F.col("weight")) if weighted else F.lit(1.0)
    half = edges.select("src", "dst", (1 / F.sqrt(w)).alias("h"))
    into = half.groupBy(F.col("dst").alias("v")).agg(F.sum("h").alias("into"))
    out = half.groupBy(F.col("src").alias("v")).agg(F.sum("h").alias("out"))
    root = F.sqrt(w)
    if flow == "through":
        e = edges.join(out.withColumnRenamed("v", "src"), "src", "left").join(into.withColumnRenamed("v", "dst"), "dst", "left")
        value = 4 - root * (F.coalesce("out", F.lit(0.0)) + F.coalesce("into", F.lit(0.0)))
        return e.withColumn(name, value).select(*edges.columns, name)
    back = half.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("h").alias("rev"))
    e = edges.join(into.withColumnRenamed("v", "src"), "src", "left").join(out.withColumnRenamed("v", "dst"), "dst", "left").join(back, ["src", "dst"], "left")
    value = 2 - root * (F.coalesce("into", F.lit(0.0)) + F.coalesce("out", F.lit(0.0)) - 2 * F.coalesce("rev", F.lit(0.0)))
    return e.withColumn(name, value).select(*edges.columns, name)


def triangles(edges: DataFrame, mode: str = "common", name: str = "m") -> DataFrame:
    """``edges`` with the number of triangles at each: common neighbours without direction, or directed 3-cycles."""
    if mode == "common":
        adj = edges.select("src", "dst").union(edges.select("dst", "src")).distinct().toDF("a", "x")
        wedge = edges.select("src", "dst").join(adj.toDF("src", "x"), "src").join(adj.toDF("dst", "x"), ["dst", "x"])
    elif mode == "cyclic":
        e = edges.select("src", "dst").distinct()
        wedge = edges.select("src", "dst").join(e.toDF("dst", "x"), "dst").join(e.toDF("x", "src"), ["x", "src"])
    else:
        raise ValueError(f"unknown mode {mode!r}")
    found = wedge.groupBy("src", "dst").agg(F.count("*").alias(name))
    return edges.join(found, ["src", "dst"], "left").fillna(0, [name]).select(*edges.columns, name)


def measures(edges: DataFrame, alpha: float = 0.0) -> DataFrame:
    """(x, v, mass) of every vertex with an edge: ``alpha`` stays, the rest goes to the neighbours by weight, without direction."""
    both = edges.select(F.col("src").alias("x"), F.col("dst").alias("v"), "weight").union(edges.select("dst", "src", "weight")).groupBy("x", "v").agg(F.max("weight").alias("weight"))
    total = both.groupBy("x").agg(F.sum("weight").alias("total"))
    away = both.join(total, "x").select("x", "v", ((1 - alpha) * F.col("weight") / F.col("total")).alias("mass"))
    return away.union(total.select("x", F.col("x").alias("v"), F.lit(float(alpha)).alias("mass"))) if alpha > 0 else away


def four_objects(edges: DataFrame) -> DataFrame:
    """Plain, weighted and augmented curvature and the triangles of every edge."""
    e = triangles(forman(forman(edges, False, name="f_plain"), True, name="f_weighted"))
    return e.withColumn("f_augmented", F.col("f_weighted") + 3 * F.col("m"))


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, n_in, n_out) of all vertices, isolated ones, too."""
    into = edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("n_in"))
    out = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n_out"))
    return vertices.join(into, "v", "left").join(out, "v", "left").fillna(0, ["n_in", "n_out"])


def line_graph(edges: DataFrame) -> DataFrame:
    """(src, dst, src2, dst2, weight): pairs of edges that share an endpoint, each once, weight sqrt(w1 w2)."""
    ends = edges.select("src", "dst", "weight", F.explode(F.array("src", "dst")).alias("v"))
    other = ends.select(F.col("src").alias("src2"), F.col("dst").alias("dst2"), F.col("weight").alias("w2"), "v")
    pairs = ends.join(other, "v").where((F.col("src") < F.col("src2")) | ((F.col("src") == F.col("src2")) & (F.col("dst") < F.col("dst2"))))
    return pairs.select("src", "dst", "src2", "dst2", F.sqrt(F.col("weight") * F.col("w2")).alias("weight")).distinct()


def node_mean(edges: DataFrame, value: str) -> DataFrame:
    """(v, curvature): the mean over the edges at a vertex, in either direction."""
    return edges.select(F.explode(F.array("src", "dst")).alias("v"), value).groupBy("v").agg(F.avg(value).alias("curvature"))


def clustering(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, c): triangles at a vertex over pairs of its neighbours, without direction; 0 below two neighbours."""
    one = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    at = triangles(one).select(F.explode(F.array("src", "dst")).alias("v"), "m").groupBy("v").agg(F.sum("m").alias("twice"), F.count("*").alias("d"))
    c = F.when(F.col("d") >= 2, F.col("twice") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    return vertices.join(at, "v", "left").select("v", F.coalesce(c, F.lit(0.0)).alias("c"))


def triangle_density(edges: DataFrame, labels: DataFrame, zero_warn: float = 0.5, within_warn: float = 0.25) -> DataFrame:
    """One row: share of edges without a triangle, mean and median, triangles in all and within a label, clustering within labels, and a flag.

    ``labels`` is (v, label) of every vertex.  Without edges the share without a triangle is 1.
    """
    e = triangles(edges.select("src", "dst"))
    inside = edges.join(labels.toDF("src", "la"), "src").join(labels.toDF("dst", "lb"), "dst").where("la = lb").select("src", "dst")
    c = labels.join(clustering(inside, labels.select("v")), "v").groupBy("label").agg(F.avg("c").alias("c")).agg(F.avg("c").alias("clustering"))
    whole = e.agg(
        F.count("*").alias("n_edges"), F.coalesce(F.avg((F.col("m") == 0).cast("double")), F.lit(1.0)).alias("zero"), F.coalesce(F.avg("m"), F.lit(0.0)).alias("mean_m"),
        F.coalesce(F.percentile("m", F.lit(0.5)), F.lit(0.0)).alias("median_m"), F.coalesce(F.sum("m") / 3, F.lit(0.0)).cast("long").alias("n_triangles"),
    )
    within = triangles(inside).agg(F.coalesce(F.sum("m") / 3, F.lit(0.0)).alias("n_within"))
    share = F.coalesce(F.try_divide("n_within", "n_triangles"), F.lit(0.0))
    row = whole.crossJoin(F.broadcast(within)).crossJoin(F.broadcast(c))  # one row each
    row = row.withColumn("within", share).withColumn("sparse", (F.col("zero") > zero_warn) | (F.col("within") < within_warn))
    return row.select("n_edges", "zero", "mean_m", "median_m", "n_triangles", "within", "clustering", "sparse")


def curvature_gap(edges: DataFrame, labels: DataFrame, value: str = "f_augmented") -> DataFrame:
    """One row: (mean within labels - mean across) / pooled deviation; null where a side has no edge, divided by 1 without variance."""
    e = edges.join(labels.toDF("src", "la"), "src").join(labels.toDF("dst", "lb"), "dst").select(F.col(value).alias("x"), (F.col("la") == F.col("lb")).alias("same"))
    a, b = F.when(F.col("same"), F.col("x")), F.when(~F.col("same"), F.col("x"))
    pooled = F.when((F.count(a) > 1) & (F.count(b) > 1), F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)).otherwise(F.stddev_pop("x"))
    gap = F.when((F.count(a) > 0) & (F.count(b) > 0), (F.avg(a) - F.avg(b)) / F.when(pooled > 0, pooled).otherwise(1.0))
    return e.agg(gap.alias("gap"), F.avg(a).alias("within"), F.avg(b).alias("across"), F.count(a).alias("n_within"), F.count(b).alias("n_across"))


def modularity(edges: DataFrame, labels: DataFrame, weighted: bool = True) -> DataFrame:
    """One row: sum over labels of L/m - (d/2m)^2, without direction, by weight unless told otherwise."""
    e = edges.select("src", "dst", (F.col("weight") if weighted else F.lit(1.0)).alias("w")).join(labels.toDF("src", "la"), "src").join(labels.toDF("dst", "lb"), "dst")
    total = e.agg(F.sum("w").alias("total"))
    each = e.select(F.explode(F.array("la", "lb")).alias("label"), "w", (F.col("la") == F.col("lb")).cast("int").alias("same")).groupBy("label").agg(F.sum("w").alias("d"), (F.sum(F.col("same") * F.col("w")) / 2).alias("inside"))
    part = F.col("inside") / F.col("total") - F.pow(F.col("d") / (2 * F.col("total")), F.lit(2))
    return each.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("q"))


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex that each reaches without direction.

    Least labels over neighbours, then over the label's own label, so long chains halve in each round; every round is
    written, so no plan grows.
    """
    one = edges.select("src", "dst")
    both = materialize(one.union(one.select("dst", "src")).toDF("v", "x").distinct(), "adjacent")
    labels = materialize(vertices.select("v", F.col("v").alias("root")), "labels")
    while True:
        near = both.join(labels.toDF("x", "other"), "x").groupBy("v").agg(F.min("other").alias("least"))
        step = labels.join(near, "v", "left").select("v", F.col("root").alias("was"), F.least("root", "least").alias("root"))
        jump = step.select(F.col("v").alias("root"), F.col("root").alias("up"))
        new = materialize(step.join(jump, "root", "left").select("v", "was", F.coalesce("up", "root").alias("root")), "labels")
        labels = new.select("v", "root")
        if new.where("was <> root").isEmpty():
            return labels
