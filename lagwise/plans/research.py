"""Queries of validation, selection, resamples and rolling studies over the fixture tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import graphs, residuals, signals, windows
from ..sources import files, panels
from ..sources.scratch import materialize
from .studies import _edges, _panel, _r

WIDTH, STEP = 63, 21
#: Resamples of edges and of information coefficients.
BOOTS, IC_BOOTS = 25, 100


def _nodes(panel: DataFrame) -> DataFrame:
    return panel.select(F.col("asset_idx").alias("v"), F.col("sector").alias("label")).distinct()


def _four(spark, d, q=0.7) -> DataFrame:
    return materialize(graphs.four_objects(_edges(spark, d, q)), "four")


def _lead(panel: DataFrame, q: float, by: tuple[str, ...] = ()) -> DataFrame:
    pairs = materialize(graphs.signed_lead_lag(graphs.lagged_correlation(panel, by=by), by), "pairs")
    return materialize(graphs.sparsify(pairs, "quantile", q, by=by), "edges")


def panel_pivot_avg(spark, d):
    o, c, n, r = (panels.table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    regions = sorted(x.r_name for x in r.select("r_name").distinct().collect())  # a dimension: its names become columns
    names = [x.lower().replace(" ", "_") for x in regions]
    wide = rows.groupBy(F.year("o_orderdate").alias("y")).pivot("r_name", regions).agg(F.avg("o_totalprice"))
    return _r(wide.toDF("y", *names), *names)


def panel_unpivot(spark, d):
    wide = panel_pivot_avg(spark, d)
    return wide.unpivot(["y"], wide.columns[1:], "region", "v").where("v is not null")


def bars_volume(spark, d):
    return _r(panels.bars(panels.table(spark, d, "events"), 30).select("asset", "bar", "volume", "n"), "volume")


def effective_link_join(spark, d):
    o = panels.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("start"))
    along = Window.partitionBy("o_custkey").orderBy("start", "o_orderkey")
    links = o.withColumn("end", F.date_sub(F.lead("start").over(along), 1)).select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("link"), "start", "end")
    item = panels.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))
    facts = item.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return panels.membership(facts.withColumnRenamed("o_custkey", "key"), links, "key", "day").select("l_orderkey", "l_linenumber", "link")


def name_normalize(spark, d):
    return panels.table(spark, d, "part").select("p_partkey", panels.normalized(F.concat_ws(" ", "p_name", F.lit("Corp. CL A"))).alias("name"))


def fuzzy_contains_join(spark, d):
    """Names matched with the first word, in the order of the parts it stands on, that holds them or that they hold."""
    part = panels.table(spark, d, "part")
    names = part.select(panels.normalized(F.col("p_name")).alias("name")).distinct()
    words = part.select(F.explode(F.split(F.upper("p_name"), " ")).alias("word"), "p_partkey").groupBy("word").agg(F.min("p_partkey").alias("at"))
    return panels.contained(names, words, "name", "word", "at").select("name", "word")


def resid_market_sector(spark, d):
    return _r(residuals.residualize(_panel(spark, d), "market_sector").select("t", "asset", "r"), "r")


def resid_factors(spark, d):
    p = _panel(spark, d)
    f = p.groupBy("t").agg(F.avg(F.when(F.col("sector") == "ASIA", F.col("r"))).alias("f1"), F.avg(F.when(F.col("sector") == "EUROPE", F.col("r"))).alias("f2"))
    return _r(residuals.on_two_factors(p, f).select("t", "asset", "r"), "r")


def resid_pca(spark, d):
    return _r(residuals.principal(_panel(spark, d), 3).select("t", "asset", "r"), "r")


def lagged_corr_grouped(spark, d):
    p = _panel(spark, d).withColumn("grp", F.floor(F.col("t") / 10))
    return _r(signals.grouped_lagged_correlation(p, (1, 2)), "c")


def forman_plain(spark, d):
    return _r(graphs.forman(_edges(spark, d), False).select("src", "dst", "f"), "f")


def forman_weighted(spark, d):
    return _r(graphs.forman(_edges(spark, d)).select("src", "dst", "f"), "f")


def forman_undirected(spark, d):
    return _r(graphs.forman_undirected(_edges(spark, d)).select("src", "dst", "f"), "f")


def triangles_common(spark, d):
    return graphs.triangles(_edges(spark, d)).select("src", "dst", "m")


def forman_augmented(spark, d):
    return _r(_four(spark, d).select("src", "dst", "f_augmented"), "f_augmented")


def corr_graph_forman(spark, d):
    e = signals.correlation(_panel(spark, d)).where("abs(c) > 0.2").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1.0).alias("weight"))
    return _r(graphs.forman_undirected(materialize(e, "edges"), False).select("src", "dst", "f"), "f")


def node_curvature(spark, d):
    return _r(graphs.node_mean(_four(spark, d), "f_augmented"), "curvature")


def clustering_coeff(spark, d):
    p = _panel(spark, d)
    return _r(graphs.clustering(_lead(p, 0.7), _nodes(p).select("v")), "c")


def triangle_density(spark, d):
    p = _panel(spark, d)
    return _r(graphs.triangle_density(_lead(p, 0.7), materialize(_nodes(p), "nodes")), "zero", "mean_m", "median_m", "within", "clustering")


def density_sweep(spark, d):
    p = _panel(spark, d)
    pairs = materialize(graphs.signed_lead_lag(graphs.lagged_correlation(p)), "pairs")
    one = lambda q: graphs.triangles(materialize(graphs.sparsify(pairs, "quantile", q), "edges")).agg(F.lit(q).alias("q"), F.count("*").alias("n_edges"), F.avg((F.col("m") == 0).cast("double")).alias("zero"), F.avg("m").alias("mean_m"))
    return _r(reduce(DataFrame.unionByName, map(one, (0.7, 0.8, 0.9))), "zero", "mean_m")


def curvature_gap(spark, d):
    return _r(graphs.curvature_gap(_four(spark, d), materialize(_nodes(_panel(spark, d)), "nodes")), "gap", "within", "across")


def modularity_by_region(spark, d):
    return _r(graphs.modularity(_edges(spark, d), materialize(_nodes(_panel(spark, d)), "nodes")), "q")


def components_after_cut(spark, d):
    p = _panel(spark, d)
    e = graphs.forman(_lead(p, 0.7), False).where("f >= -5")
    return graphs.components(e, _nodes(p).select("v"))


def edge_abs_corr(spark, d):
    p = _panel(spark, d)
    e = _lead(p, 0.9).select("src", "dst", F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"))
    return _r(e.join(signals.correlation(p), ["i", "j"]).select("src", "dst", F.abs("c").alias("abs_rho")), "abs_rho")


def resid_orthogonalization(spark, d):
    e = _four(spark, d)
    rows = e.join(e.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("a")), "src", "left").join(e.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("b")), "dst", "left").fillna(0, ["a", "b"])
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    wide = rows.agg(*(ranks.r_squared(F.col(c), a, b).alias(c) for c in ("f_plain", "f_weighted", "f_augmented")))
    out = wide.unpivot([], ["f_plain", "f_weighted", "f_augmented"], "object", "r2")
    return _r(out.withColumn("degree_identity", F.col("r2") > 0.999), "r2")


def bh_adjust(spark, d):
    e = _edges(spark, d, 0.9).select("src", "dst", F.round(1 / (1 + 200 * F.col("weight")), 6).alias("p"))
    return _r(ranks.benjamini_hochberg(e, "p"), "p", "p_adj")


def walk_forward_windows(spark, d):
    w = windows.walk_forward(_panel(spark, d), 104, 26, 26)
    return w.select("wid", *(F.col(c).cast("long").alias(c) for c in ("start", "end", "test_end")))


def _train(spark, d):
    train, test = signals.split(_panel(spark, d))
    train, test = materialize(train, "train"), materialize(test, "test")
    return train, test, materialize(graphs.lagged_correlation(train), "lagged")


def _top_corr(train: DataFrame, k: int) -> DataFrame:
    rows = signals.correlation(train).select(F.col("i").alias("a"), F.col("j").alias("b"), F.round(F.abs("c"), 9).alias("s"))
    return rows.orderBy(F.desc_nulls_last("s"), "a", "b").limit(k)


def _correlated(spark, d, k=20):
    train, test, lagged = _train(spark, d)
    return train, test, materialize(signals.orient(_top_corr(train, k).select("a", "b"), lagged), "oriented")


def _by_curvature(lagged: DataFrame, k: int) -> DataFrame:
    e = materialize(graphs.sparsify(materialize(graphs.signed_lead_lag(lagged), "pairs"), "quantile", 0.7), "edges")
    f = graphs.four_objects(e).withColumn("f", F.round("f_augmented", 9))
    return f.orderBy("f", "src", "dst").limit(k).select(F.col("src").alias("leader"), F.col("dst").alias("lagger"), "lag")


def select_curvature(spark, d):
    return _by_curvature(_train(spark, d)[2], 20)


def select_correlation(spark, d):
    return _correlated(spark, d)[2].select("leader", "lagger", "lag")


def orient_pairs(spark, d):
    _, _, lagged = _train(spark, d)
    every = lagged.where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b")).distinct()
    return signals.orient(every, lagged).select("leader", "lagger", "lag")


def select_undirected(spark, d):
    """The lower position leads, whatever the data say."""
    train, _, _ = _train(spark, d)
    e = materialize(signals.correlation(train).where("abs(c) > 0.15").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1.0).alias("weight")), "edges")
    f = graphs.forman_undirected(e, False)
    return f.orderBy("f", "src", "dst").limit(20).select(F.col("src").alias("leader"), F.col("dst").alias("lagger"))


def select_random(spark, d):
    """A fixed hash of the pair stands in for chance, so that runs agree."""
    _, _, lagged = _train(spark, d)
    every = lagged.where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b")).distinct()
    some = every.orderBy(F.md5(F.concat_ws("-", "a", "b").cast("binary")), "a", "b").limit(20)
    return signals.orient(some, lagged).select("leader", "lagger", "lag")


def directional_ic(spark, d):
    train, test, pairs = _correlated(spark, d)
    return _r(signals.pair_ic(_steady(signals.forecasts(train, test, pairs))), "ic")


def _steady(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(F.col(c), 9) for c in ("fore", "real")})


def directional_ic_grouped(spark, d):
    train, test, pairs = _correlated(spark, d)
    days = test.withColumn("grp", F.floor(F.col("t") / 10))
    return _r(signals.pair_ic(_steady(signals.forecasts(train, days, pairs, ("grp",)))), "ic")


def pooled_ic(spark, d):
    train, test, pairs = _correlated(spark, d)
    return _r(ranks.spearman(_steady(signals.forecasts(train, test, pairs)), "fore", "real"), "rho")


def mean_reversion_pnl(spark, d):
    _, test, pairs = _correlated(spark, d)
    return _r(signals.mean_reversion(test, pairs, 1.0, 10), "sharpe", "mean_daily")


def bootstrap_edges(spark, d):
    boots = materialize(windows.blocks(_panel(spark, d), BOOTS, 20), "boots")
    return _lead(boots, 0.9, ("boot",)).groupBy("src", "dst").agg((F.count("*") / BOOTS).alias("share"))


def bootstrap_rank_stability(spark, d):
    """Mean of the rank correlations of curvature over the edges that two resamples share."""
    boots = materialize(windows.blocks(_panel(spark, d), BOOTS, 20), "boots")
    f = materialize(_plain_by(_lead(boots, 0.7, ("boot",)), "boot").withColumn("f", F.round("f", 9)), "curvature")
    both = f.select("src", "dst", F.col("boot").alias("x"), F.col("f").alias("fx")).join(f.select("src", "dst", F.col("boot").alias("y"), F.col("f").alias("fy")), ["src", "dst"]).where("x < y")
    return _r(ranks.spearman(both, "fx", "fy", ["x", "y"]).select("x", "y", "rho", "n"), "rho")


def bootstrap_ic(spark, d):
    train, test, pairs = _correlated(spark, d)
    first = test.agg(F.min("t").alias("first"))
    shifted = test.crossJoin(F.broadcast(first)).withColumn("t", F.col("t") - F.col("first")).drop("first")  # one row
    boots = materialize(windows.blocks(shifted, IC_BOOTS, 10), "boots")
    rows = _steady(_boot_forecasts(train, boots, pairs))
    ic = signals.pair_ic(rows.withColumn("lag", F.struct("boot", "lag"))).groupBy("lag.boot").agg(F.avg("ic").alias("ic"))
    return _r(ic.agg(F.avg("ic").alias("mean_ic"), F.percentile("ic", F.lit(0.025)).alias("low"), F.percentile("ic", F.lit(0.975)).alias("high")), "mean_ic", "low", "high")


def _boot_forecasts(train: DataFrame, boots: DataFrame, pairs: DataFrame) -> DataFrame:
    rows = signals._shifted(boots, pairs, ("boot",)).join(signals.signs(train, pairs), ["leader", "lagger", "lag"])
    return rows.select("boot", "leader", "lagger", "lag", (F.col("sign") * F.col("x")).alias("fore"), F.col("y").alias("real"))


def _plain_by(edges: DataFrame, key: str) -> DataFrame:
    """Weighted directed curvature of the edges of each window or resample; lead-lag graphs have no reverse edges."""
    half = edges.select(key, "src", "dst", (1 / F.sqrt("weight")).alias("h"))
    into = half.groupBy(key, F.col("dst").alias("src")).agg(F.sum("h").alias("into"))
    out = half.groupBy(key, F.col("src").alias("dst")).agg(F.sum("h").alias("out"))
    rows = edges.join(into, [key, "src"], "left").join(out, [key, "dst"], "left").fillna(0.0, ["into", "out"])
    return rows.withColumn("f", 2 - F.sqrt("weight") * (F.col("into") + F.col("out"))).select(key, "src", "dst", "lag", "weight", "signed", "f")


def _rolling(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = _panel(spark, d)
    w = materialize(windows.trailing(p, WIDTH, STEP, STEP), "windows")
    return p, w, materialize(windows.within(p, w), "windowed")


def _market(p: DataFrame) -> DataFrame:
    return materialize(p.groupBy("t").agg(F.avg("r").alias("m")), "market")


def _vol(market: DataFrame, w: DataFrame, begin: str, end: str, name: str) -> DataFrame:
    return windows.within(market, w, begin, end).groupBy("wid").agg(F.stddev_samp("m").alias(name))


def _corr_curvature(rows: DataFrame) -> DataFrame:
    """(wid, curv_corr, n_edges): mean of 4 - degree - degree over the pairs with |rho| above 0.2."""
    e = materialize(signals.correlation(rows, ("wid",)).where("abs(c) > 0.2").select("wid", "i", "j"), "edges")
    deg = e.select("wid", F.explode(F.array("i", "j")).alias("v")).groupBy("wid", "v").agg(F.count("*").alias("d"))
    f = e.join(deg.toDF("wid", "i", "di"), ["wid", "i"]).join(deg.toDF("wid", "j", "dj"), ["wid", "j"])
    return f.groupBy("wid").agg(F.avg(4 - F.col("di") - F.col("dj")).alias("curv_corr"), F.count("*").alias("n_edges"))


def roll_curv_vol(spark, d):
    p, w, rows = _rolling(spark, d)
    m = _market(p)
    lead = _plain_by(_lead(rows, 0.9, ("wid",)), "wid").groupBy("wid").agg(F.avg("f").alias("curv_ll"))
    out = _corr_curvature(rows).join(lead, "wid").join(_vol(m, w, "start", "end", "vol_now"), "wid").join(_vol(m, w, "end", f"end + {STEP}", "vol_fwd"), "wid")
    return _r(out, "curv_corr", "curv_ll", "vol_now", "vol_fwd")


def roll_partial_spearman(spark, d):
    """Curvature with later volatility, without what a linear fit on the present volatility explains."""
    out = materialize(roll_curv_vol(spark, d), "rolled")
    return _r(ranks.partial_spearman(out, "curv_ll", "vol_fwd", "vol_now"), "rho")


def roll_drawdown(spark, d):
    p, w, _ = _rolling(spark, d)
    along = Window.partitionBy("wid").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    level = windows.within(_market(p), w, "end", f"end + {STEP}").withColumn("level", F.exp(F.sum("m").over(along)))
    return _r(level.withColumn("top", F.max("level").over(along)).groupBy("wid").agg(F.min(F.col("level") / F.col("top") - 1).alias("drawdown")), "drawdown")


def roll_gini(spark, d):
    p, w, rows = _rolling(spark, d)
    out = _lead(rows, 0.9, ("wid",)).groupBy("wid", F.col("src").alias("v")).agg(F.count("*").alias("x"))
    every = w.select("wid").join(p.select(F.col("asset_idx").alias("v")).distinct()).join(out, ["wid", "v"], "left").fillna(0, ["x"])
    i = F.row_number().over(Window.partitionBy("wid").orderBy("x", "v"))
    ranked = every.withColumn("i", i).withColumn("n", F.count("*").over(Window.partitionBy("wid")))
    return _r(ranked.groupBy("wid").agg(F.try_divide(F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("x")), F.max("n") * F.sum("x")).alias("gini")), "gini")


def roll_moments(spark, d):
    p, w, _ = _rolling(spark, d)
    n, g1, g2 = F.count("m"), F.skewness("m"), F.kurtosis("m")
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return _r(windows.within(_market(p), w).groupBy("wid").agg(F.avg("m").alias("mean"), skew.alias("skew"), kurt.alias("kurt")), "mean", "skew", "kurt")


def roll_lead_h(spark, d):
    """Coupling of a window with the market's return h weeks on: rank correlation by h."""
    p, w, rows = _rolling(spark, d)
    coupling = signals.correlation(rows, ("wid",)).groupBy("wid").agg(F.round(F.avg(F.abs("c")), 9).alias("coupling"))
    ahead = w.join(coupling, "wid").select("coupling", "end", F.explode(F.array(*map(F.lit, (1, 5, 10)))).alias("h"))
    rows = ahead.join(_market(p), F.col("t") == F.col("end") + F.col("h")).withColumn("m", F.round("m", 9))
    return _r(ranks.spearman(rows, "coupling", "m", ["h"]).select("h", "rho", "n"), "rho")


def regime_coupling(spark, d):
    """Mean |rho| of quarters, and whether the quarter is one of high volatility."""
    p = _panel(spark, d).withColumn("wid", F.floor(F.col("t") / 13))
    c = signals.correlation(p, ("wid",)).groupBy("wid").agg(F.avg(F.abs("c")).alias("coupling"))
    v = p.groupBy("wid", "t").agg(F.avg("r").alias("m")).groupBy("wid").agg(F.stddev_samp("m").alias("vol"), F.count("*").alias("n")).where("n >= 10")
    both = v.join(c, "wid")
    cut = both.agg(F.percentile("vol", F.lit(0.75)).alias("cut"))
    return _r(both.crossJoin(F.broadcast(cut)).select("wid", "coupling", "vol", (F.col("vol") > F.col("cut")).alias("crisis")), "coupling", "vol")


def yoy_diff_vol(spark, d):
    """Change over four quarters of each nation's revenue, and its deviation for those with eight or more."""
    s = panels.week_sales(spark, d).groupBy("asset", F.date_trunc("quarter", "wk").alias("q")).agg(F.sum("v").alias("v"))
    diff = s.withColumn("x", F.col("v") - F.lag("v", 4).over(Window.partitionBy("asset").orderBy("q")))
    return _r(diff.groupBy("asset").agg(F.stddev_samp("x").alias("sd"), F.count("x").alias("n")).where("n >= 8"), "sd")


def shock_spillover(spark, d):
    """Rank correlation of signed forecasts along the edges of the train rows on test rows: all, and those after moves above two deviations."""
    train, test, lagged = _train(spark, d)
    e = materialize(graphs.sparsify(materialize(graphs.signed_lead_lag(lagged), "pairs"), "quantile", 0.9), "edges")
    sd = train.groupBy("asset_idx").agg((2 * F.stddev_samp("r")).alias("cut")).withColumnRenamed("asset_idx", "leader")
    keys = e.select(F.col("src").alias("leader"), F.col("dst").alias("lagger"), "lag", F.signum("signed").alias("way"))
    rows = signals._shifted(test, keys).join(keys, ["leader", "lagger", "lag"]).join(sd, "leader")
    rows = rows.select(F.round(F.col("way") * F.col("x"), 9).alias("fore"), F.round("y", 9).alias("real"), (F.abs("x") > F.col("cut")).alias("shock"))
    kinds = rows.withColumn("kind", F.explode(F.when(F.col("shock"), F.array(F.lit("all"), F.lit("shock"))).otherwise(F.array(F.lit("all")))))
    return _r(ranks.spearman(kinds, "fore", "real", ["kind"]).select("kind", "rho", "n"), "rho")


def _long_short(scores: DataFrame, least: int) -> DataFrame:
    """(wid, spread): mean of the next returns of the highest fifth (three at least) less the lowest, windows of ``least`` names or more."""
    w = Window.partitionBy("wid")
    n = F.count("*").over(w)
    rows = scores.withColumns({"n": n, "up": F.row_number().over(w.orderBy("score", "asset_idx"))}).where(F.col("n") >= least)
    k = F.greatest(F.floor(F.col("n") / 5), F.lit(3))
    return rows.groupBy("wid").agg((F.avg(F.when(F.col("up") > F.col("n") - k, F.col("next"))) - F.avg(F.when(F.col("up") <= k, F.col("next")))).alias("spread"))


def _compound(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg((F.product(1 + F.col("r")) - 1).alias(name))


def _simple(p: DataFrame) -> DataFrame:
    """Logarithmic changes of the fixture as simple returns, held to (-50 %, 100 %) as weeks without a sale have none."""
    return p.withColumn("r", F.greatest(F.least(F.exp("r") - 1, F.lit(1.0)), F.lit(-0.5)))


def _next_returns(p: DataFrame, w: DataFrame) -> DataFrame:
    return _compound(windows.within(_simple(p), w, "end", f"end + {STEP}"), "next", "wid", "asset_idx")


def centrality_ls(spark, d):
    """Next returns of central assets less those at the rim; the more negative its mean curvature, the more central is an asset."""
    p, w, rows = _rolling(spark, d)
    e = materialize(_plain_by(_lead(rows, 0.9, ("wid",)), "wid"), "curved")
    score = e.select("wid", F.explode(F.array("src", "dst")).alias("asset_idx"), "f").groupBy("wid", "asset_idx").agg(F.round(-F.avg("f"), 9).alias("score"))
    return _r(_long_short(_next_returns(p, w).join(score, ["wid", "asset_idx"]), 1), "spread")


def link_momentum_ls(spark, d):
    """What leaders did last, carried along the edges between sectors to laggers."""
    p, w, rows = _rolling(spark, d)
    last = _compound(windows.within(_simple(p), w, f"end - {STEP}", "end"), "move", "wid", "asset_idx").withColumnRenamed("asset_idx", "src")
    sectors = p.select(F.col("asset_idx").alias("asset"), "sector").distinct()
    edges = files.cross_sector(_lead(rows, 0.7, ("wid",)), sectors)
    score = edges.join(last, ["wid", "src"]).groupBy("wid", F.col("dst").alias("asset_idx")).agg(F.round(F.avg(F.signum("signed") * F.col("move")), 9).alias("score"))
    return _r(_long_short(_next_returns(p, w).join(score, ["wid", "asset_idx"]), 10), "spread")


def long_short_summary(spark, d):
    """Mean, t statistic, Sharpe ratio of a year of periods, share of wins and the normal interval of both long-short studies."""
    both = centrality_ls(spark, d).withColumn("study", F.lit("centrality")).unionByName(link_momentum_ls(spark, d).withColumn("study", F.lit("link momentum")))
    return _r(ranks.summary(both, "spread", ["study"], 12), "mean", "t", "sharpe", "wins", "low", "high")


def link_enrichment(spark, d):
    """Edges that join the nations of heavy trade, against the hypergeometric tail."""
    p = _panel(spark, d)
    e = _lead(p, 0.7).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    item, o, c, s, n = (panels.table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    idx = n.join(p.select("asset", "asset_idx").distinct(), F.col("n_name") == F.col("asset")).select("n_nationkey", "asset_idx")
    trade = item.join(o, item.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, item.l_suppkey == s.s_suppkey).groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    pair = trade.join(idx.toDF("s_nationkey", "x"), "s_nationkey").join(idx.toDF("c_nationkey", "y"), "c_nationkey").where("x <> y")
    pair = pair.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("n").alias("n"))
    top = materialize(pair.orderBy(F.desc("n"), "a", "b").limit(60).select("a", "b"), "links")  # the heaviest sixty
    v = p.agg(F.countDistinct("asset_idx").alias("v")).select((F.col("v") * (F.col("v") - 1) / 2).cast("long").alias("of"))
    hits = e.join(top.withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(F.count("*").alias("drawn"), F.count("hit").alias("hits"))
    row = hits.crossJoin(F.broadcast(top.agg(F.count("*").alias("links")))).crossJoin(F.broadcast(v))
    row = row.select("hits", "drawn", "links", "of", ranks.hypergeometric_tail(*map(F.col, ("hits", "drawn", "links", "of"))).alias("p"))
    return _r(row, "p")


def candidate_grid(spark, d):
    """Residualizers by cuts by objects, each with the rank correlation of curvature with edge weight."""
    p = _panel(spark, d)
    out = []
    for name, rows in (("none", p), ("market", materialize(residuals.residualize(p, "market"), "residual"))):
        pairs = materialize(graphs.signed_lead_lag(graphs.lagged_correlation(rows)), "pairs")
        for q in (0.7, 0.9):
            f = materialize(graphs.four_objects(materialize(graphs.sparsify(pairs, "quantile", q), "edges")), "four")
            f = _r(f, "f_weighted", "f_augmented", "weight")
            out += [ranks.spearman(f, c, "weight").select(F.lit(name).alias("residual"), F.lit(q).alias("q"), F.lit(c).alias("object"), "rho", "n") for c in ("f_weighted", "f_augmented")]
    return _r(reduce(DataFrame.unionByName, out), "rho")


def critic_decisions(spark, d):
    """Two critics of one candidate: the first looks at the signed correlation, the second at its size."""
    g = materialize(candidate_grid(spark, d), "grid")
    return g.select("residual", "q", "object", (F.col("rho") < 0.8).alias("first_accepts"), (F.abs("rho") < 0.8).alias("second_accepts"))


QUERIES = [
    panel_pivot_avg, panel_unpivot, bars_volume, effective_link_join, name_normalize, fuzzy_contains_join, resid_market_sector, resid_factors, resid_pca, lagged_corr_grouped, forman_plain, forman_weighted,
    forman_undirected, triangles_common, forman_augmented, corr_graph_forman, node_curvature, clustering_coeff, triangle_density, density_sweep, curvature_gap, modularity_by_region, components_after_cut,
    edge_abs_corr, resid_orthogonalization, bh_adjust, walk_forward_windows, select_curvature, select_correlation, orient_pairs, select_undirected, select_random, directional_ic, directional_ic_grouped,
    pooled_ic, mean_reversion_pnl, bootstrap_edges, bootstrap_rank_stability, bootstrap_ic, roll_curv_vol, roll_partial_spearman, roll_drawdown, roll_gini, roll_moments, roll_lead_h, regime_coupling,
    yoy_diff_vol, shock_spillover, centrality_ls, link_momentum_ls, long_short_summary, link_enrichment, candidate_grid, critic_decisions,
]
