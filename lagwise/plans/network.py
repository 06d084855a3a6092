"""Queries of sources in files, whole-graph operators, cointegration, portfolios, studies and their verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import cointegration, graph_tasks, graphs, portfolios, residuals, signals, windows
from ..sources import files, panels, synthetic
from ..sources.scratch import materialize, scratch_path
from . import pipeline
from .research import STEP, _lead, _market, _nodes, _plain_by, _rolling, _simple, _vol
from .studies import _edges, _panel, _r


def _csv(df: DataFrame, name: str, header: bool = True) -> str:
    path = f"{scratch_path(df.sparkSession, name)}.csv"
    df.write.option("header", header).csv(path)
    return path


def _wide(spark, d) -> DataFrame:
    """(date, a column an asset): the weekly panel as a file would have it."""
    p = _panel(spark, d).withColumn("date", F.date_add(F.lit("2000-01-03").cast("date"), F.col("t") * 7))
    names = [x.asset for x in p.select("asset").distinct().orderBy("asset").collect()]  # the nations
    return p.groupBy("date").pivot("asset", names).agg(F.first("r"))


def csv_wide_panel(spark, d):
    """A wide file read back."""
    rows = files.read_panel(spark, _csv(_wide(spark, d), "wide"))
    return _r(rows.select((F.datediff(F.col("t").cast("date"), F.lit("2000-01-03").cast("date")) / 7).cast("int").alias("t"), "asset", "r"), "r")


def csv_long_panel(spark, d):
    """A long file with repeated rows and codes in place of numbers."""
    item = panels.table(spark, d, "lineitem")
    ret = F.when(F.col("l_returnflag") == "R", "C").otherwise((F.col("l_discount") - 0.05).cast("string"))
    long = item.select(F.to_date("l_shipdate").alias("caldt"), F.col("l_suppkey").alias("PERMNO"), ret.alias("Ret"))
    rows = files.read_panel(spark, _csv(long, "long"))
    return _r(rows.select(F.col("t").cast("date").alias("t"), F.col("asset").cast("long").alias("asset"), "r"), "r")


def csv_matrix_panel(spark, d):
    """Assets as rows, days as columns, gaps as 0."""
    p = _panel(spark, d).where("t < 40")
    day = F.date_format(F.date_add(F.lit("2000-01-03").cast("date"), F.col("t")), "'X'yyyyMMdd")
    days = [f"X2000{x}" for x in (f"{m:02d}{n:02d}" for m, last in ((1, 31), (2, 29)) for n in range(1, last + 1))][2:42]
    value = F.when((F.col("t") + F.col("asset_idx")) % 11 != 0, F.round("r", 6))
    matrix = p.select("asset", day.alias("day"), value.alias("r")).groupBy("asset").pivot("day", days).agg(F.first("r"))
    rows = files.read_matrix(spark, _csv(matrix, "matrix"))
    return rows.select(F.datediff("t", F.lit("2000-01-03").cast("date")).alias("t"), "asset", "r")


def csv_assemble(spark, d):
    """Returns within windows of membership, with sectors: three files put together."""
    o, c, n = (panels.table(spark, d, t) for t in ("orders", "customer", "nation"))
    facts = o.select(F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("permno"), F.to_date("o_orderdate").alias("date"), (F.col("o_totalprice") / 1e6).alias("ret"))
    member = o.groupBy(F.col("o_custkey").alias("permno")).agg(F.to_date(F.min("o_orderdate")).alias("mbrstartdt"), F.when(F.col("o_custkey") % 2 == 0, F.date_sub(F.max("o_orderdate"), 30).cast("string")).otherwise("E").alias("mbrenddt"))
    sector = c.where("c_custkey % 5 <> 0").join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("lpermno"), F.col("n_name").alias("gsector"))
    made = files.assemble(spark, _csv(facts, "facts"), _csv(member, "members"), _csv(sector, "sectors"))
    return _r(made.returns.join(made.sectors, "asset").select("t", F.col("asset").cast("long").alias("asset"), "sector", "r"), "r")


def csv_headerless(spark, d):
    n = panels.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return files.headerless(spark, _csv(n, "nations", header=False), "key", "name").select(F.col("key").cast("long").alias("key"), "name", F.col("_c2").cast("long").alias("rest"))


def csv_series(spark, d):
    """First column days, last column values, rows without a number dropped."""
    e = panels.table(spark, d, "events").groupBy(F.to_date("ts").alias("DATE")).agg(F.count("*").alias("OPEN"), F.avg("value").alias("mean"))
    raw = e.select("DATE", "OPEN", F.when(F.day("DATE") % 5 == 0, ".").otherwise(F.col("mean").cast("string")).alias("CLOSE"))
    return _r(files.read_series(spark, _csv(raw, "series")), "v")


def catalog_tables(spark, d):
    return files.catalog(spark, d).select("name", "format")


def catalog_describe(spark, d):
    return files.describe(spark, d, "nation").select("position", "column")


def whole_ids(spark, d):
    """Ids that went through floating point come out as they were."""
    s = panels.table(spark, d, "supplier")
    return s.select("s_suppkey", files.whole_id(F.concat(F.col("s_suppkey").cast("double").cast("string"))).alias("id"), files.whole_id(F.concat(F.lit("K-"), "s_suppkey")).alias("name"))


def label_chain(spark, d):
    """A customer's label: the region if it is even, else the nation if it is not divisible by three, else OTHER."""
    c, n, r = (panels.table(spark, d, t) for t in ("customer", "nation", "region"))
    home = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    every = c.select(F.col("c_custkey").alias("asset"))
    one = home.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("asset"), F.col("r_name").alias("sector"))
    two = home.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("asset"), F.col("n_name").alias("sector"))
    return files.labelled(every, one, two)


def cross_sector_edges(spark, d):
    p = _panel(spark, d)
    sectors = p.where("asset_idx % 7 <> 0").select(F.col("asset_idx").alias("asset"), "sector").distinct()
    return files.cross_sector(_edges(spark, d), sectors).select("src", "dst")


def compound_returns(spark, d):
    """The product of simple returns over blocks of thirteen weeks."""
    p = _simple(_panel(spark, d)).withColumn("wid", F.floor(F.col("t") / 13))
    return _r(p.groupBy("wid", "asset_idx").agg((F.product(1 + F.col("r")) - 1).alias("r")), "r")


def _links(spark, d) -> DataFrame:
    """(a, b): pairs of nations with more than the mean of line items between them."""
    item, o, c, s, n = (panels.table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    idx = n.join(_panel(spark, d).select("asset", "asset_idx").distinct(), F.col("n_name") == F.col("asset")).select("n_nationkey", "asset_idx")
    trade = item.join(o, item.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, item.l_suppkey == s.s_suppkey).groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    pair = trade.join(idx.toDF("s_nationkey", "x"), "s_nationkey").join(idx.toDF("c_nationkey", "y"), "c_nationkey").where("x <> y")
    pair = pair.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("n").alias("n"))
    mean = pair.agg(F.avg("n").alias("mean"))
    return materialize(pair.crossJoin(F.broadcast(mean)).where("n > mean").select("a", "b"), "links")  # one row


def link_rates(spark, d):
    """The share of known links among all pairs, the most curved edges between sectors, the most correlated edges, and all edges; with enrichment over the first."""
    p, links = _panel(spark, d), _links(spark, d).withColumn("hit", F.lit(1.0))
    e = materialize(graphs.four_objects(_edges(spark, d)).withColumn("f", F.round("f_augmented", 9)), "four")
    sectors = p.select(F.col("asset_idx").alias("asset"), "sector").distinct()
    pair = lambda df: df.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    rho = signals.correlation(p).select(F.col("i").alias("a"), F.col("j").alias("b"), F.round(F.abs("c"), 9).alias("s"))
    kinds = {
        "all pairs": cointegration.candidates(p),
        "bridges": pair(files.cross_sector(e, sectors).orderBy("f", "src", "dst").limit(50)),
        "correlated": pair(e).join(rho, ["a", "b"]).orderBy(F.desc("s"), "a", "b").limit(50).select("a", "b"),
        "edges": pair(e),
    }
    rate = lambda df, name: df.join(links, ["a", "b"], "left").agg(F.lit(name).alias("kind"), F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("rate"))
    rows = materialize(reduce(DataFrame.unionByName, (rate(df, name) for name, df in kinds.items())), "rates")
    base = rows.where("kind = 'all pairs'").select(F.col("rate").alias("base"))
    return _r(rows.crossJoin(F.broadcast(base)).select("kind", "n", "rate", F.try_divide("rate", "base").alias("enrichment")), "rate", "enrichment")  # one row


def lazy_measures(spark, d):
    """(x, v, mass): a quarter stays, the rest goes to neighbours by weight."""
    e = _edges(spark, d)
    return _r(graphs.measures(e, 0.25), "mass")


def ollivier_curvature(spark, d):
    return _r(graph_tasks.ollivier(_edges(spark, d)).select("src", "dst", "ollivier"), "ollivier")


def all_objects(spark, d):
    """Plain, weighted, augmented and transport curvature side by side."""
    e = pipeline.objects(_edges(spark, d, 0.9), pipeline.Config())
    return _r(e.select("src", "dst", "f_plain", "f_weighted", "f_augmented", "m", "ollivier"), "f_plain", "f_weighted", "f_augmented", "ollivier")


def object_metrics(spark, d):
    """Each object of curvature against |rho| and degrees."""
    p = _panel(spark, d)
    e = pipeline.with_degrees(pipeline.objects(_edges(spark, d), pipeline.Config()), materialize(signals.correlation(p), "correlation"))
    out = []
    for c in ("f_plain", "f_weighted", "f_augmented", "ollivier"):
        rows = materialize(e.withColumns({"x": F.round(c, 9), "y": F.round("abs_rho", 9)}).withColumn("less", -F.col("y")), "rows")
        row = ranks.spearman(rows, "x", "y").crossJoin(ranks.topk_jaccard(rows, "x", "less", ["src", "dst"], 20)).crossJoin(pipeline.explained(rows, c, "deg_in", "deg_out"))  # one row each
        out.append(row.select(F.lit(c).alias("object"), "rho", "jaccard", "r2"))
    return _r(reduce(DataFrame.unionByName, out), "rho", "jaccard", "r2")


def afrc_communities(spark, d):
    p = _panel(spark, d)
    return graph_tasks.curvature_communities(_lead(p, 0.7), _nodes(p).select("v"))


def afrc_one_shot(spark, d):
    """Components after all edges of augmented curvature below 0 have gone."""
    p = _panel(spark, d)
    e = graphs.triangles(graphs.forman_undirected(_lead(p, 0.7))).where("f + 3 * m >= 0")
    return graphs.components(e, _nodes(p).select("v"))


def modularity_communities(spark, d):
    p = _panel(spark, d)
    return graph_tasks.modularity_communities(_lead(p, 0.7), _nodes(p).select("v"))


def rand_index(spark, d):
    """Components after a cut against regions."""
    found = materialize(afrc_one_shot(spark, d), "found")
    return _r(graph_tasks.adjusted_rand(found, _nodes(_panel(spark, d))), "ari")


def config_null(spark, d):
    return _r(graph_tasks.configuration_null(_edges(spark, d), 50), "mean", "sd", "z")


def kill_switch_a(spark, d):
    return _r(pipeline.kill_switch_a(spark), "ari", "gap", "within", "across")


def coint_pairs(spark, d):
    p = _panel(spark, d)
    return _r(cointegration.cointegration(p, cointegration.candidates(p, 60)), "tau", "p")


def candidate_sample(spark, d):
    return cointegration.candidates(_panel(spark, d), 100, 7)


def select_cointegration(spark, d):
    train, _ = signals.split(_panel(spark, d))
    train = materialize(train, "train")
    chosen = cointegration.most_cointegrated(train, cointegration.candidates(train, 100), 20)
    return signals.orient(materialize(chosen, "chosen"), materialize(graphs.lagged_correlation(train), "lagged")).select("leader", "lagger", "lag")


def argmin_edge(spark, d):
    """The most negatively curved edge."""
    return _r(graphs.four_objects(_edges(spark, d)).agg(F.min_by(F.struct("src", "dst"), F.struct(F.round("f_augmented", 9), "src", "dst")).alias("e"), F.min("f_augmented").alias("f")).select("e.src", "e.dst", "f"), "f")


def _by_window(rows: DataFrame) -> DataFrame:
    """Windows side by side as one panel: times, assets and sectors carry their window."""
    far = 1 << 20
    return rows.select("wid", (F.col("wid").cast("long") * far + F.col("t")).alias("t"), F.concat_ws("|", "wid", "asset").alias("asset"), "asset_idx", F.concat_ws("|", "wid", "sector").alias("sector"), "r")


def walk_forward_ic(spark, d):
    """(wid, method, n_pairs, ic): on windows of 156 weeks, picks on the first four fifths, forecasts on the last."""
    p = _panel(spark, d)
    w = materialize(windows.walk_forward(p, 125, 31, 52), "windows")
    train, test = materialize(windows.within(p, w), "train"), materialize(windows.within(p, w, "end", "end + 31"), "test")
    sector = residuals.residualize(_by_window(train), "market_sector").withColumn("t", F.pmod("t", F.lit(1 << 20)).cast("int"))
    left = materialize(sector.select("wid", "t", "asset_idx", "r"), "residual")
    edges = _lead(left, 0.9, ("wid",))
    apart = lambda c: (F.col("wid").cast("long") * (1 << 20) + F.col(c)).alias(c)
    curved = graphs.four_objects(materialize(edges.select("wid", "lag", apart("src"), apart("dst"), "weight"), "apart"))
    und = graphs.forman_undirected(edges.select("wid", "lag", apart("src"), apart("dst"), "weight"))
    lagged = materialize(graphs.lagged_correlation(train, by=("wid",)), "lagged")
    k = 20
    rank = lambda df, *order: df.withColumn("k", F.row_number().over(Window.partitionBy("wid").orderBy(*order))).where(F.col("k") <= k)
    own = lambda c: F.pmod(c, F.lit(1 << 20)).cast("int")
    top = lambda df, c: rank(df.withColumn("x", F.round(c, 9)), "x", "src", "dst").select("wid", own("src").alias("leader"), own("dst").alias("lagger"), "lag")
    rho = signals.correlation(train, ("wid",)).select("wid", F.col("i").alias("a"), F.col("j").alias("b"), F.round(F.abs("c"), 9).alias("s"))
    every = lagged.where("i < j").select("wid", F.col("i").alias("a"), F.col("j").alias("b")).distinct()
    picked = {
        "curvature": top(curved, "f_augmented"),
        "undirected": top(und, "f"),
        "correlation": signals.orient(rank(rho, F.desc_nulls_last("s"), "a", "b"), lagged, ("wid",)),
        "random": signals.orient(rank(every, F.md5(F.concat_ws("-", "wid", "a", "b").cast("binary"))), lagged, ("wid",)),
    }
    picks = materialize(reduce(DataFrame.unionByName, (x.select(F.lit(name).alias("method"), "wid", "leader", "lagger", "lag") for name, x in picked.items())), "picks")
    # a pair of a window is one of a lag that carries the window
    ic = signals.pair_ic(signals.forecasts_by(train, test, picks, "wid").withColumns({c: F.round(c, 9) for c in ("fore", "real")}).withColumn("lag", F.struct("wid", "lag")))
    each = ic.select("leader", "lagger", F.col("lag.wid").alias("wid"), F.col("lag.lag").alias("lag"), "ic")
    return _r(picks.join(each, ["wid", "leader", "lagger", "lag"]).groupBy("wid", "method").agg(F.count("*").alias("n_pairs"), F.avg("ic").alias("ic")), "ic")


def walk_forward_summary(spark, d):
    """Mean, deviation interval and t of the forecasts of each method over the windows."""
    return _r(ranks.summary(materialize(walk_forward_ic(spark, d), "ic"), "ic", ["method"], 1), "mean", "t", "sharpe", "wins", "low", "high")


def index_lead(spark, d):
    """Coupling of windows against the change of an index h weeks on, without what its present level (and volatility) explains."""
    p, w, rows = _rolling(spark, d)
    index = p.where("sector = 'ASIA'").groupBy("t").agg(F.stddev_samp("r").alias("v"))
    now = w.join(index, F.col("t") == F.col("end") - 1).select("wid", F.col("v").alias("now"))
    coupling = signals.correlation(rows, ("wid",)).groupBy("wid").agg(F.avg(F.abs("c")).alias("x"))
    base = w.join(now, "wid").join(coupling, "wid").join(_vol(_market(p), w, "start", "end", "vol"), "wid")
    out = []
    for h in (1, 5, 10, 21):
        ahead = base.join(index.withColumnRenamed("v", "then"), F.col("t") == F.col("end") - 1 + h).withColumn("change", F.col("then") - F.col("now"))
        ahead = materialize(ahead.select("x", "change", "now", "vol"), "ahead")
        one, two = ranks.partial_spearman(ahead, "x", "change", "now"), ranks.partial_spearman(ahead, "x", "change", "now", "vol")
        out.append(one.select(F.lit(h).alias("h"), F.col("rho").alias("given_level"), "n").crossJoin(F.broadcast(two.select(F.col("rho").alias("given_both")))))  # one row
    return _r(reduce(DataFrame.unionByName, out), "given_level", "given_both")


def node_vol_rank(spark, d):
    """(wid, by_curvature, by_degree): rank correlation of a vertex's mean curvature, and of its edges, with its own later deviation."""
    p, w, rows = _rolling(spark, d)
    e = materialize(_plain_by(_lead(rows, 0.7, ("wid",)), "wid"), "curved")
    node = e.select("wid", F.explode(F.array("src", "dst")).alias("asset_idx"), "f").groupBy("wid", "asset_idx").agg(F.round(F.avg("f"), 9).alias("curvature"), F.count("*").alias("degree"))
    later = windows.within(p, w, "end", f"end + {STEP}").groupBy("wid", "asset_idx").agg(F.round(F.stddev_samp("r"), 9).alias("vol"))
    both = materialize(node.join(later, ["wid", "asset_idx"]), "nodes")
    a, b = ranks.spearman(both, "curvature", "vol", ["wid"]), ranks.spearman(both, "degree", "vol", ["wid"])
    return _r(a.select("wid", F.col("rho").alias("by_curvature"), "n").join(b.select("wid", F.col("rho").alias("by_degree")), "wid"), "by_curvature", "by_degree")


def diversification(spark, d):
    """(method, wid, vol, drawdown) after windows of 63 weeks: eight assets least correlated, eight of different communities, eight drawn."""
    p, w, rows = _rolling(spark, d)
    k = 8
    few = portfolios.least_correlated(materialize(signals.correlation(rows, ("wid",)), "correlation"), k)
    edges = _lead(rows, 0.7, ("wid",))
    spread = portfolios.representatives(materialize(graph_tasks.modularity_communities(edges, by=("wid",)), "communities"), edges, k)
    names = rows.select("wid", "asset_idx").distinct()
    drawn = names.withColumn("place", F.row_number().over(Window.partitionBy("wid").orderBy(F.md5(F.concat_ws("-", "wid", "asset_idx").cast("binary")))) - 1).where(F.col("place") < k)
    held = reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("method"), "wid", "asset_idx") for name, df in (("least correlated", few), ("communities", spread), ("random", drawn))))
    later = windows.within(_simple(p), w, "end", f"end + {STEP}").select("wid", "t", "asset_idx", "r")
    return _r(portfolios.risk(later, materialize(held, "held"), 52), "vol", "drawdown")


def month_means(spark, d):
    """Mean coupling by calendar month, and its mean in named ranges of days against all others."""
    p = _panel(spark, d).withColumn("wid", F.floor(F.col("t") / 4))
    c = signals.correlation(p, ("wid",)).groupBy("wid").agg(F.avg(F.abs("c")).alias("coupling"))
    day = F.date_add(F.lit("1992-01-06").cast("date"), (F.col("wid") * 28).cast("int"))
    c = c.withColumn("month", F.month(day)).withColumn("crisis", day.between("1994-01-01", "1994-06-30") | day.between("1997-01-01", "1997-03-31"))
    return _r(c.groupBy("month").agg(F.avg("coupling").alias("coupling"), F.avg(F.when(F.col("crisis"), F.col("coupling"))).alias("in_crisis"), F.avg(F.when(~F.col("crisis"), F.col("coupling"))).alias("calm"), F.count("*").alias("n")), "coupling", "in_crisis", "calm")


def synthetic_blocks(spark, d):
    """Edges within and between planted blocks."""
    edges, labels = synthetic.block_graph(spark, [20, 20, 20], seed=3)
    e = edges.join(labels.toDF("src", "a"), "src").join(labels.toDF("dst", "b"), "dst")
    return _r(e.groupBy((F.col("a") == F.col("b")).alias("same")).agg(F.count("*").alias("n"), F.avg("weight").alias("weight")), "weight")


def _planted(spark):
    return synthetic.lead_lag_panel(spark, n_assets=24, n_periods=600, strength=0.8, n_pairs=6, seed=1)


def synthetic_pairs_found(spark, d):
    """Planted pairs and how the graph of residuals has them."""
    made = _planted(spark)
    panel = materialize(made.returns, "panel")
    left = materialize(residuals.residualize(panel, "market_sector"), "residual")
    pairs = materialize(graphs.signed_lead_lag(graphs.lagged_correlation(left)), "pairs")
    e = graphs.sparsify(pairs, "quantile", 0.9).select(F.col("src").alias("leader"), F.col("dst").alias("lagger"), F.col("lag").alias("at"), F.round("weight", 6).alias("weight"))
    return made.pairs.join(e, ["leader", "lagger"], "left")


SMALL = pipeline.Config(null_iters=20, boots=20, max_coint_candidates=60, selection_k=8, threshold=0.8)


def study_synthetic(spark, d):
    """The forecasts of each method in a study of the synthetic panel."""
    panel = materialize(_planted(spark).returns, "panel")
    return _r(pipeline.run_study(panel, SMALL).ic, "mean_ic", "pooled_ic", "low", "high")


def study_cascade(spark, d):
    """The checks of a study of the weekly panel."""
    return _r(pipeline.run_study(_panel(spark, d), SMALL).cascade, "spearman", "jaccard", "plain_r2", "r2_on_degree", "null_share")


def orchestrator_decisions(spark, d):
    """Twelve candidates, each with its figures and verdict."""
    out = pipeline.Orchestrator().run(_panel(spark, d))
    return _r(out.drop("null_share"), "spearman", "jaccard", "plain_r2", "r2_on_degree")


def orchestrator_report(spark, d):
    """The verdicts as a report, line by line."""
    o = pipeline.Orchestrator(grid={"residual": ["market"], "threshold": [0.7], "triangle_mode": ["common"], "curvature": ["f_plain", "f_augmented"]})
    path = scratch_path(spark, "report")
    o.report(materialize(o.run(_panel(spark, d)), "decisions"), path)
    return spark.read.text(path).where("value <> ''")


def agent_verdicts(spark, d):
    """Whole studies against all rules."""
    panel = materialize(_planted(spark).returns, "panel")
    out = pipeline.run_agent(panel, [SMALL, pipeline.Config(**{**SMALL.__dict__, "curvature": "f_weighted"})])
    return out.select("run", "curvature", "threshold", "edges", "accepted", "reasons")


QUERIES = [
    csv_wide_panel, csv_long_panel, csv_matrix_panel, csv_assemble, csv_headerless, csv_series, catalog_tables, catalog_describe, whole_ids, label_chain, cross_sector_edges, compound_returns, link_rates,
    lazy_measures, ollivier_curvature, all_objects, object_metrics, afrc_communities, afrc_one_shot, modularity_communities, rand_index, config_null, kill_switch_a, coint_pairs, candidate_sample,
    select_cointegration, argmin_edge, walk_forward_ic, walk_forward_summary, index_lead, node_vol_rank, diversification, month_means, synthetic_blocks, synthetic_pairs_found, study_synthetic, study_cascade,
    orchestrator_decisions, orchestrator_report, agent_verdicts,
]
