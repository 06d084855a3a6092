"""The whole study of a panel: residuals, graph, curvature, communities, cascade of checks, selection, forecasts; and a
loop that proposes settings, tests them and keeps what passes.

Each step is a table written once; a study gives tables, and its verdicts rows, so that many can run from one session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import cointegration, graph_tasks, graphs, residuals, signals
from ..sources import files
from ..sources.scratch import materialize


@dataclass(frozen=True)
class Config:
    lags: tuple[int, ...] = (1, 2, 3, 5)
    residual: str = "market_sector"
    sparsify: str = "quantile"
    threshold: float = 0.90
    triangle_mode: str = "common"
    curvature: str = "f_augmented"
    selection_k: int = 15
    train: float = 0.6
    val: float = 0.2
    null_iters: int = 100
    with_ollivier: bool = True
    max_coint_candidates: int = 3000
    with_line_graph: bool = True
    within_day: bool = False
    max_removals: int | None = None
    boots: int = 100
    seed: int = 0


@dataclass
class Study:
    """Tables of one study: edges with their curvature, one-row tables of figures, picks by method, forecasts by method."""

    config: Config
    edges: DataFrame
    communities: DataFrame
    pair_communities: DataFrame | None
    triangles: DataFrame
    gap: DataFrame
    gap_found: DataFrame
    cascade: DataFrame
    picks: DataFrame
    ic: DataFrame


#: Ways from a panel (t, asset, asset_idx, sector, r) to residuals.
RESIDUALS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "none": lambda p: p,
    "market": lambda p: residuals.residualize(p, "market"),
    "market_sector": lambda p: residuals.residualize(p, "market_sector"),
    "pca": lambda p: residuals.principal(p, 3),
}


def indexed(bundle: files.Bundle) -> DataFrame:
    """(t, asset, asset_idx, sector, r) with whole numbers for times and assets; assets without a sector are of OTHER."""
    rows = bundle.returns.select("t", "asset", "r")
    labels = files.labelled(rows, *([bundle.sectors] if bundle.sectors is not None else []))
    times = ordinal(rows.select("t").distinct(), "t", "__t")
    names = ordinal(labels, "asset", "asset_idx")
    return rows.join(times, "t").join(names, "asset").select(F.col("__t").cast("int").alias("t"), "asset", F.col("asset_idx").cast("int").alias("asset_idx"), "sector", "r")


def ordinal(df: DataFrame, by: str, name: str) -> DataFrame:
    """Places from 0 in the order of a distinct column of an axis (times or assets, not rows)."""
    from pyspark.sql import Window

    return df.withColumn(name, F.row_number().over(Window.orderBy(by)) - 1)


def residual(panel: DataFrame, method: str) -> DataFrame:
    if method not in RESIDUALS:
        raise ValueError(f"unknown method {method!r}")
    return RESIDUALS[method](panel)


def lead_lag_edges(panel: DataFrame, config: Config) -> DataFrame:
    if config.within_day:
        lagged = signals.grouped_lagged_correlation(panel, config.lags)
    else:
        lagged = graphs.lagged_correlation(panel, config.lags)
    pairs = materialize(graphs.signed_lead_lag(lagged), "pairs")
    return materialize(graphs.sparsify(pairs, config.sparsify, config.threshold), "edges")


def objects(edges: DataFrame, config: Config) -> DataFrame:
    """The edges with plain, weighted and augmented curvature, triangles and, if asked for, transport curvature."""
    e = graphs.triangles(graphs.forman(graphs.forman(edges, False, name="f_plain"), True, name="f_weighted"), config.triangle_mode)
    e = materialize(e.withColumn("f_augmented", F.col("f_weighted") + 3 * F.col("m")), "objects")
    return materialize(graph_tasks.ollivier(e), "objects") if config.with_ollivier else e


def with_degrees(edges: DataFrame, correlation: DataFrame, source_in: bool = True) -> DataFrame:
    """The edges with the regressors of the degree check: edges into the source, out of the target, and |rho| of the ends."""
    into = edges.groupBy(F.col("dst").alias("src")).agg(F.count("*").cast("double").alias("deg_in"))
    out = edges.groupBy(F.col("src").alias("dst")).agg(F.count("*").cast("double").alias("deg_out"))
    rho = correlation.select("i", "j", F.abs("c").alias("abs_rho"))
    e = edges.withColumns({"i": F.least("src", "dst"), "j": F.greatest("src", "dst")}).join(rho, ["i", "j"], "left").drop("i", "j")
    return materialize(e.join(into, "src", "left").join(out, "dst", "left").fillna(0.0, ["deg_in", "deg_out"]), "regressors")


def explained(df: DataFrame, y: str, *regressors: str) -> DataFrame:
    """One row: the share of y's variance that a linear fit explains; 1 where it has none."""
    rows = df.where(" and ".join(f"{c} is not null" for c in (y, *regressors))).select(F.col(y).cast("double").alias("y"), F.col(y).cast("double").alias("left"), *regressors)
    left = ranks.residuals(rows, ["left"], list(regressors))
    return left.agg(F.when(F.var_pop("y") > 0, 1 - F.sum(F.col("left") ** 2) / (F.var_pop("y") * F.count("*"))).otherwise(1.0).alias("r2"))


def cascade(curved: DataFrame, correlation: DataFrame, config: Config, null: DataFrame | None = None) -> DataFrame:
    """One row: rank correlation with |rho|, overlap of the first picks, R2 on degrees of plain and chosen curvature, share of edges beyond the null, edges."""
    e = with_degrees(curved, correlation)
    column = F.round(config.curvature, 9)
    rows = materialize(e.withColumns({"curve": column, "rho_": F.round("abs_rho", 9)}).withColumn("less", -F.col("rho_")), "judged")
    parts = [
        ranks.spearman(rows, "curve", "rho_").select(F.col("rho").alias("spearman"), F.col("n").alias("compared")),
        ranks.topk_jaccard(rows, "curve", "less", ["src", "dst"], config.selection_k),
        explained(rows, "f_plain", "deg_in", "deg_out").withColumnRenamed("r2", "plain_r2"),
        explained(rows, config.curvature, "deg_in", "deg_out", "abs_rho").withColumnRenamed("r2", "r2_on_degree"),
        curved.agg(F.count("*").alias("edges")),
    ]
    if null is not None:
        parts.append(graph_tasks.significant(null).select(F.col("share").alias("null_share")))
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # one row each
    if null is None:
        out = out.withColumn("null_share", F.lit(None).cast("double"))
    return materialize(out.withColumn("plain_is_degree", F.col("plain_r2") > 0.999), "cascade")


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def selections(train: DataFrame, lagged: DataFrame, curved: DataFrame, config: Config) -> DataFrame:
    """(method, leader, lagger, lag): the pairs that each method picks on the train rows."""
    k = config.selection_k
    top = lambda df, column: df.orderBy(F.round(column, 9), "src", "dst").limit(k).select(F.col("src").alias("leader"), F.col("dst").alias("lagger"), "lag")
    und = graphs.forman_undirected(curved.select("src", "dst", "weight", "lag"))
    pairs = cointegration.candidates(train)
    rho = signals.correlation(train).select(F.col("i").alias("a"), F.col("j").alias("b"), F.round(F.abs("c"), 9).alias("s"))
    picked = {
        "curvature": top(curved, config.curvature),
        "undirected": top(und, "f"),
        "correlation": signals.orient(rho.orderBy(F.desc_nulls_last("s"), "a", "b").limit(k).select("a", "b"), lagged),
        "cointegration": signals.orient(cointegration.most_cointegrated(train, cointegration.candidates(train, config.max_coint_candidates, config.seed), k), lagged),
        "random": signals.orient(pairs.orderBy(F.md5(F.concat_ws("-", F.lit(config.seed), F.lit("pick"), "a", "b").cast("binary"))).limit(k), lagged),
    }
    if "ollivier" in curved.columns:
        picked["ollivier"] = top(curved, "ollivier")
    return materialize(_union(df.select(F.lit(name).alias("method"), "leader", "lagger", "lag") for name, df in picked.items()), "picks")


def scores(train: DataFrame, test: DataFrame, picks: DataFrame, config: Config) -> DataFrame:
    """(method, n_pairs, mean_ic, pooled_ic, low, high): forecasts on the test rows, and the interval of the mean over block resamples of these."""
    from ..operators import windows

    by = ("grp",) if config.within_day else ()
    fore = materialize(signals.forecasts(train, test, picks.select("leader", "lagger", "lag").distinct(), by).withColumns({c: F.round(c, 9) for c in ("fore", "real")}), "forecasts")
    ic = materialize(signals.pair_ic(fore), "ic")
    key = ["leader", "lagger", "lag"]
    mean = picks.join(ic, key).groupBy("method").agg(F.count("*").alias("n_pairs"), F.avg("ic").alias("mean_ic"))
    pooled = ranks.spearman(picks.join(ic.select(*key), key).join(fore, key), "fore", "real", ["method"]).select("method", F.col("rho").alias("pooled_ic"))
    first = test.agg(F.min("t").alias("first"))
    moved = test.crossJoin(F.broadcast(first)).withColumn("t", F.col("t") - F.col("first")).drop("first")  # one row
    boots = materialize(windows.blocks(moved, config.boots, 20, config.seed), "boots")
    signs = signals.signs(train, picks.select(*key).distinct())
    rows = signals._shifted(boots, signs, ("boot", *by)).join(signs, key).select("boot", *key, F.round(F.col("sign") * F.col("x"), 9).alias("fore"), F.round("y", 9).alias("real"))
    each = signals.pair_ic(rows.withColumn("lag", F.struct("boot", "lag"))).select("leader", "lagger", F.col("lag.boot").alias("boot"), F.col("lag.lag").alias("lag"), "ic")
    means = picks.join(each, key).groupBy("method", "boot").agg(F.avg("ic").alias("ic"))
    span = means.groupBy("method").agg(F.percentile("ic", F.lit(0.025)).alias("low"), F.percentile("ic", F.lit(0.975)).alias("high"))
    methods = picks.select("method").distinct()
    return methods.join(mean, "method", "left").join(pooled, "method", "left").join(span, "method", "left").fillna(0, ["n_pairs"])


def run_study(panel: DataFrame, config: Config = Config()) -> Study:
    """A study of a panel (t, asset, asset_idx, sector, r), and grp for studies within days."""
    train, test = (materialize(x, n) for x, n in zip(signals.split(panel, config.train, config.val, with_val=True), ("train", "test"), strict=True))
    left = materialize(residual(train, config.residual), "residual")
    if config.within_day:
        left = materialize(left.join(train.select("t", "grp").distinct(), "t") if "grp" not in left.columns else left, "residual")
    edges = lead_lag_edges(left, config)
    labels = materialize(panel.select(F.col("asset_idx").alias("v"), F.col("sector").alias("label")).distinct(), "labels")
    curved = objects(edges, config)
    found = materialize(graph_tasks.curvature_communities(edges, labels.select("v"), max_removals=config.max_removals), "communities")
    null = materialize(graph_tasks.configuration_null(edges, config.null_iters, seed=config.seed), "null") if config.null_iters else None
    correlation = materialize(signals.correlation(left), "correlation")
    pair_communities = None
    if config.with_line_graph:
        line = graphs.line_graph(edges)
        name = lambda a, b: F.concat_ws(">", a, b)
        line = materialize(line.select(name("src", "dst").alias("src"), name("src2", "dst2").alias("dst"), "weight"), "line")
        vertices = edges.select(name("src", "dst").alias("v"))
        pair_communities = materialize(graph_tasks.curvature_communities(line, vertices, max_removals=config.max_removals or 50), "line-communities")
    lagged = materialize(graphs.lagged_correlation(train, config.lags), "lagged")
    picks = selections(train, lagged, curved, config)
    return Study(
        config, curved, found, pair_communities, graphs.triangle_density(edges, labels), graphs.curvature_gap(curved, labels),
        graphs.curvature_gap(curved, found.withColumnRenamed("root", "label")), cascade(curved, correlation, config, null), picks, materialize(scores(train, test, picks, config), "scores"),
    )


# propose, test, reject ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rules:
    """What a candidate must pass; None leaves a rule out."""

    max_spearman: float | None = 0.8
    max_jaccard: float | None = 0.5
    max_r2_on_degree: float | None = 0.95
    min_null_share: float | None = None
    min_edges: int | None = 20


GRID = {"residual": ["market", "market_sector", "pca"], "threshold": [0.90, 0.95], "triangle_mode": ["common"], "curvature": ["f_plain", "f_augmented"]}


def propose(grid: dict | None = None, base: Config = Config()) -> list[tuple[str, Config]]:
    """Every combination of the grid, named in order."""
    grid = grid or GRID
    return [(f"cand{k:03d}", replace(base, **dict(zip(grid, values, strict=True)))) for k, values in enumerate(product(*grid.values()))]


def judge(figures: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``figures`` (rows of the cascade) with accepted and reasons; a graph under min_edges is judged by that alone."""
    said = []
    if rules.max_spearman is not None:
        said.append(F.when(F.abs("spearman") >= rules.max_spearman, F.format_string("spearman %.2f >= " + str(rules.max_spearman), "spearman")))
    if rules.max_jaccard is not None:
        said.append(F.when(F.col("jaccard") > rules.max_jaccard, F.format_string("jaccard %.2f > " + str(rules.max_jaccard), "jaccard")))
    if rules.max_r2_on_degree is not None:
        said.append(F.when(F.col("r2_on_degree") >= rules.max_r2_on_degree, F.format_string("R2 on degree %.2f >= " + str(rules.max_r2_on_degree), "r2_on_degree")))
    if rules.min_null_share is not None:
        said.append(F.when(F.col("null_share") < rules.min_null_share, F.format_string("share beyond the null %.2f < " + str(rules.min_null_share), "null_share")))
    reasons = F.array_join(F.array_compact(F.array(*said)), "; ") if said else F.lit("")
    if rules.min_edges is not None:
        reasons = F.when(F.col("edges") < rules.min_edges, "too few edges").otherwise(reasons)
    return figures.withColumn("reasons", reasons).withColumn("accepted", F.col("reasons") == "")


@dataclass
class Orchestrator:
    """Proposes settings, measures each, and says which pass the rules; graphs are built once for each residual and cut."""

    rules: Rules = field(default_factory=Rules)
    grid: dict = field(default_factory=lambda: dict(GRID))
    base: Config = field(default_factory=lambda: Config(selection_k=20, null_iters=0, with_ollivier=False))

    def run(self, panel: DataFrame) -> DataFrame:
        """(candidate, residual, threshold, triangle_mode, curvature, figures, accepted, reasons), a row a candidate."""
        built: dict[tuple, tuple] = {}
        rows = []
        for name, config in propose(self.grid, self.base):
            key = config.residual, config.threshold, config.triangle_mode
            if key not in built:
                left = materialize(residual(panel, config.residual), "residual")
                edges = lead_lag_edges(left, config)
                null = materialize(graph_tasks.configuration_null(edges, config.null_iters, seed=config.seed), "null") if config.null_iters else None
                built[key] = objects(edges, config), materialize(signals.correlation(left), "correlation"), null
            curved, correlation, null = built[key]
            said = [F.lit(x).alias(c) for c, x in (("candidate", name), ("residual", config.residual), ("threshold", config.threshold), ("triangle_mode", config.triangle_mode), ("curvature", config.curvature))]
            rows.append(cascade(curved, correlation, config, null).select(*said, "*"))
        return judge(_union(rows), self.rules)

    def report(self, decisions: DataFrame, path: str) -> str:
        shown = decisions.orderBy("candidate").select(
            "candidate", "residual", "threshold", "curvature", F.when(F.col("accepted"), "accept").otherwise("reject").alias("verdict"), "spearman", "jaccard", "r2_on_degree", "reasons"
        )
        n, good = decisions.count(), decisions.where("accepted").count()
        return files.markdown(shown, path, f"Proposed {n} candidates, accepted {good}, rejected {n - good}")


def accept(study: Study, rules: Rules = Rules(max_r2_on_degree=None, min_null_share=0.05), need_degree_identity: bool = True, beat_random: bool = True) -> DataFrame:
    """One row: verdict and reasons of a whole study, its forecasts included."""
    ic = study.ic.agg(F.max(F.when(F.col("method") == "curvature", F.col("mean_ic"))).alias("curvature_ic"), F.max(F.when(F.col("method") == "random", F.col("mean_ic"))).alias("random_ic"))
    row = judge(study.cascade, rules).crossJoin(F.broadcast(ic))  # one row each
    more = []
    if need_degree_identity:
        more.append(F.when(~F.col("plain_is_degree"), "plain curvature is no function of degrees"))
    if beat_random:
        more.append(F.when(~F.coalesce(F.col("curvature_ic") > F.col("random_ic"), F.lit(False)), F.format_string("information %.3f <= random %.3f", "curvature_ic", "random_ic")))
    reasons = F.array_join(F.array_compact(F.array(F.when(F.col("reasons") != "", F.col("reasons")), *more)), "; ")
    return row.withColumn("reasons", reasons).withColumn("accepted", F.col("reasons") == "")


def run_agent(panel: DataFrame, configs: Iterable[Config] | None = None, **rules) -> DataFrame:
    """Verdicts of whole studies, a row for each setting; a caller may propose what it likes."""
    chosen = list(configs) if configs is not None else [Config(curvature=c, threshold=t) for c in ("f_augmented", "f_weighted") for t in (0.85, 0.90)]
    rows = []
    for k, config in enumerate(chosen):
        verdict = accept(run_study(panel, config), **rules)
        rows.append(verdict.select(F.lit(k).alias("run"), F.lit(config.curvature).alias("curvature"), F.lit(config.threshold).alias("threshold"), "*"))
    return _union(rows)


def kill_switch_a(spark: SparkSession, sizes: tuple[int, ...] = (20, 20, 20), p_in: float = 0.45, p_out: float = 0.02, seed: int = 0, least: float = 0.6) -> DataFrame:
    """One row: are planted blocks found again by curvature, and are they apart by it?"""
    from ..sources import synthetic

    edges, labels = synthetic.block_graph(spark, list(sizes), p_in, p_out, seed=seed)
    # without direction; of two weights there and back the larger vertex's counts
    one = edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.max_by("weight", "src").alias("weight"))
    edges, labels = materialize(one.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight"), "edges"), materialize(labels, "labels")
    found = materialize(graph_tasks.curvature_communities(edges, labels.select("v")), "communities")
    curved = graphs.triangles(graphs.forman_undirected(edges)).withColumn("f_augmented", F.col("f") + 3 * F.col("m"))
    gap = graphs.curvature_gap(curved, labels)
    row = graph_tasks.adjusted_rand(found, labels).crossJoin(F.broadcast(gap)).crossJoin(F.broadcast(found.agg(F.countDistinct("root").alias("n_found"))))  # one row each
    return row.withColumn("n_true", F.lit(len(sizes))).withColumn("passed", (F.col("ari") >= least) & (F.col("gap") > 0))
