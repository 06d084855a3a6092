"""Queries of the analytics over the fixture tables, one for each operator family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import graphs, residuals
from ..sources import panels
from ..sources.scratch import materialize


def _r(df: DataFrame, *columns: str) -> DataFrame:
    """Floats to six places, so that engines that sum in another order agree."""
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in columns})


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return materialize(panels.week_panel(spark, d), "panel")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return graphs.signed_lead_lag(graphs.lagged_correlation(_panel(spark, d)))


def _edges(spark: SparkSession, d: str, q: float = 0.7) -> DataFrame:
    return materialize(graphs.sparsify(materialize(_pairs(spark, d), "pairs"), "quantile", q), "edges")


def panel_week(spark, d):
    return _r(panels.week_panel(spark, d), "r")


def presence_filter(spark, d):
    p = panels.week_sales(spark, d).select(F.col("wk").alias("t"), "asset", F.col("v").alias("r"))
    return panels.present(p, 0.9).groupBy("asset").agg(F.count("*").alias("n"))


def bars_last_price(spark, d):
    return _r(panels.bars(panels.table(spark, d, "events")), "price", "volume")


def bars_return_within_day(spark, d):
    return _r(panels.within_day_returns(panels.bars(panels.table(spark, d, "events"))).select("asset", "bar", "r"), "r")


def membership_interval_join(spark, d):
    o = panels.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    m = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("start"), F.when(F.col("o_custkey") % 2 == 0, F.date_sub(F.max("o_orderdate"), 30).cast("timestamp")).alias("end"))
    return panels.membership(o, m, "o_custkey", "o_orderdate").select("o_orderkey", "o_custkey")


def delisting_splice(spark, d):
    item = panels.table(spark, d, "lineitem")
    ret = item.where("l_linenumber = 1").select("l_orderkey", (F.col("l_discount") - 0.05).alias("ret"))
    last = item.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_tax").alias("last"))
    return _r(ret.join(last, "l_orderkey", "left").select("l_orderkey", panels.splice(F.col("ret"), F.col("last")).alias("r")), "r")


def universe_screen(spark, d):
    item, part = panels.table(spark, d, "lineitem"), panels.table(spark, d, "part")
    cap = item.join(part, item.l_partkey == part.p_partkey).groupBy("p_brand", "l_partkey").agg(F.avg(F.col("p_retailprice") * F.col("l_quantity")).alias("cap"), F.count("*").alias("days"))
    return _r(cap.where("cap between 10000 and 60000 and days >= 20").orderBy(F.desc("days"), "l_partkey").limit(200), "cap")


def dedupe_keep_last(spark, d):
    e = panels.table(spark, d, "events")
    return _r(panels.keep_last(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value"), "value")


def missing_days_anti(spark, d):
    e = panels.table(spark, d, "events").select(F.to_date("ts").alias("day"), "user_id").distinct()
    done = e.where("user_id % 7 = 0").select("day").distinct()
    return e.where("user_id % 7 = 1").select("day").distinct().join(done, "day", "left_anti")


def calendar_ffill(spark, d):
    s = panels.week_sales(spark, d)
    index = s.where("sector = 'ASIA'").groupBy("wk").agg(F.sum("v").alias("v")).where("day(wk) % 3 <> 0")
    along = Window.orderBy("wk").rowsBetween(Window.unboundedPreceding, 0)  # one row a week
    return _r(s.select("wk").distinct().join(index, "wk", "left").withColumn("v", F.last("v", ignorenulls=True).over(along)), "v")


def market_factor(spark, d):
    return _r(residuals.market_factor(_panel(spark, d)), "market")


def sector_factor(spark, d):
    return _r(residuals.sector_factors(_panel(spark, d)), "factor")


def sector_leave_one_out(spark, d):
    return _r(residuals.leave_one_out(_panel(spark, d)).select("t", "asset", "peers"), "peers")


def resid_market(spark, d):
    return _r(residuals.residualize(_panel(spark, d), "market").select("t", "asset", "r"), "r")


def lagged_corr(spark, d):
    return _r(graphs.lagged_correlation(_panel(spark, d)), "c")


def signed_lead_lag(spark, d):
    return _r(_pairs(spark, d), "w")


def edges_quantile(spark, d):
    return _r(_edges(spark, d, 0.9), "weight", "signed")


def edges_absolute(spark, d):
    return _r(graphs.sparsify(_pairs(spark, d), "absolute", 0.15), "weight", "signed")


def edges_none(spark, d):
    return _r(graphs.sparsify(_pairs(spark, d), "none"), "weight", "signed")


def four_objects(spark, d):
    return _r(graphs.four_objects(_edges(spark, d)).select("src", "dst", "f_plain", "f_weighted", "m", "f_augmented"), "f_plain", "f_weighted", "f_augmented")


def forman_through(spark, d):
    return _r(graphs.forman(_edges(spark, d), flow="through").select("src", "dst", "f"), "f")


def triangles_cyclic(spark, d):
    return graphs.triangles(_edges(spark, d), "cyclic").select("src", "dst", "m")


def degree_table(spark, d):
    return graphs.degrees(_edges(spark, d), panels.week_panel(spark, d).select(F.col("asset_idx").alias("v")).distinct())


def line_graph(spark, d):
    return _r(graphs.line_graph(_edges(spark, d, 0.9)), "weight")


def spearman_curv_weight(spark, d):
    return _r(ranks.spearman(_r(graphs.four_objects(_edges(spark, d)), "f_augmented", "weight"), "f_augmented", "weight"), "rho")


def topk_jaccard(spark, d):
    return _r(ranks.topk_jaccard(_r(graphs.four_objects(_edges(spark, d)), "f_augmented", "weight"), "f_augmented", "weight", ["src", "dst"], 15), "jaccard")


def time_split(spark, d):
    t = panels.week_panel(spark, d).select("t").distinct()
    n = t.agg(F.count("*").alias("n"))
    part = F.when(F.col("t") < F.bround(F.col("n") * 0.6), "train").when(F.col("t") < F.bround(F.col("n") * 0.6) + F.bround(F.col("n") * 0.2), "val").otherwise("test")
    return t.crossJoin(F.broadcast(n)).select("t", part.alias("part"))


QUERIES = [
    panel_week, presence_filter, bars_last_price, bars_return_within_day, membership_interval_join, delisting_splice, universe_screen, dedupe_keep_last, missing_days_anti, calendar_ffill,
    market_factor, sector_factor, sector_leave_one_out, resid_market, lagged_corr, signed_lead_lag, edges_quantile, edges_absolute, edges_none, four_objects, forman_through, triangles_cyclic,
    degree_table, line_graph, spearman_curv_weight, topk_jaccard, time_split,
]
