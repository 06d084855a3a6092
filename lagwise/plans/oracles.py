"""DuckDB SQL for the queries of ``studies``, written from the definitions and not from the Spark plans."""

_SALES = """sales AS (
  SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS wk, n_name AS asset, r_name AS sector, sum(o_totalprice) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""
_PANEL = f"""{_SALES},
weeks AS (SELECT wk, row_number() OVER (ORDER BY wk) - 1 AS t FROM (SELECT DISTINCT wk FROM sales)),
assets AS (SELECT asset, sector, row_number() OVER (ORDER BY asset) - 1 AS asset_idx FROM (SELECT DISTINCT asset, sector FROM sales)),
grid AS (SELECT t, asset_idx, a.asset, a.sector, ln(1 + coalesce(v, 0)) AS x FROM weeks w CROSS JOIN assets a LEFT JOIN sales s ON s.wk = w.wk AND s.asset = a.asset),
panel AS (SELECT CAST(t - 1 AS INT) AS t, CAST(asset_idx AS INT) AS asset_idx, asset, sector, r
  FROM (SELECT *, x - lag(x) OVER (PARTITION BY asset ORDER BY t) AS r FROM grid) WHERE r IS NOT NULL)"""
_CORR = f"""{_PANEL},
lags AS (SELECT unnest([1, 2, 3, 5]) AS lag),
corr AS (SELECT lag, a.asset_idx AS i, b.asset_idx AS j,
    coalesce(CASE WHEN var_pop(a.r) > 0 AND var_pop(b.r) > 0 THEN covar_pop(a.r, b.r) / sqrt(var_pop(a.r) * var_pop(b.r)) END, 0.0) AS c
  FROM lags CROSS JOIN panel a JOIN panel b ON b.t = a.t + lag WHERE a.asset_idx <> b.asset_idx GROUP BY ALL)"""
_LEAD = f"""{_CORR},
s AS (SELECT x.lag, x.i, x.j, round(x.c - y.c, 9) AS s FROM corr x JOIN corr y ON x.lag = y.lag AND x.i = y.j AND x.j = y.i WHERE x.i < x.j),
pairs AS (SELECT i, j, s AS w, lag FROM s QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY abs(s) DESC, lag) = 1)"""


def _edges(cut: str, name: str = "edges") -> str:
    return f"""{_LEAD},
cut AS (SELECT {cut} AS cut FROM pairs),
{name} AS (SELECT CASE WHEN w > 0 THEN i ELSE j END AS src, CASE WHEN w > 0 THEN j ELSE i END AS dst, abs(w) AS weight, w AS signed, lag FROM pairs, cut WHERE abs(w) > cut AND w <> 0)"""


_E7, _E9 = _edges("quantile_cont(abs(w), 0.7)"), _edges("quantile_cont(abs(w), 0.9)")
_CURV = f"""{_E7},
nbr AS (SELECT DISTINCT * FROM (SELECT src AS a, dst AS x FROM edges UNION ALL SELECT dst, src FROM edges)),
m AS (SELECT e.src, e.dst, count(q.x) AS m FROM edges e LEFT JOIN nbr p ON p.a = e.src LEFT JOIN nbr q ON q.a = e.dst AND q.x = p.x GROUP BY ALL),
curv AS (SELECT e.src, e.dst, e.weight, m.m,
    2.0 - (SELECT count(*) FROM edges y WHERE y.dst = e.src) - (SELECT count(*) FROM edges y WHERE y.src = e.dst) AS f_plain,
    2.0 - sqrt(e.weight) * (coalesce((SELECT sum(1 / sqrt(y.weight)) FROM edges y WHERE y.dst = e.src), 0) + coalesce((SELECT sum(1 / sqrt(y.weight)) FROM edges y WHERE y.src = e.dst), 0)) AS f_weighted
  FROM edges e JOIN m USING (src, dst)),
four AS (SELECT src, dst, round(f_plain, 6) + 0.0 AS f_plain, round(f_weighted, 6) + 0.0 AS f_weighted, m, round(f_weighted + 3 * m, 6) + 0.0 AS f_augmented, round(weight, 6) + 0.0 AS weight FROM curv)"""
_BARS = """bars AS (SELECT user_id % 20 AS asset, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS bar, arg_max(value, struct_pack(a := ts, b := event_id)) AS price, sum(value) AS volume, count(*) AS n FROM events GROUP BY ALL)"""
_EDGE_OUT = "SELECT src, dst, round(weight, 6) + 0.0 AS weight, round(signed, 6) + 0.0 AS signed, lag FROM edges"

ORACLES = {
    "panel_week": f"WITH {_PANEL} SELECT t, asset_idx, asset, sector, round(r, 6) + 0.0 AS r FROM panel",
    "presence_filter": f"WITH {_SALES} SELECT asset, count(*) AS n FROM sales GROUP BY asset HAVING count(v) >= 0.9 * (SELECT count(DISTINCT wk) FROM sales)",
    "bars_last_price": f"WITH {_BARS} SELECT asset, bar, round(price, 6) + 0.0 AS price, round(volume, 6) + 0.0 AS volume, n FROM bars",
    "bars_return_within_day": f"WITH {_BARS} SELECT asset, bar, round(r, 6) + 0.0 AS r FROM (SELECT asset, bar, price / nullif(lag(price) OVER (PARTITION BY asset, CAST(bar AS DATE) ORDER BY bar), 0) - 1 AS r FROM bars) WHERE r IS NOT NULL",
    "membership_interval_join": """WITH m AS (SELECT o_custkey, min(o_orderdate) AS a, CASE WHEN o_custkey % 2 = 0 THEN CAST(CAST(max(o_orderdate) AS DATE) - 30 AS TIMESTAMP) END AS b FROM orders GROUP BY o_custkey)
SELECT o_orderkey, o.o_custkey FROM orders o JOIN m ON o.o_custkey = m.o_custkey AND o_orderdate >= a AND (b IS NULL OR o_orderdate <= b)""",
    "delisting_splice": """WITH k AS (SELECT l_orderkey, l_discount - 0.05 AS ret FROM lineitem WHERE l_linenumber = 1), z AS (SELECT l_orderkey, max(l_tax) AS last FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT k.l_orderkey, round(CASE WHEN ret IS NOT NULL AND last IS NOT NULL THEN (1 + ret) * (1 + last) - 1 WHEN last IS NOT NULL THEN last ELSE ret END, 6) + 0.0 AS r FROM k LEFT JOIN z USING (l_orderkey)""",
    "universe_screen": """SELECT p_brand, l_partkey, round(cap, 6) + 0.0 AS cap, days FROM (
  SELECT p_brand, l_partkey, avg(p_retailprice * l_quantity) AS cap, count(*) AS days FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
  HAVING avg(p_retailprice * l_quantity) BETWEEN 10000 AND 60000 AND count(*) >= 20 ORDER BY days DESC, l_partkey LIMIT 200)""",
    "dedupe_keep_last": "SELECT user_id, event_type, event_id, round(value, 6) + 0.0 AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "missing_days_anti": "SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE user_id % 7 = 1 EXCEPT SELECT DISTINCT CAST(ts AS DATE) FROM events WHERE user_id % 7 = 0",
    "calendar_ffill": f"""WITH {_SALES}, i AS (SELECT wk, sum(v) AS v FROM sales WHERE sector = 'ASIA' AND day(wk) % 3 <> 0 GROUP BY wk)
SELECT wk, round(last_value(v IGNORE NULLS) OVER (ORDER BY wk ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS v FROM (SELECT DISTINCT wk FROM sales) LEFT JOIN i USING (wk)""",
    "market_factor": f"WITH {_PANEL} SELECT t, round(avg(r), 6) + 0.0 AS market FROM panel GROUP BY t",
    "sector_factor": f"WITH {_PANEL} SELECT t, sector, round(avg(r), 6) + 0.0 AS factor FROM panel GROUP BY t, sector",
    "sector_leave_one_out": f"WITH {_PANEL} SELECT t, asset, round((sum(r) OVER w - r) / nullif(count(*) OVER w - 1, 0), 6) + 0.0 AS peers FROM panel WINDOW w AS (PARTITION BY t, sector)",
    "resid_market": f"""WITH {_PANEL}, f AS (SELECT t, avg(r) AS m FROM panel GROUP BY t), b AS (SELECT asset, coalesce(regr_slope(r, m), 0) AS b, avg(r) AS ar, avg(m) AS am FROM panel JOIN f USING (t) GROUP BY asset)
SELECT t, asset, round(r - ar - b * (m - am), 6) + 0.0 AS r FROM panel JOIN f USING (t) JOIN b USING (asset)""",
    "lagged_corr": f"WITH {_CORR} SELECT lag, i, j, round(c, 6) + 0.0 AS c FROM corr",
    "signed_lead_lag": f"WITH {_LEAD} SELECT i, j, round(w, 6) + 0.0 AS w, lag FROM pairs",
    "edges_quantile": f"WITH {_E9} {_EDGE_OUT}",
    "edges_absolute": f"WITH {_edges('max(0.15)')} {_EDGE_OUT}",
    "edges_none": f"WITH {_edges('max(0.0)')} {_EDGE_OUT}",
    "four_objects": f"WITH {_CURV} SELECT src, dst, f_plain, f_weighted, m, f_augmented FROM four",
    "forman_through": f"""WITH {_E7} SELECT src, dst, round(4.0 - sqrt(weight) * ((SELECT sum(1 / sqrt(y.weight)) FROM edges y WHERE y.src = e.src) + (SELECT sum(1 / sqrt(y.weight)) FROM edges y WHERE y.dst = e.dst)), 6) + 0.0 AS f FROM edges e""",
    "triangles_cyclic": f"WITH {_E7} SELECT e.src, e.dst, count(z.src) AS m FROM edges e LEFT JOIN edges y ON y.src = e.dst LEFT JOIN edges z ON z.src = y.dst AND z.dst = e.src GROUP BY ALL",
    "degree_table": f"WITH {_E7} SELECT v, (SELECT count(*) FROM edges WHERE dst = v) AS n_in, (SELECT count(*) FROM edges WHERE src = v) AS n_out FROM (SELECT DISTINCT asset_idx AS v FROM panel)",
    "line_graph": f"""WITH {_E9} SELECT a.src, a.dst, b.src AS src2, b.dst AS dst2, round(sqrt(a.weight * b.weight), 6) + 0.0 AS weight FROM edges a JOIN edges b
ON (a.src < b.src OR (a.src = b.src AND a.dst < b.dst)) AND (a.src IN (b.src, b.dst) OR a.dst IN (b.src, b.dst))""",
    "spearman_curv_weight": f"""WITH {_CURV}, k AS (SELECT rank() OVER (ORDER BY f_augmented) + (count(*) OVER (PARTITION BY f_augmented) - 1) / 2.0 AS a, rank() OVER (ORDER BY weight) + (count(*) OVER (PARTITION BY weight) - 1) / 2.0 AS b FROM four)
SELECT round(CASE WHEN count(*) >= 3 THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END, 6) + 0.0 AS rho, count(*) AS n FROM k""",
    "topk_jaccard": f"""WITH {_CURV}, k AS (SELECT row_number() OVER (ORDER BY f_augmented, src, dst) <= 15 AS a, row_number() OVER (ORDER BY weight, src, dst) <= 15 AS b FROM four)
SELECT round(coalesce(count(*) FILTER (a AND b) / nullif(count(*) FILTER (a OR b), 0), 0.0), 6) + 0.0 AS jaccard FROM k""",
    "time_split": f"""WITH {_PANEL}, n AS (SELECT count(DISTINCT t) AS n FROM panel)
SELECT DISTINCT t, CASE WHEN t < round_even(n * 0.6, 0) THEN 'train' WHEN t < round_even(n * 0.6, 0) + round_even(n * 0.2, 0) THEN 'val' ELSE 'test' END AS part FROM panel, n""",
}
