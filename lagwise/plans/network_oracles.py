"""DuckDB SQL for the queries of ``network`` that SQL can express, written from the definitions.

Without SQL: transport, communities by removal or merging, rewired nulls, unit roots, greedy sets, studies and what comes
from synthetic sources; tests hold these against brute force or a planted truth.
"""

from .oracles import _CURV, _E7, _PANEL
from .research_oracles import _NODES, _SIMPLE, _W, _WE, same_time, spear, weighted

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_LINKS = """ix AS (SELECT DISTINCT n_nationkey, asset_idx FROM nation JOIN panel ON n_name = asset),
tr AS (SELECT least(x.asset_idx, y.asset_idx) AS a, greatest(x.asset_idx, y.asset_idx) AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN ix x ON x.n_nationkey = s_nationkey JOIN ix y ON y.n_nationkey = c_nationkey WHERE x.asset_idx <> y.asset_idx GROUP BY ALL),
links AS (SELECT a, b FROM tr WHERE n > (SELECT avg(n) FROM tr))"""
_SHOT = f"""{_E7}, {_NODES}, nb AS (SELECT DISTINCT * FROM (SELECT src AS a, dst AS x FROM edges UNION ALL SELECT dst, src FROM edges)),
h AS (SELECT src AS v, 1 / sqrt(weight) AS h FROM edges UNION ALL SELECT dst, 1 / sqrt(weight) FROM edges), sv AS (SELECT v, sum(h) AS s FROM h GROUP BY v),
f AS (SELECT src, dst, 4 - sqrt(weight) * (p.s + q.s) + 3 * (SELECT count(*) FROM nb x JOIN nb y ON x.x = y.x WHERE x.a = src AND y.a = dst) AS f FROM edges JOIN sv p ON p.v = src JOIN sv q ON q.v = dst),
kept AS (SELECT src AS a, dst AS b FROM f WHERE f >= 0 UNION ALL SELECT dst, src FROM f WHERE f >= 0),
reach(v, x) AS (SELECT v, v FROM nodes UNION SELECT reach.v, kept.b FROM reach JOIN kept ON kept.a = reach.x), found AS (SELECT v, min(x) AS root FROM reach GROUP BY v)"""


def _partial(given: list[str]) -> str:
    """Rank correlation of the residuals of x and change on one or two regressors, by the normal equations of deviations."""
    z = given
    if len(z) == 1:
        fit = lambda c: f"{c} - avg({c}) OVER h - covar_pop({c}, {z[0]}) OVER h / nullif(var_pop({z[0]}) OVER h, 0) * ({z[0]} - avg({z[0]}) OVER h)"
    else:
        a, b = z
        det = f"(var_pop({a}) OVER h * var_pop({b}) OVER h - power(covar_pop({a}, {b}) OVER h, 2))"
        fit = lambda c: (
            f"{c} - avg({c}) OVER h - (covar_pop({c}, {a}) OVER h * var_pop({b}) OVER h - covar_pop({c}, {b}) OVER h * covar_pop({a}, {b}) OVER h) / {det} * ({a} - avg({a}) OVER h)"
            f" - (covar_pop({c}, {b}) OVER h * var_pop({a}) OVER h - covar_pop({c}, {a}) OVER h * covar_pop({a}, {b}) OVER h) / {det} * ({b} - avg({b}) OVER h)"
        )
    return f"SELECT h, round({fit('x')}, 9) AS fx, round({fit('change')}, 9) AS fy FROM ahead WINDOW h AS (PARTITION BY h)"


ORACLES = {
    "csv_wide_panel": f"WITH {_PANEL} SELECT t, asset, round(r, 6) + 0.0 AS r FROM panel",
    "csv_long_panel": "SELECT CAST(l_shipdate AS DATE) AS t, CAST(l_suppkey AS BIGINT) AS asset, round(avg(l_discount - 0.05), 6) + 0.0 AS r FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL",
    "csv_matrix_panel": f"WITH {_PANEL} SELECT CAST(t AS INT) AS t, asset, CASE WHEN (t + asset_idx) % 11 <> 0 THEN round(r, 6) ELSE 0.0 END AS r FROM panel WHERE t < 40",
    "csv_assemble": """WITH m AS (SELECT o_custkey AS k, CAST(min(o_orderdate) AS DATE) AS a, CASE WHEN o_custkey % 2 = 0 THEN CAST(max(o_orderdate) AS DATE) - 30 END AS b FROM orders GROUP BY o_custkey),
f AS (SELECT CAST(o_orderdate AS DATE) AS t, o_custkey AS asset, o_totalprice / 1e6 AS r FROM orders JOIN m ON k = o_custkey WHERE CAST(o_orderdate AS DATE) >= a AND (b IS NULL OR CAST(o_orderdate AS DATE) <= b))
SELECT t, CAST(asset AS BIGINT) AS asset, CASE WHEN asset % 5 <> 0 THEN n_name ELSE 'OTHER' END AS sector, round(avg(r), 6) + 0.0 AS r FROM f JOIN customer ON c_custkey = asset JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""",
    "csv_headerless": "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, CAST(n_regionkey AS BIGINT) AS rest FROM nation",
    "csv_series": "SELECT CAST(ts AS DATE) AS t, round(avg(value), 6) + 0.0 AS v FROM events WHERE day(ts) % 5 <> 0 GROUP BY ALL",
    "catalog_tables": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', 'parquet')" for t in _TABLES) + ") x(name, format)",
    "catalog_describe": "SELECT CAST(ordinal_position - 1 AS INT) AS position, column_name AS column FROM information_schema.columns WHERE table_name = 'nation'",
    "whole_ids": "SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS id, 'K-' || s_suppkey AS name FROM supplier",
    "label_chain": "SELECT c_custkey AS asset, CASE WHEN c_custkey % 2 = 0 THEN r_name WHEN c_custkey % 3 <> 0 THEN n_name ELSE 'OTHER' END AS sector FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "cross_sector_edges": f"WITH {_E7}, sec AS (SELECT DISTINCT asset_idx, sector FROM panel WHERE asset_idx % 7 <> 0) SELECT src, dst FROM edges LEFT JOIN sec x ON x.asset_idx = src LEFT JOIN sec y ON y.asset_idx = dst WHERE x.sector IS NULL OR y.sector IS NULL OR x.sector <> y.sector",
    "compound_returns": f"WITH {_PANEL}, {_SIMPLE} SELECT CAST(t // 13 AS BIGINT) AS wid, asset_idx, round(product(1 + r) - 1, 6) + 0.0 AS r FROM simple GROUP BY ALL",
    "link_rates": f"""WITH {_CURV}, {_NODES}, {_LINKS}, {same_time("panel", "ct")},
every AS (SELECT x.v AS a, y.v AS b FROM nodes x JOIN nodes y ON x.v < y.v),
br AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM curv JOIN nodes x ON x.v = src JOIN nodes y ON y.v = dst WHERE x.label <> y.label ORDER BY round(f_weighted + 3 * m, 9), src, dst LIMIT 50),
eg AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM edges), co AS (SELECT eg.* FROM eg JOIN ct ON i = a AND j = b ORDER BY round(abs(c), 9) DESC, a, b LIMIT 50),
k AS (SELECT 'all pairs' AS kind, * FROM every UNION ALL SELECT 'bridges', * FROM br UNION ALL SELECT 'correlated', * FROM co UNION ALL SELECT 'edges', * FROM eg),
r AS (SELECT kind, count(*) AS n, avg(CASE WHEN links.a IS NULL THEN 0.0 ELSE 1.0 END) AS rate FROM k LEFT JOIN links USING (a, b) GROUP BY kind)
SELECT kind, n, round(rate, 6) + 0.0 AS rate, round(rate / nullif((SELECT rate FROM r WHERE kind = 'all pairs'), 0), 6) + 0.0 AS enrichment FROM r""",
    "lazy_measures": f"""WITH {_E7}, b AS (SELECT x, v, max(w) AS w FROM (SELECT src AS x, dst AS v, weight AS w FROM edges UNION ALL SELECT dst, src, weight FROM edges) GROUP BY ALL)
SELECT x, v, round(0.75 * w / sum(w) OVER (PARTITION BY x), 6) + 0.0 AS mass FROM b UNION ALL SELECT DISTINCT x, x, 0.25 FROM b""",
    "afrc_one_shot": f"WITH RECURSIVE {_SHOT} SELECT v, root FROM found",
    "rand_index": f"""WITH RECURSIVE {_SHOT}, cells AS (SELECT root AS a, label AS b, count(*) AS n FROM found JOIN nodes USING (v) GROUP BY ALL),
x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS cells, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY a)) AS rows_, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY b)) AS columns_, (SELECT sum(n) FROM cells) AS n)
SELECT round(coalesce((cells - rows_ * columns_ / (n * (n - 1) / 2)) / nullif((rows_ + columns_) / 2 - rows_ * columns_ / (n * (n - 1) / 2), 0), 1), 6) + 0.0 AS ari FROM x""",
    "candidate_sample": f"WITH {_PANEL}, v AS (SELECT DISTINCT asset_idx AS v FROM panel) SELECT x.v AS a, y.v AS b FROM v x JOIN v y ON x.v < y.v ORDER BY md5('7-' || x.v || '-' || y.v), a, b LIMIT 100",
    "argmin_edge": f"WITH {_CURV} SELECT src, dst, round(f_weighted + 3 * m, 6) + 0.0 AS f FROM curv ORDER BY round(f_weighted + 3 * m, 9), src, dst LIMIT 1",
    "index_lead": f"""WITH {_W}, ix AS (SELECT t, stddev_samp(r) AS v FROM panel WHERE sector = 'ASIA' GROUP BY t), {same_time("rows_", "wc", "wid")}, cp AS (SELECT wid, avg(abs(c)) AS x FROM wc GROUP BY wid),
vol AS (SELECT wid, stddev_samp(m) AS vol FROM market JOIN w ON t >= a AND t < b GROUP BY wid),
ahead AS (SELECT h, x, q.v - p.v AS change, p.v AS now, vol FROM w JOIN cp USING (wid) JOIN vol USING (wid) JOIN ix p ON p.t = b - 1 JOIN (SELECT unnest([1, 5, 10, 21]) AS h) ON true JOIN ix q ON q.t = b - 1 + h),
one AS ({_partial(["now"])}), two AS ({_partial(["now", "vol"])}), o AS ({spear("one", "fx", "fy", "h")}), s AS ({spear("two", "fx", "fy", "h")})
SELECT h, o.rho AS given_level, o.n, s.rho AS given_both FROM o JOIN s USING (h)""",
    "node_vol_rank": f"""WITH {_W}, {_WE(0.7)}, {weighted("we", "wf", "wid")}, nd AS (SELECT wid, v AS asset_idx, round(avg(f), 9) AS c, count(*) AS d FROM (SELECT wid, src AS v, f FROM wf UNION ALL SELECT wid, dst, f FROM wf) GROUP BY ALL),
lv AS (SELECT wid, asset_idx, round(stddev_samp(r), 9) AS s FROM panel JOIN w ON t >= b AND t < b + 21 GROUP BY ALL), k AS (SELECT * FROM nd JOIN lv USING (wid, asset_idx)),
x AS ({spear("k", "c", "s", "wid")}), y AS ({spear("k", "d", "s", "wid")}) SELECT wid, x.rho AS by_curvature, x.n, y.rho AS by_degree FROM x JOIN y USING (wid)""",
    "month_means": f"""WITH {_PANEL}, p AS (SELECT t // 4 AS wid, * EXCLUDE (asset, sector) FROM panel), {same_time("p", "pc", "wid")}, c AS (SELECT wid, avg(abs(c)) AS x, DATE '1992-01-06' + CAST(wid * 28 AS INT) AS day FROM pc GROUP BY wid),
k AS (SELECT *, month(day) AS month, day BETWEEN DATE '1994-01-01' AND DATE '1994-06-30' OR day BETWEEN DATE '1997-01-01' AND DATE '1997-03-31' AS crisis FROM c)
SELECT CAST(month AS INT) AS month, round(avg(x), 6) + 0.0 AS coupling, round(avg(x) FILTER (crisis), 6) + 0.0 AS in_crisis, round(avg(x) FILTER (NOT crisis), 6) + 0.0 AS calm, count(*) AS n FROM k GROUP BY month""",
}
