"""DuckDB SQL for the queries of ``research``, written from the definitions and not from the Spark plans."""

from .oracles import _CURV, _E7, _E9, _PANEL

_CASE_CORR = "CASE WHEN var_pop({x}) > 0 AND var_pop({y}) > 0 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END"


def corr(x: str, y: str) -> str:
    return _CASE_CORR.format(x=x, y=y)


def lagged(src: str, name: str, key: str = "", lags: str = "1, 2, 3, 5") -> str:
    k, on = (f"a.{key} AS {key}, ", f" AND a.{key} = b.{key}") if key else ("", "")
    return f"""{name} AS (SELECT {k}lag, a.asset_idx AS i, b.asset_idx AS j, coalesce({corr("a.r", "b.r")}, 0.0) AS c
  FROM (SELECT unnest([{lags}]) AS lag) JOIN {src} a ON true JOIN {src} b ON b.t = a.t + lag{on} WHERE a.asset_idx <> b.asset_idx GROUP BY ALL)"""


def graph(cor: str, name: str, q: float, key: str = "") -> str:
    """Pairs and edges of lagged correlations."""
    k, on, part = (f"x.{key}, ", f" AND x.{key} = y.{key}", f"{key}, ") if key else ("", "", "")
    cut = f"quantile_cont(abs(w), {q}) OVER (PARTITION BY {key})" if key else f"quantile_cont(abs(w), {q}) OVER ()"
    return f"""{name}_s AS (SELECT {k}x.lag, x.i, x.j, round(x.c - y.c, 9) AS s FROM {cor} x JOIN {cor} y ON x.lag = y.lag AND x.i = y.j AND x.j = y.i{on} WHERE x.i < x.j),
{name}_p AS (SELECT {part}i, j, s AS w, lag FROM {name}_s QUALIFY row_number() OVER (PARTITION BY {part}i, j ORDER BY abs(s) DESC, lag) = 1),
{name} AS (SELECT {part}CASE WHEN w > 0 THEN i ELSE j END AS src, CASE WHEN w > 0 THEN j ELSE i END AS dst, abs(w) AS weight, w AS signed, lag
  FROM (SELECT *, {cut} AS cut FROM {name}_p) WHERE abs(w) > cut AND w <> 0)"""


def same_time(src: str, name: str, key: str = "") -> str:
    k, on = (f"a.{key} AS {key}, ", f" AND a.{key} = b.{key}") if key else ("", "")
    return f"{name} AS (SELECT {k}a.asset_idx AS i, b.asset_idx AS j, {corr('a.r', 'b.r')} AS c FROM {src} a JOIN {src} b ON a.t = b.t AND a.asset_idx < b.asset_idx{on} GROUP BY ALL)"


def ranked(x: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part}, {x}" if part else f"PARTITION BY {x}"
    return f"(rank() OVER ({p}ORDER BY {x}) + (count(*) OVER ({q}) - 1) / 2.0)"


def out(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


def spear(src: str, x: str, y: str, part: str = "") -> str:
    p = f"{part}, " if part else ""
    g = f" GROUP BY {part}" if part else ""
    return f"SELECT {p}round(CASE WHEN count(*) >= 3 THEN {corr('a', 'b')} END, 6) + 0.0 AS rho, count(*) AS n FROM (SELECT {p}{ranked(x, part)} AS a, {ranked(y, part)} AS b FROM {src}){g}"


def partial(src: str, x: str, y: str, z: str) -> str:
    """Linear residuals on z, then their ranks."""
    fit = lambda c: f"round({c} - (SELECT regr_intercept({c}, {z}) FROM {src}) - (SELECT regr_slope({c}, {z}) FROM {src}) * {z}, 9)"
    return f", left_ AS (SELECT {fit(x)} AS lx, {fit(y)} AS ly FROM {src}) {spear('left_', 'lx', 'ly')}"


_NODES = "nodes AS (SELECT DISTINCT asset_idx AS v, sector AS label FROM panel)"
_SPLIT = f"""{_PANEL}, n AS (SELECT count(DISTINCT t) AS n FROM panel),
train AS (SELECT panel.* FROM panel, n WHERE t < round_even(n * 0.6, 0)), test AS (SELECT panel.* FROM panel, n WHERE t >= round_even(n * 0.6, 0) + round_even(n * 0.2, 0)),
{lagged("train", "tl")}"""
_ORIENT = "(SELECT {a} AS a, {b} AS b, tl.i AS leader, tl.j AS lagger, lag FROM {src} JOIN tl ON (tl.i = {a} AND tl.j = {b}) OR (tl.i = {b} AND tl.j = {a}) QUALIFY row_number() OVER (PARTITION BY {a}, {b} ORDER BY round(abs(tl.c), 9) DESC, lag, tl.i = {a} DESC) = 1)"
_CHOSEN = f"""{_SPLIT}, {same_time("train", "ct")}, top AS (SELECT i AS x, j AS y FROM ct ORDER BY round(abs(c), 9) DESC NULLS LAST, i, j LIMIT 20),
pairs AS {_ORIENT.format(a="x", b="y", src="top")}"""
_SIGNS = f"signs AS (SELECT leader, lagger, lag, CASE WHEN round({corr('p.r', 'q.r')}, 9) < 0 THEN -1.0 ELSE 1.0 END AS s FROM pairs JOIN train p ON p.asset_idx = leader JOIN train q ON q.asset_idx = lagger AND q.t = p.t + lag GROUP BY ALL)"


def forecast(src: str, key: str = "", same: str = "") -> str:
    k = f"p.{key} AS {key}, " if key else ""
    return f"fc AS (SELECT {k}leader, lagger, lag, round(s * p.r, 9) AS fore, round(q.r, 9) AS real FROM signs JOIN {src} p ON p.asset_idx = leader JOIN {src} q ON q.asset_idx = lagger AND q.t = p.t + lag{same})"


def pair_ic(key: str = "") -> str:
    k = f"{key}, " if key else ""
    g = f"{k}leader, lagger, lag"
    return f"ic AS (SELECT {g}, {corr('a', 'b')} AS ic, count(*) AS n FROM (SELECT {g}, {ranked('fore', g)} AS a, {ranked('real', g)} AS b FROM fc) GROUP BY ALL HAVING count(*) >= 5 AND {corr('a', 'b')} IS NOT NULL)"


def blocks(src: str, boots: int, block: int) -> str:
    return f"""nt AS (SELECT max(t) + 1 AS n FROM {src}),
starts AS (SELECT boot, k, CAST('0x' || substr(md5('0-' || boot || '-' || k), 1, 8) AS BIGINT) % greatest(n - {block}, 1) AS start, n FROM nt, range({boots}) r(boot), range(100) s(k) WHERE k * {block} < n),
boots AS (SELECT boot, k * {block} + o AS t, asset_idx, r FROM starts, range({block}) u(o), {src} p WHERE start + o < n AND k * {block} + o < n AND p.t = start + o)"""


def weighted(edges: str, name: str, key: str) -> str:
    return f"""{name} AS (SELECT e.{key}, e.src, e.dst, 2 - sqrt(e.weight) * (coalesce((SELECT sum(1 / sqrt(y.weight)) FROM {edges} y WHERE y.{key} = e.{key} AND y.dst = e.src), 0)
  + coalesce((SELECT sum(1 / sqrt(y.weight)) FROM {edges} y WHERE y.{key} = e.{key} AND y.src = e.dst), 0)) AS f FROM {edges} e)"""


_W = f"""{_PANEL}, np AS (SELECT max(t) + 1 AS n FROM panel), w AS (SELECT k AS wid, 21 * k AS a, 63 + 21 * k AS b FROM np, range(100) r(k) WHERE 63 + 21 * k < n - 21),
rows_ AS (SELECT wid, panel.* FROM panel JOIN w ON t >= a AND t < b), market AS (SELECT t, avg(r) AS m FROM panel GROUP BY t)"""
_WE = lambda q: f"{lagged('rows_', 'wl', 'wid')}, {graph('wl', 'we', q, 'wid')}"
_VOL = f"""{_W}, {_WE(0.9)}, {weighted("we", "wf", "wid")}, {same_time("rows_", "wc", "wid")},
ce AS (SELECT wid, i, j FROM wc WHERE abs(c) > 0.2), deg AS (SELECT wid, v, count(*) AS d FROM (SELECT wid, i AS v FROM ce UNION ALL SELECT wid, j FROM ce) GROUP BY ALL),
rolled AS (SELECT wid, round(curv_corr, 6) + 0.0 AS curv_corr, n_edges, round(curv_ll, 6) + 0.0 AS curv_ll, round(vol_now, 6) + 0.0 AS vol_now, round(vol_fwd, 6) + 0.0 AS vol_fwd
  FROM (SELECT ce.wid, avg(4 - p.d - q.d) AS curv_corr, count(*) AS n_edges FROM ce JOIN deg p ON p.wid = ce.wid AND p.v = ce.i JOIN deg q ON q.wid = ce.wid AND q.v = ce.j GROUP BY ALL)
  JOIN (SELECT wid, avg(f) AS curv_ll FROM wf GROUP BY ALL) USING (wid) JOIN (SELECT wid, stddev_samp(m) AS vol_now FROM market JOIN w ON t >= a AND t < b GROUP BY ALL) USING (wid)
  JOIN (SELECT wid, stddev_samp(m) AS vol_fwd FROM market JOIN w ON t >= b AND t < b + 21 GROUP BY ALL) USING (wid))"""
_SIMPLE = "simple AS (SELECT t, asset_idx, greatest(least(exp(r) - 1, 1.0), -0.5) AS r FROM panel)"
_NEXT = f"{_SIMPLE}, nxt AS (SELECT wid, asset_idx, product(1 + r) - 1 AS nxt FROM simple JOIN w ON t >= b AND t < b + 21 GROUP BY ALL)"


def long_short(least: int) -> str:
    return f"{_LS} WHERE n >= {least} GROUP BY wid"


_LS = """SELECT wid, round(avg(nxt) FILTER (up > n - greatest(n // 5, 3)) - avg(nxt) FILTER (up <= greatest(n // 5, 3)), 6) + 0.0 AS spread
FROM (SELECT *, count(*) OVER (PARTITION BY wid) AS n, row_number() OVER (PARTITION BY wid ORDER BY score, asset_idx) AS up FROM scores)"""
_PIVOT = """SELECT year(o_orderdate) AS y, r_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _two(f1: str, f2: str) -> str:
    """Residual of r on two columns of ``reg`` by asset."""
    return f"""dm AS (SELECT t, asset, r - avg(r) OVER w AS r, {f1} - avg({f1}) OVER w AS x, {f2} - avg({f2}) OVER w AS z FROM reg WINDOW w AS (PARTITION BY asset)),
co AS (SELECT asset, (sum(r * x) * sum(z * z) - sum(r * z) * sum(x * z)) / (sum(x * x) * sum(z * z) - sum(x * z) * sum(x * z)) AS bx, (sum(r * z) * sum(x * x) - sum(r * x) * sum(x * z)) / (sum(x * x) * sum(z * z) - sum(x * z) * sum(x * z)) AS bz FROM dm GROUP BY asset)
SELECT t, asset, round(r - bx * x - bz * z, 6) + 0.0 AS r FROM dm JOIN co USING (asset)"""



def _grid() -> str:
    """All candidates: panels, cuts and objects."""
    parts = [f"""{_PANEL}, fm AS (SELECT t, avg(r) AS m FROM panel GROUP BY t), b AS (SELECT asset, coalesce(regr_slope(r, m), 0) AS b, avg(r) AS ar, avg(m) AS am FROM panel JOIN fm USING (t) GROUP BY asset),
resid AS (SELECT t, asset_idx, r - ar - b * (m - am) AS r FROM panel JOIN fm USING (t) JOIN b USING (asset)), {lagged("panel", "l_none")}, {lagged("resid", "l_market")}"""]
    rows = []
    for name in ("none", "market"):
        for q in (0.7, 0.9):
            e = f"e_{name}_{int(q * 10)}"
            parts.append(f"""{graph(f"l_{name}", e, q)}, {e}_n AS (SELECT DISTINCT * FROM (SELECT src AS a, dst AS x FROM {e} UNION ALL SELECT dst, src FROM {e})),
{e}_f AS (SELECT round(e.weight, 6) AS weight, round(fw, 6) AS f_weighted, round(fw + 3 * m, 6) AS f_augmented FROM (SELECT e.weight,
  2.0 - sqrt(e.weight) * (coalesce((SELECT sum(1 / sqrt(y.weight)) FROM {e} y WHERE y.dst = e.src), 0) + coalesce((SELECT sum(1 / sqrt(y.weight)) FROM {e} y WHERE y.src = e.dst), 0)) AS fw,
  (SELECT count(*) FROM {e}_n p JOIN {e}_n q ON p.x = q.x WHERE p.a = e.src AND q.a = e.dst) AS m FROM {e} e) e)""")
            rows += [f"SELECT '{name}' AS residual, CAST({q} AS DOUBLE) AS q, '{o}' AS object, rho, n FROM ({spear(f'{e}_f', o, 'weight')})" for o in ("f_weighted", "f_augmented")]
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(rows)


_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(upper({x}), '[^A-Z0-9 ]', ' ', 'g'), '\b(CL A|CORP|INC|CO|LTD|PLC|GROUP|HOLDINGS)\b', ' ', 'g'), ' +', ' ', 'g'))"

_CENTRAL = f"""{_W}, {_WE(0.9)}, {weighted("we", "wf", "wid")}, {_NEXT}, sc AS (SELECT wid, v AS asset_idx, round(-avg(f), 9) AS score FROM (SELECT wid, src AS v, f FROM wf UNION ALL SELECT wid, dst, f FROM wf) GROUP BY ALL),
scores AS (SELECT * FROM nxt JOIN sc USING (wid, asset_idx))"""
_MOMENTUM = f"""{_W}, {_WE(0.7)}, {_NEXT}, mv AS (SELECT wid, asset_idx, product(1 + r) - 1 AS move FROM simple JOIN w ON t >= b - 21 AND t < b GROUP BY ALL), {_NODES},
sc AS (SELECT we.wid, we.dst AS asset_idx, round(avg(sign(signed) * move), 9) AS score FROM we JOIN mv ON mv.wid = we.wid AND mv.asset_idx = we.src JOIN nodes x ON x.v = we.src JOIN nodes y ON y.v = we.dst WHERE x.label <> y.label GROUP BY ALL),
scores AS (SELECT * FROM nxt JOIN sc USING (wid, asset_idx))"""
_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")

ORACLES = {
    "panel_pivot_avg": f"SELECT y, {', '.join(f'round(avg(o_totalprice) FILTER (r_name = {chr(39)}{r}{chr(39)}), 6) + 0.0 AS {r.lower().replace(chr(32), chr(95))}' for r in _REGIONS)} FROM ({_PIVOT}) GROUP BY y",
    "panel_unpivot": f"SELECT y, replace(lower(r_name), ' ', '_') AS region, round(avg(o_totalprice), 6) + 0.0 AS v FROM ({_PIVOT}) GROUP BY ALL",
    "bars_volume": "SELECT user_id % 20 AS asset, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') AS bar, round(sum(value), 6) + 0.0 AS volume, count(*) AS n FROM events GROUP BY ALL",
    "effective_link_join": """WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS a FROM orders), l AS (SELECT *, lead(a) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey) - 1 AS b FROM o)
SELECT l_orderkey, l_linenumber, l.o_orderkey AS link FROM lineitem JOIN o ON l_orderkey = o.o_orderkey JOIN l ON l.o_custkey = o.o_custkey AND CAST(l_shipdate AS DATE) >= l.a AND (l.b IS NULL OR CAST(l_shipdate AS DATE) <= l.b)""",
    "name_normalize": f"SELECT p_partkey, {_NORMAL.format(x=chr(40) + 'concat_ws(' + chr(39) + ' ' + chr(39) + ', p_name, ' + chr(39) + 'Corp. CL A' + chr(39) + '))')} AS name FROM part",
    "fuzzy_contains_join": f"""SELECT name, arg_min(word, struct_pack(a := k, b := word)) AS word FROM (SELECT DISTINCT {_NORMAL.format(x='p_name')} AS name FROM part)
JOIN (SELECT word, min(p_partkey) AS k FROM (SELECT unnest(string_split(upper(p_name), ' ')) AS word, p_partkey FROM part) GROUP BY word) ON contains(name, word) OR contains(word, name) WHERE length(name) >= 4 AND length(word) >= 4 GROUP BY name""",
    "resid_market_sector": f"""WITH {_PANEL}, reg AS (SELECT t, asset, r, avg(r) OVER (PARTITION BY t) AS m, coalesce((sum(r) OVER s - r) / nullif(count(*) OVER s - 1, 0), 0) AS p FROM panel WINDOW s AS (PARTITION BY t, sector)), {_two("m", "p")}""",
    "resid_factors": f"""WITH {_PANEL}, reg AS (SELECT t, asset, r, avg(r) FILTER (sector = 'ASIA') OVER (PARTITION BY t) AS f1, avg(r) FILTER (sector = 'EUROPE') OVER (PARTITION BY t) AS f2 FROM panel), {_two("f1", "f2")}""",
    "lagged_corr_grouped": f"""WITH {_PANEL}, z AS (SELECT t, asset_idx, t // 10 AS g, coalesce((r - avg(r) OVER w) / nullif(stddev_samp(r) OVER w, 0), 0) AS z FROM panel WINDOW w AS (PARTITION BY asset_idx))
SELECT lag, a.asset_idx AS i, b.asset_idx AS j, round(sum(a.z * b.z) / (count(*) - 1), 6) + 0.0 AS c FROM (SELECT unnest([1, 2]) AS lag) JOIN z a ON true JOIN z b ON b.t = a.t + lag AND a.g = b.g WHERE a.asset_idx <> b.asset_idx GROUP BY ALL""",
    "forman_plain": f"WITH {_CURV} SELECT src, dst, f_plain AS f FROM four",
    "forman_weighted": f"WITH {_CURV} SELECT src, dst, f_weighted AS f FROM four",
    "forman_undirected": f"WITH {_E7}, h AS (SELECT src AS v, 1 / sqrt(weight) AS h FROM edges UNION ALL SELECT dst, 1 / sqrt(weight) FROM edges), sv AS (SELECT v, sum(h) AS s FROM h GROUP BY v) SELECT src, dst, round(4 - sqrt(weight) * (p.s + q.s), 6) + 0.0 AS f FROM edges JOIN sv p ON p.v = src JOIN sv q ON q.v = dst",
    "triangles_common": f"WITH {_CURV} SELECT src, dst, m FROM four",
    "forman_augmented": f"WITH {_CURV} SELECT src, dst, f_augmented FROM four",
    "corr_graph_forman": f"WITH {_PANEL}, {same_time('panel', 'c')}, e AS (SELECT i, j FROM c WHERE abs(c) > 0.2), dg AS (SELECT v, count(*) AS d FROM (SELECT i AS v FROM e UNION ALL SELECT j FROM e) GROUP BY v) SELECT i AS src, j AS dst, round(4.0 - p.d - q.d, 6) + 0.0 AS f FROM e JOIN dg p ON p.v = i JOIN dg q ON q.v = j",
    "node_curvature": f"WITH {_CURV} SELECT v, round(avg(f), 6) + 0.0 AS curvature FROM (SELECT src AS v, f_weighted + 3 * m AS f FROM (SELECT src, dst, f_weighted, m FROM curv) UNION ALL SELECT dst, f_weighted + 3 * m FROM curv) GROUP BY v",
    "clustering_coeff": f"""WITH {_CURV}, {_NODES}, d AS (SELECT a AS v, count(*) AS d FROM nbr GROUP BY a), k AS (SELECT p.a AS v, count(*) AS twice FROM nbr p JOIN nbr q ON p.a = q.a AND p.x <> q.x JOIN nbr z ON z.a = p.x AND z.x = q.x GROUP BY p.a)
SELECT v, round(CASE WHEN d >= 2 THEN coalesce(twice, 0) / (d * (d - 1)) ELSE 0 END, 6) + 0.0 AS c FROM nodes LEFT JOIN d USING (v) LEFT JOIN k USING (v)""",
    "triangle_density": f"""WITH {_CURV}, {_NODES}, same AS (SELECT nbr.* FROM nbr JOIN nodes p ON p.v = a JOIN nodes q ON q.v = x WHERE p.label = q.label),
d AS (SELECT a AS v, count(*) AS d FROM same GROUP BY a), k AS (SELECT p.a AS v, count(*) AS twice FROM same p JOIN same q ON p.a = q.a AND p.x <> q.x JOIN same z ON z.a = p.x AND z.x = q.x GROUP BY p.a),
c AS (SELECT label, avg(CASE WHEN d >= 2 THEN coalesce(twice, 0) / (d * (d - 1)) ELSE 0 END) AS c FROM nodes LEFT JOIN d USING (v) LEFT JOIN k USING (v) GROUP BY label),
r AS (SELECT count(*) AS n_edges, avg(CAST(m = 0 AS INT)) AS zero, avg(m) AS mean_m, quantile_cont(m, 0.5) AS median_m, CAST(sum(m) / 3 AS BIGINT) AS n_triangles FROM four),
whole AS (SELECT r.*, coalesce((SELECT sum(twice) / 6 FROM k) / nullif(n_triangles, 0), 0) AS within, (SELECT avg(c) FROM c) AS clustering FROM r)
SELECT n_edges, {out("zero", "mean_m", "median_m")}, n_triangles, {out("within", "clustering")}, (zero > 0.5 OR within < 0.25) AS sparse FROM whole""",
    "density_sweep": " UNION ALL ".join(
        f"""(WITH {_PANEL}, {lagged("panel", "l")}, {graph("l", "e", q)}, nb AS (SELECT DISTINCT * FROM (SELECT src AS a, dst AS x FROM e UNION ALL SELECT dst, src FROM e)),
k AS (SELECT (SELECT count(*) FROM nb p JOIN nb q ON p.x = q.x WHERE p.a = e.src AND q.a = e.dst) AS m FROM e) SELECT CAST({q} AS DOUBLE) AS q, count(*) AS n_edges, round(avg(CAST(m = 0 AS INT)), 6) + 0.0 AS zero, round(avg(m), 6) + 0.0 AS mean_m FROM k)"""
        for q in (0.7, 0.8, 0.9)
    ),
    "curvature_gap": f"""WITH {_CURV}, {_NODES}, x AS (SELECT f_weighted + 3 * m AS x, p.label = q.label AS same FROM curv JOIN nodes p ON p.v = src JOIN nodes q ON q.v = dst)
SELECT round((avg(x) FILTER (same) - avg(x) FILTER (NOT same)) / sqrt((var_samp(x) FILTER (same) + var_samp(x) FILTER (NOT same)) / 2), 6) + 0.0 AS gap, round(avg(x) FILTER (same), 6) + 0.0 AS within, round(avg(x) FILTER (NOT same), 6) + 0.0 AS across, count(*) FILTER (same) AS n_within, count(*) FILTER (NOT same) AS n_across FROM x""",
    "modularity_by_region": f"""WITH {_E7}, {_NODES}, e AS (SELECT p.label AS a, q.label AS b, weight AS x FROM edges JOIN nodes p ON p.v = src JOIN nodes q ON q.v = dst), m AS (SELECT sum(x) AS m FROM e)
SELECT round(sum(l / m - power(d / (2.0 * m), 2)), 6) + 0.0 AS q FROM (SELECT g.label, (SELECT coalesce(sum(x), 0) FROM e WHERE a = g.label AND b = g.label) AS l, (SELECT coalesce(sum(x), 0) FROM e WHERE a = g.label) + (SELECT coalesce(sum(x), 0) FROM e WHERE b = g.label) AS d FROM (SELECT DISTINCT label FROM nodes) g), m""",
    "components_after_cut": f"""WITH RECURSIVE {_CURV}, {_NODES}, kept AS (SELECT src AS a, dst AS b FROM curv WHERE f_plain >= -5 UNION ALL SELECT dst, src FROM curv WHERE f_plain >= -5),
reach(v, x) AS (SELECT v, v FROM nodes UNION SELECT reach.v, kept.b FROM reach JOIN kept ON kept.a = reach.x) SELECT v, min(x) AS root FROM reach GROUP BY v""",
    "edge_abs_corr": f"WITH {_E9}, {same_time('panel', 'ct')} SELECT src, dst, round(abs(c), 6) + 0.0 AS abs_rho FROM edges JOIN ct ON i = least(src, dst) AND j = greatest(src, dst)",
    "resid_orthogonalization": f"""WITH {_CURV}, x AS (SELECT f_plain, f_weighted, f_weighted + 3 * m AS f_augmented, (SELECT count(*) FROM edges y WHERE y.dst = curv.src) AS a, (SELECT count(*) FROM edges y WHERE y.src = curv.dst) AS b FROM curv),
u AS (UNPIVOT x ON f_plain, f_weighted, f_augmented INTO NAME object VALUE y), fit AS (SELECT object, corr(y, a) AS p, corr(y, b) AS q, corr(a, b) AS c FROM u GROUP BY object)
SELECT object, round((p * p + q * q - 2 * p * q * c) / (1 - c * c), 6) + 0.0 AS r2, (p * p + q * q - 2 * p * q * c) / (1 - c * c) > 0.999 AS degree_identity FROM fit""",
    "bh_adjust": f"""WITH {_E9}, p AS (SELECT src, dst, round(1 / (1 + 200 * weight), 6) AS p FROM edges), k AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, src, dst) AS raw FROM p), adj AS (SELECT src, dst, p, least(1.0, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS p_adj FROM k)
SELECT src, dst, round(p, 6) + 0.0 AS p, round(p_adj, 6) + 0.0 AS p_adj, p_adj <= 0.05 AS reject FROM adj""",
    "walk_forward_windows": f'WITH {_PANEL}, n AS (SELECT max(t) + 1 AS n FROM panel) SELECT CAST(k AS INT) AS wid, 26 * k AS start, 104 + 26 * k AS "end", 130 + 26 * k AS test_end FROM n, range(100) r(k) WHERE 26 * k + 104 + 26 <= n',
    "select_curvature": f"""WITH {_SPLIT}, {graph("tl", "e", 0.7)}, nb AS (SELECT DISTINCT * FROM (SELECT src AS a, dst AS x FROM e UNION ALL SELECT dst, src FROM e)),
f AS (SELECT src, dst, lag, 2.0 - sqrt(e.weight) * (coalesce((SELECT sum(1 / sqrt(y.weight)) FROM e y WHERE y.dst = e.src), 0) + coalesce((SELECT sum(1 / sqrt(y.weight)) FROM e y WHERE y.src = e.dst), 0)) + 3 * (SELECT count(*) FROM nb p JOIN nb q ON p.x = q.x WHERE p.a = e.src AND q.a = e.dst) AS f FROM e)
SELECT src AS leader, dst AS lagger, lag FROM f ORDER BY round(f, 9), src, dst LIMIT 20""",
    "select_correlation": f"WITH {_CHOSEN} SELECT leader, lagger, lag FROM pairs",
    "orient_pairs": f"WITH {_SPLIT}, every AS (SELECT DISTINCT i AS x, j AS y FROM tl WHERE i < j) SELECT leader, lagger, lag FROM {_ORIENT.format(a='x', b='y', src='every')}",
    "select_undirected": f"""WITH {_SPLIT}, {same_time("train", "ct")}, e AS (SELECT i, j FROM ct WHERE abs(c) > 0.15), dg AS (SELECT v, count(*) AS d FROM (SELECT i AS v FROM e UNION ALL SELECT j FROM e) GROUP BY v)
SELECT i AS leader, j AS lagger FROM e JOIN dg p ON p.v = i JOIN dg q ON q.v = j ORDER BY 4 - p.d - q.d, i, j LIMIT 20""",
    "select_random": f"""WITH {_SPLIT}, drawn AS (SELECT x, y FROM (SELECT DISTINCT i AS x, j AS y FROM tl WHERE i < j) ORDER BY md5(x || '-' || y), x, y LIMIT 20) SELECT leader, lagger, lag FROM {_ORIENT.format(a="x", b="y", src="drawn")}""",
    "directional_ic": f"WITH {_CHOSEN}, {_SIGNS}, {forecast('test')}, {pair_ic()} SELECT leader, lagger, lag, round(ic, 6) + 0.0 AS ic, n FROM ic",
    "directional_ic_grouped": f"WITH {_CHOSEN}, {_SIGNS}, {forecast('test', '', ' AND p.t // 10 = q.t // 10')}, {pair_ic()} SELECT leader, lagger, lag, round(ic, 6) + 0.0 AS ic, n FROM ic",
    "pooled_ic": f"WITH {_CHOSEN}, {_SIGNS}, {forecast('test')} {spear('fc', 'fore', 'real')}",
    "mean_reversion_pnl": f"""WITH {_CHOSEN}, s AS (SELECT leader, lagger, lag, p.t, p.r - q.r AS d, sum(p.r - q.r) OVER (PARTITION BY leader, lagger, lag ORDER BY p.t) AS s FROM pairs JOIN test p ON p.asset_idx = leader JOIN test q ON q.asset_idx = lagger AND q.t = p.t),
z AS (SELECT *, CASE WHEN count(*) OVER k = 10 THEN round((s - avg(s) OVER k) / nullif(stddev_samp(s) OVER k, 0), 9) END AS z FROM s WINDOW k AS (PARTITION BY leader, lagger, lag ORDER BY t ROWS 9 PRECEDING)),
g AS (SELECT t, coalesce(lag(CASE WHEN abs(z) > 1.0 THEN -sign(z) ELSE 0 END) OVER (PARTITION BY leader, lagger, z.lag ORDER BY t), 0) * d AS g FROM z), bk AS (SELECT t, avg(g) AS g FROM g GROUP BY t)
SELECT round(CASE WHEN stddev_samp(g) > 0 THEN sqrt(252.0) * avg(g) / stddev_samp(g) END, 6) + 0.0 AS sharpe, round(avg(g), 6) + 0.0 AS mean_daily FROM bk""",
    "bootstrap_edges": f"WITH {_PANEL}, {blocks('panel', 25, 20)}, {lagged('boots', 'bl', 'boot')}, {graph('bl', 'be', 0.9, 'boot')} SELECT src, dst, count(*) / 25 AS share FROM be GROUP BY ALL",
    "bootstrap_rank_stability": f"""WITH {_PANEL}, {blocks("panel", 25, 20)}, {lagged("boots", "bl", "boot")}, {graph("bl", "be", 0.7, "boot")}, {weighted("be", "bf", "boot")},
both_ AS (SELECT p.boot AS x, q.boot AS y, round(p.f, 9) AS fx, round(q.f, 9) AS fy FROM bf p JOIN bf q ON p.src = q.src AND p.dst = q.dst AND p.boot < q.boot) {spear("both_", "fx", "fy", "x, y")}""",
    "bootstrap_ic": f"""WITH {_CHOSEN}, {_SIGNS}, sh AS (SELECT t - (SELECT min(t) FROM test) AS t, asset_idx, r FROM test), {blocks("sh", 100, 10)}, {forecast("boots", "boot", " AND p.boot = q.boot")}, {pair_ic("boot")},
k AS (SELECT boot, avg(ic) AS ic FROM ic GROUP BY boot) SELECT round(avg(ic), 6) + 0.0 AS mean_ic, round(quantile_cont(ic, 0.025), 6) + 0.0 AS low, round(quantile_cont(ic, 0.975), 6) + 0.0 AS high FROM k""",
    "roll_curv_vol": f"WITH {_VOL} SELECT * FROM rolled",
    "roll_partial_spearman": f"WITH {_VOL}{partial('rolled', 'curv_ll', 'vol_fwd', 'vol_now')}",
    "roll_drawdown": f"""WITH {_W}, l AS (SELECT wid, t, exp(sum(m) OVER (PARTITION BY wid ORDER BY t)) AS l FROM market JOIN w ON t >= b AND t < b + 21), k AS (SELECT wid, l / max(l) OVER (PARTITION BY wid ORDER BY t) - 1 AS dd FROM l) SELECT wid, round(min(dd), 6) + 0.0 AS drawdown FROM k GROUP BY wid""",
    "roll_gini": f"""WITH {_W}, {_WE(0.9)}, x AS (SELECT w.wid, v.asset_idx, (SELECT count(*) FROM we WHERE we.wid = w.wid AND we.src = v.asset_idx) AS x FROM w, (SELECT DISTINCT asset_idx FROM panel) v),
k AS (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY x, asset_idx) AS i, count(*) OVER (PARTITION BY wid) AS n FROM x) SELECT wid, round(sum((2 * i - n - 1) * x) / nullif(max(n) * sum(x), 0), 6) + 0.0 AS gini FROM k GROUP BY wid""",
    "roll_moments": f"WITH {_W} SELECT wid, round(avg(m), 6) + 0.0 AS mean, round(skewness(m), 6) + 0.0 AS skew, round(kurtosis(m), 6) + 0.0 AS kurt FROM market JOIN w ON t >= a AND t < b GROUP BY wid",
    "roll_lead_h": f"""WITH {_W}, {same_time("rows_", "wc", "wid")}, k AS (SELECT wid, round(avg(abs(c)), 9) AS c FROM wc GROUP BY wid), z AS (SELECT h, c, round(m, 9) AS m FROM k JOIN w USING (wid) JOIN (SELECT unnest([1, 5, 10]) AS h) ON true JOIN market ON t = b + h) {spear("z", "c", "m", "h")}""",
    "regime_coupling": f"""WITH {_PANEL}, q AS (SELECT *, t // 13 AS wid FROM panel), {same_time("q", "qc", "wid")}, v AS (SELECT wid, stddev_samp(m) AS vol FROM (SELECT wid, t, avg(r) AS m FROM q GROUP BY ALL) GROUP BY wid HAVING count(*) >= 10),
k AS (SELECT wid, avg(abs(c)) AS coupling, any_value(vol) AS vol FROM qc JOIN v USING (wid) GROUP BY wid) SELECT CAST(wid AS BIGINT) AS wid, round(coupling, 6) + 0.0 AS coupling, round(vol, 6) + 0.0 AS vol, vol > (SELECT quantile_cont(vol, 0.75) FROM k) AS crisis FROM k""",
    "yoy_diff_vol": f"""WITH {_PANEL}, s AS (SELECT asset, date_trunc('quarter', wk) AS q, sum(v) AS v FROM sales GROUP BY ALL), d AS (SELECT asset, v - lag(v, 4) OVER (PARTITION BY asset ORDER BY q) AS x FROM s) SELECT asset, round(stddev_samp(x), 6) + 0.0 AS sd, count(x) AS n FROM d GROUP BY asset HAVING count(x) >= 8""",
    "shock_spillover": f"""WITH {_SPLIT}, {graph("tl", "e", 0.9)}, sd AS (SELECT asset_idx, 2 * stddev_samp(r) AS cut FROM train GROUP BY 1),
z AS (SELECT round(sign(signed) * p.r, 9) AS fore, round(q.r, 9) AS real, abs(p.r) > cut AS shock FROM e JOIN test p ON p.asset_idx = src JOIN test q ON q.asset_idx = dst AND q.t = p.t + e.lag JOIN sd ON sd.asset_idx = src),
y AS (SELECT 'all' AS kind, fore, real FROM z UNION ALL SELECT 'shock', fore, real FROM z WHERE shock) {spear("y", "fore", "real", "kind")}""",
    "centrality_ls": f"WITH {_CENTRAL} {long_short(1)}",
    "link_momentum_ls": f"WITH {_MOMENTUM} {long_short(10)}",
    "long_short_summary": f"""WITH k AS (SELECT 'centrality' AS study, spread FROM (WITH {_CENTRAL} {long_short(1)}) UNION ALL SELECT 'link momentum', spread FROM (WITH {_MOMENTUM} {long_short(10)}))
SELECT study, count(*) AS n, {out("mean", "t", "sharpe", "wins", "low", "high")} FROM (SELECT study, spread, avg(spread) OVER w AS mean, avg(spread) OVER w / (stddev_pop(spread) OVER w / sqrt(count(spread) OVER w)) AS t, avg(spread) OVER w / stddev_pop(spread) OVER w * sqrt(12) AS sharpe,
  avg(CAST(spread > 0 AS INT)) OVER w AS wins, avg(spread) OVER w - 1.96 * stddev_samp(spread) OVER w / sqrt(count(spread) OVER w) AS low, avg(spread) OVER w + 1.96 * stddev_samp(spread) OVER w / sqrt(count(spread) OVER w) AS high FROM k WINDOW w AS (PARTITION BY study))
GROUP BY ALL""",
    "link_enrichment": f"""WITH {_E7}, ix AS (SELECT DISTINCT n_nationkey, asset_idx FROM nation JOIN panel ON n_name = asset),
tr AS (SELECT least(x.asset_idx, y.asset_idx) AS a, greatest(x.asset_idx, y.asset_idx) AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN ix x ON x.n_nationkey = s_nationkey JOIN ix y ON y.n_nationkey = c_nationkey WHERE x.asset_idx <> y.asset_idx GROUP BY ALL),
top AS (SELECT a, b FROM tr ORDER BY n DESC, a, b LIMIT 60), h AS (SELECT count(top.a) AS hits, count(*) AS drawn FROM edges LEFT JOIN top ON a = least(src, dst) AND b = greatest(src, dst)),
k AS (SELECT hits, drawn, (SELECT count(*) FROM top) AS links, CAST((SELECT count(DISTINCT asset_idx) * (count(DISTINCT asset_idx) - 1) / 2 FROM panel) AS BIGINT) AS "of" FROM h)
SELECT hits, drawn, links, "of", round((SELECT sum(exp(lgamma(links + 1) - lgamma(x + 1) - lgamma(links - x + 1) + lgamma("of" - links + 1) - lgamma(drawn - x + 1) - lgamma("of" - links - drawn + x + 1) - lgamma("of" + 1) + lgamma(drawn + 1) + lgamma("of" - drawn + 1)))
  FROM range(400) r(x) WHERE x >= hits AND x <= least(drawn, links) AND "of" - links - drawn + x >= 0), 6) + 0.0 AS p FROM k""",
    "candidate_grid": _grid(),
    "critic_decisions": f"SELECT residual, q, object, rho < 0.8 AS first_accepts, abs(rho) < 0.8 AS second_accepts FROM ({_grid()})",
}
