"""Whole-graph operators, cointegration, portfolios, sources and studies against brute force or a planted truth."""

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from oracle import differences
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lagwise.functions import ranks
from lagwise.operators import cointegration, gram, graph_tasks, graphs, portfolios, residuals, signals, windows
from lagwise.plans import network, pipeline
from lagwise.sources import database, files, panels, synthetic

SQL = entry.oracle_sql()


@pytest.mark.parametrize("query", [q for q in network.QUERIES if q.__name__ in SQL], ids=lambda q: q.__name__)
def test_equals_sql(spark, query):
    sf_dir = "/root/testdata/sf0.01"
    names, more, less, n = differences(query(spark, sf_dir), SQL[query.__name__], sf_dir)
    assert not names and not more and not less and n


def edges_of(spark, rows):
    return spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in rows], "src int, dst int, weight double")


# transport ------------------------------------------------------------------------------------------------------------


def test_transport_against_assignments():
    """With equal masses the best plan is a best assignment."""
    rng = np.random.default_rng(1)
    for n in range(1, 7):
        for _ in range(20):
            cost = rng.integers(0, 4, (n, n)).astype(float)
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))) / n
            assert abs(graph_tasks.transport(np.full(n, 1 / n), np.full(n, 1 / n), cost) - best) < 1e-9


def test_transport_against_its_dual():
    """Unequal masses split into equal parts."""
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.multinomial(6, np.ones(3) / 3), rng.multinomial(6, np.ones(4) / 4)
        cost = rng.random((3, 4))
        x, y = np.repeat(np.arange(3), a), np.repeat(np.arange(4), b)
        best = min(sum(cost[x[i], y[p[i]]] for i in range(6)) for p in itertools.permutations(range(6))) / 6
        some_a, some_b = a > 0, b > 0
        assert abs(graph_tasks.transport(a[some_a] / 6, b[some_b] / 6, cost[np.ix_(some_a, some_b)]) - best) < 1e-9


def test_ollivier_of_known_graphs(spark):
    def curvature(rows, alpha=0.0):
        return {(r.src, r.dst): r.ollivier for r in graph_tasks.ollivier(edges_of(spark, rows), alpha, parts=3).collect()}

    full = curvature([(i, j, 1.0) for i, j in itertools.combinations(range(5), 2)])
    assert len(full) == 10 and all(abs(x - 3 / 4) < 1e-9 for x in full.values())  # (n - 2) / (n - 1)
    ring = curvature([(i, (i + 1) % 6, 1.0) for i in range(6)])
    assert all(abs(x) < 1e-9 for x in ring.values())
    square = curvature([(i, (i + 1) % 4, 1.0) for i in range(4)], 0.5)
    assert all(abs(x - 0.5) < 1e-9 for x in square.values())
    star = curvature([(0, i, 1.0) for i in range(1, 5)])
    assert all(abs(x) < 1e-9 for x in star.values())
    bridge = curvature([(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (3, 4, 1.0), (3, 5, 1.0), (4, 5, 1.0), (0, 3, 1.0)])
    assert min(bridge, key=bridge.get) == (0, 3) and bridge[0, 3] < 0


def test_measures(spark):
    e = edges_of(spark, [(0, 1, 1.0), (0, 2, 3.0)])
    got = {(r.x, r.v): r.mass for r in graphs.measures(e, 0.2).collect()}
    assert got == pytest.approx({(0, 0): 0.2, (0, 1): 0.2, (0, 2): 0.6, (1, 1): 0.2, (1, 0): 0.8, (2, 2): 0.2, (2, 0): 0.8})


# communities ----------------------------------------------------------------------------------------------------------


def _random_graph(seed, n=14, p=0.3):
    rng = np.random.default_rng(seed)
    pairs = [(i, j) for i, j in itertools.combinations(range(n), 2) if rng.random() < p]
    u, v = (np.array(x) for x in zip(*pairs))
    return n, u, v, rng.random(len(u)) + 0.2


def _curvature(n, edges):
    """Augmented curvature from the definition."""
    out = {}
    for (a, b), w in edges.items():
        near = lambda x: {p if q == x else q for p, q in edges if x in (p, q)}
        value = w * (2 / w - sum(1 / math.sqrt(w * x) for e, x in edges.items() if e != (a, b) and a in e) - sum(1 / math.sqrt(w * x) for e, x in edges.items() if e != (a, b) and b in e))
        out[a, b] = value + 3 * len(near(a) & near(b))
    return out


def _parts(n, edges):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def _modularity(root, edges):
    m = sum(edges.values())
    q = 0.0
    for c in set(root):
        inside = sum(w for (a, b), w in edges.items() if root[a] == root[b] == c)
        degree = sum(w * ((root[a] == c) + (root[b] == c)) for (a, b), w in edges.items())
        q += inside / m - (degree / (2 * m)) ** 2
    return q


@pytest.mark.parametrize("seed", range(6))
def test_removal_recomputed_from_the_definition(seed):
    n, u, v, w = _random_graph(seed)
    whole = dict(zip(zip(u.tolist(), v.tolist()), w.tolist()))
    left, best, most, idle = dict(whole), _parts(n, whole), _modularity(_parts(n, whole), whole), 0
    while left:
        curved = _curvature(n, left)
        edge = min(sorted(curved), key=lambda e: (round(curved[e], 9), e))
        del left[edge]
        q = _modularity(_parts(n, left), whole)
        if q > most + 1e-12:
            most, best, idle = q, _parts(n, left), 0
        else:
            idle += 1
            if idle >= 5 and curved[edge] >= 0:
                break
    got = graph_tasks.communities_by_removal(n, u, v, w, patience=5).tolist()
    assert abs(_modularity(got, whole) - most) < 1e-9 and got == best
    once = graph_tasks.communities_by_removal(n, u, v, w, threshold=-1.0, iterative=False).tolist()
    curved = _curvature(n, whole)
    assert once == _parts(n, {e: x for e, x in whole.items() if curved[e] >= -1.0})


def test_merging_finds_cliques():
    pairs = [*itertools.combinations(range(5), 2), *itertools.combinations(range(5, 11), 2), (0, 5)]
    u, v = (np.array(x) for x in zip(*pairs))
    assert graph_tasks.communities_by_merging(12, u, v).tolist() == [0] * 5 + [5] * 6 + [11]


def test_rewiring_keeps_degrees(spark):
    n, u, v, w = _random_graph(3, 20, 0.25)
    near = graph_tasks.rewired(n, u, v, 200, 4000, np.random.default_rng(5))
    degree = np.bincount(np.concatenate([u, v]), minlength=n)
    assert [len(x) for x in near] == degree.tolist() and all(a in near[b] and a != b for a in range(n) for b in near[a])
    assert {(a, b) for a in range(n) for b in near[a] if a < b} != set(zip(u.tolist(), v.tolist()))
    null = graph_tasks.configuration_null(edges_of(spark, zip(u, v, w)), 8).collect()
    near = [set(v[u == x]) | set(u[v == x]) for x in range(n)]
    assert len(null) == len(u) and all(r.m == len(near[r.src] & near[r.dst]) for r in null) and all(r.z == 0 or abs(r.z - (r.m - r["mean"]) / r.sd) < 1e-9 for r in null)
    again = graph_tasks.configuration_null(edges_of(spark, zip(u, v, w)), 8).collect()
    assert sorted(map(tuple, null)) == sorted(map(tuple, again))


def test_adjusted_rand(spark):
    def ari(a, b):
        found = spark.createDataFrame(list(enumerate(a)), "v int, root int")
        truth = spark.createDataFrame(list(enumerate(b)), "v int, label int")
        return graph_tasks.adjusted_rand(found, truth).first().ari

    assert ari([0, 0, 1, 1], [5, 5, 2, 2]) == 1.0
    assert ari([0, 0, 1, 2], [0, 0, 1, 1]) == pytest.approx(0.571428571)
    assert ari([0, 0, 0, 0], [0, 1, 2, 3]) == pytest.approx(0.0)


def test_planted_blocks_are_found(spark):
    rows = [pipeline.kill_switch_a(spark, seed=k).first() for k in range(4)]
    assert all(r.gap > 0 and r.ari > 0.25 and r.n_true == 3 and r.passed == (r.ari >= 0.6) for r in rows)
    assert pipeline.kill_switch_a(spark, p_in=0.7, p_out=0.005).first().passed
    with pytest.raises(ValueError):
        synthetic.block_graph(spark, [3, 0])
    with pytest.raises(ValueError):
        synthetic.block_graph(spark, [3], 0.1, 0.2)


def test_weights_must_be_positive(spark):
    for f in (graphs.forman, graphs.forman_undirected):
        with pytest.raises(Exception, match="positive"):
            f(edges_of(spark, [(0, 1, 0.0), (1, 2, 1.0)])).collect()
    with pytest.raises(ValueError):
        graph_tasks.communities_by_removal(2, np.array([0]), np.array([1]), np.array([0.0]))


# series ---------------------------------------------------------------------------------------------------------------


def _panel(spark, values):
    rows = [(t, i, f"a{i:02d}", "xyz"[i % 3], None if math.isnan(x) else float(x)) for t, r in enumerate(values) for i, x in enumerate(r)]
    return spark.createDataFrame(rows, "t int, asset_idx int, asset string, sector string, r double")


def test_block_products_equal_numpy(spark, monkeypatch):
    """Many blocks and chunks, a constant column and a gap."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 7)) + 5
    x[:, 3] = 2.5
    gap = x.copy()
    gap[10, 5] = np.nan
    monkeypatch.setattr(gram, "BLOCK", 3)
    monkeypatch.setattr(gram, "CHUNK", 8)
    got = {(r.lag, r.i, r.j): r.c for r in graphs.lagged_correlation(_panel(spark, gap), (1, 9)).collect()}
    for lag in (1, 9):
        for i, j in itertools.permutations(range(7), 2):
            want = 0.0 if 3 in (i, j) or 5 in (i, j) and np.isnan(gap[:-lag, i]).any() | np.isnan(gap[lag:, j]).any() else np.corrcoef(x[:-lag, i], x[lag:, j])[0, 1]
            assert got[lag, i, j] == pytest.approx(want, abs=1e-9)
    same = {(r.i, r.j): r.c for r in signals.correlation(_panel(spark, gap)).collect()}
    want = pd.DataFrame(gap).corr()
    for i, j in itertools.combinations(range(7), 2):
        assert (same[i, j] is None) if 3 in (i, j) else same[i, j] == pytest.approx(want.loc[i, j], abs=1e-9)


def test_walk_forward_has_the_last_window(spark):
    p = _panel(spark, np.zeros((156, 1)))
    assert [tuple(r) for r in windows.walk_forward(p, 104, 52).collect()] == [(0, 0, 104, 156)]
    assert windows.walk_forward(p, 104, 53).count() == 0
    assert [r.start for r in windows.walk_forward(p, 52, 26, 26).orderBy("wid").collect()] == [0, 26, 52, 78]


def test_constant_regressors(spark):
    """A market without variance leaves what the sector explains, as least squares has it."""
    rng = np.random.default_rng(3)
    half = rng.normal(size=(40, 3))
    x = np.empty((40, 6))
    x[:, :3], x[:, 3:] = half, -half  # the market is 0 throughout
    p = _panel(spark, x)
    got = residuals.residualize(p, "market_sector").toPandas().pivot(index="t", columns="asset_idx", values="r").to_numpy()
    sector = np.arange(6) % 3
    for i in range(6):
        peers = x[:, (sector == sector[i]) & (np.arange(6) != i)].mean(axis=1)
        design = np.column_stack([np.ones(40), peers])
        want = x[:, i] - design @ np.linalg.lstsq(design, x[:, i], rcond=None)[0]
        assert np.abs(got[:, i] - want).max() < 1e-8


def _spearman(a, b):
    return np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1]


def test_partial_rank_correlation(spark):
    rng = np.random.default_rng(8)
    z, y2 = rng.normal(size=90), rng.normal(size=90)
    x, y = z**3 + rng.normal(size=90), np.exp(z) + y2 + rng.normal(size=90)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, z, y2)], "x double, y double, z double, w double")
    for controls in ([z], [z, y2]):
        d = np.column_stack([np.ones(90), *controls])
        left = [c - d @ np.linalg.lstsq(d, c, rcond=None)[0] for c in (x, y)]
        got = ranks.partial_spearman(df, "x", "y", *("z", "w")[: len(controls)]).first()
        assert got.rho == pytest.approx(_spearman(*left), abs=1e-9) and got.n == 90


def test_ranks_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGES", 5)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 30, 200) / 7.0
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k int, x double").repartition(4)
    got = {r.k: r.a for r in ranks.average_ranks(df, {"a": "x"}).collect()}
    assert [got[k] for k in range(200)] == pd.Series(x).rank().tolist()
    p = np.clip(x / 6, 0, 1)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(p)], "k int, p double").repartition(4)
    out = {r.k: r.p_adj for r in ranks.benjamini_hochberg(df, "p").collect()}
    order = np.argsort(p, kind="stable")
    raw = np.minimum.accumulate((p[order] * 200 / np.arange(1, 201))[::-1])[::-1]
    assert np.allclose([out[k] for k in order.tolist()], np.minimum(raw, 1))


def test_log_factorial(spark):
    n = list(range(40)) + [1000, 500_000]
    got = spark.createDataFrame([(x,) for x in n], "n long").select(ranks.log_factorial(F.col("n")).alias("x")).collect()
    assert np.allclose([r.x for r in got], [math.lgamma(x + 1) for x in n], rtol=1e-13, atol=1e-12)


def test_cointegration():
    rng = np.random.default_rng(7)
    walk = rng.normal(size=400).cumsum()
    tied = 2 * walk + rng.normal(size=400)
    apart = rng.normal(size=400).cumsum()
    tau, p = cointegration.engle_granger(tied, walk)
    assert tau < -8 and p < 1e-6
    assert cointegration.engle_granger(apart, walk)[1] > 0.05
    assert cointegration.engle_granger(3 * walk + 1, walk) == (-math.inf, 0.0)
    assert cointegration.p_value(5.0) == 1.0 and cointegration.p_value(-30.0) == 0.0
    # points of the published table for two variables with a constant: 1 %, 5 % and 10 %
    for tau, p in ((-3.90, 0.01), (-3.34, 0.05), (-3.04, 0.10)):
        assert abs(cointegration.p_value(tau) - p) < 0.004
    assert cointegration.engle_granger(np.zeros(2), np.zeros(2))[1] in (0.0, 1.0)


def test_cointegrated_pairs_come_first(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 5))
    spread = rng.normal(size=301)
    x[:, 4] = x[:, 1] + np.diff(spread) * 0.5
    p = _panel(spark, x)
    best = cointegration.most_cointegrated(p, cointegration.candidates(p), 1).first()
    assert (best.a, best.b) == (1, 4)
    assert cointegration.candidates(p, 3, 1).collect() == cointegration.candidates(p.repartition(5), 3, 1).collect()


def test_portfolios(spark):
    c = spark.createDataFrame([(0, i, j, 0.9 if (i < 3) == (j < 3) else 0.1) for i, j in itertools.combinations(range(6), 2)], "wid int, i int, j int, c double")
    two = [r.asset_idx for r in portfolios.least_correlated(c, 2).orderBy("place").collect()]
    assert (two[0] < 3) != (two[1] < 3)
    labels = spark.createDataFrame([(0, v, 0 if v < 4 else 4) for v in range(6)], "wid int, v int, root int")
    e = spark.createDataFrame([(0, 1, 0), (0, 1, 2), (0, 1, 3), (0, 4, 5)], "wid int, src int, dst int")
    assert [r.asset_idx for r in portfolios.representatives(labels, e, 3).orderBy("place").collect()] == [1, 4, 0]
    r = np.array([0.1, -0.2, 0.05])
    rows = spark.createDataFrame([(0, t, a, float(x)) for t, x in enumerate(r) for a in (0, 1)], "wid int, t int, asset_idx int, r double")
    got = portfolios.risk(rows, spark.createDataFrame([("m", 0, 0), ("m", 0, 1)], "method string, wid int, asset_idx int"), 52).first()
    level = np.cumprod(1 + r)
    assert got.vol == pytest.approx(r.std(ddof=1) * math.sqrt(52)) and got.drawdown == pytest.approx((level / np.maximum.accumulate(level) - 1).min())


# sources --------------------------------------------------------------------------------------------------------------


def test_contained_both_ways(spark):
    names = spark.createDataFrame([("ACME STEEL WORKS",), ("STEEL",), ("NONE HERE",), ("ABC",)], "n string")
    others = spark.createDataFrame([("WORKS", 3), ("STEEL", 2), ("GREAT STEEL MILL", 1), ("ABC", 0)], "o string, k int")
    assert {tuple(r) for r in panels.contained(names, others, "n", "o", "k").collect()} == {("ACME STEEL WORKS", "STEEL"), ("STEEL", "GREAT STEEL MILL")}


def test_bundles(spark, tmp_path):
    wide = tmp_path / "wide.csv"
    wide.write_text("day,A,B,C\n2020-01-01,0.1,x,\n2020-01-02,,0.2,\n")
    sectors = tmp_path / "sectors.csv"
    sectors.write_text("Ticker,GSector\nA,45\nC,10\n")
    made = files.load(spark, "csv", str(wide), str(sectors))
    assert Counter(map(tuple, made.returns.collect())) == Counter([("2020-01-01", "A", 0.1), ("2020-01-02", "B", 0.2)])
    assert {tuple(r) for r in made.sectors.collect()} == {("A", "45"), ("B", "OTHER")}
    matrix = tmp_path / "matrix.csv"
    matrix.write_text("ticker,X20200101,X20200102\nA,0.1,\nB,bad,0.3\n")
    got = {(str(r.t), r.asset): r.r for r in files.load(spark, "matrix", str(matrix)).returns.collect()}
    assert got == {("2020-01-01", "A"): 0.1, ("2020-01-02", "A"): 0.0, ("2020-01-01", "B"): 0.0, ("2020-01-02", "B"): 0.3}
    assert files.load(spark, "synthetic", n_assets=4, n_periods=5, n_pairs=1).returns.count() == 20
    with pytest.raises(ValueError):
        files.load(spark, "other")
    with pytest.raises(KeyError):
        files.column(made.returns, "nothing")


def test_bars_are_pulled_day_by_day(spark, tmp_path):
    """A broken pull is taken up again: whole days are not asked for twice, broken ones are."""
    asked = []

    def run(sql):
        day = sql.split("day = '")[1][:10]
        asked.append(day)
        if day == "2020-01-02" and len(asked) < 4:
            raise RuntimeError("no table")
        return spark.createDataFrame([("A", 34200, 10.0 + len(asked), 5.0), ("A", 36000, 11.0 + len(asked), 5.0)], "asset string, bucket long, price double, volume double")

    folder, days = str(tmp_path / "bars"), ["2020-01-01", "2020-01-02", "2020-01-03"]
    assert database.pull_bars(spark, run, folder, "trades", ["A", "O'B"], days).keys() == {"2020-01-02"}
    assert database.done_days(spark, folder) == {"2020-01-01", "2020-01-03"}
    assert database.pull_bars(spark, run, folder, "trades", ["A"], days) == {} and asked == [*days, "2020-01-02"]
    assert database.pulled_bars(spark, folder).count() == 6 and database.pulled_returns(spark, folder).count() == 3
    assert "O''B" in database.bars_sql("trades", "2020-01-01", ["O'B"]) and "BETWEEN '2020-01-01'" in database.universe_sql("2020-01-01", "2020-12-31")
    assert database.pulled_bars(spark, str(tmp_path / "none")).count() == 0


def test_database_statements(spark, tmp_path):
    """The statements against an embedded database."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE daily AS SELECT * FROM (VALUES (DATE '2020-01-01', 1, 0.1), (DATE '2020-01-02', 1, 0.2), (DATE '2020-01-03', 1, NULL), (DATE '2020-01-01', 2, 0.5)) x(date, permno, ret)")
    con.execute("CREATE TABLE members AS SELECT * FROM (VALUES (1, DATE '2020-01-02', DATE '2020-12-31')) x(permno, start, ending)")
    con.execute("CREATE TABLE delisted AS SELECT * FROM (VALUES (1, DATE '2020-01-02', -0.5), (1, DATE '2020-01-03', -0.9)) x(permno, dlstdt, dlret)")
    got = con.execute(database.universe_sql("2020-01-01", "2020-06-30")).fetchall()
    assert sorted((str(t), a, round(float(r), 9)) for t, a, r in got) == [("2020-01-02", 1, -0.4), ("2020-01-03", 1, -0.9)]
    con.execute("CREATE TABLE trades AS SELECT * FROM (VALUES ('2020-01-01', 'A', 34205, 10.0, 1, 5), ('2020-01-01', 'A', 35000, 11.0, 2, 5), ('2020-01-01', 'A', 35000, 12.0, 3, 5), ('2020-01-01', 'A', 1, 99.0, 4, 5), ('2020-01-01', 'B', 35000, 7.0, 5, 5)) x(day, sym_root, sec, price, tr_seqnum, size)")
    assert [(a, int(b), float(p), int(v)) for a, b, p, v in con.execute(database.bars_sql("trades", "2020-01-01", ["A"])).fetchall()] == [("A", 34200, 12.0, 15)]


def test_synthetic_panel(spark):
    made = synthetic.lead_lag_panel(spark, n_assets=20, n_periods=400, n_pairs=5, strength=0.9, seed=4)
    again = synthetic.lead_lag_panel(spark, n_assets=20, n_periods=400, n_pairs=5, strength=0.9, seed=4)
    assert made.returns.exceptAll(again.returns.repartition(7)).count() == 0
    pairs = [tuple(r) for r in made.pairs.collect()]
    assert len(pairs) == 5 and len({x for p in pairs for x in p[:2]}) == 10
    sector = {r.asset_idx: r.sector for r in made.returns.select("asset_idx", "sector").distinct().collect()}
    assert sum(sector[a] == sector[b] for a, b, _ in pairs) >= 4
    x = made.returns.toPandas().pivot(index="t", columns="asset_idx", values="r").to_numpy()
    assert abs(x.std() - math.sqrt(0.01**2 + 0.008**2 + 0.012**2)) < 0.004
    for bad in (dict(n_assets=3, n_pairs=2), dict(lag=0)):
        with pytest.raises(ValueError):
            synthetic.lead_lag_panel(spark, **bad)


def test_planted_pairs_are_detected(spark):
    rows = network.synthetic_pairs_found(spark, "-").collect()
    assert len(rows) == 6 and sum(r.at == 1 for r in rows) >= 5


# studies --------------------------------------------------------------------------------------------------------------


def test_study_and_verdicts(spark, tmp_path):
    panel = pipeline.materialize(network._planted(spark).returns, "panel")
    study = pipeline.run_study(panel, network.SMALL)
    ic = {r.method: r for r in study.ic.collect()}
    assert set(ic) == {"curvature", "undirected", "correlation", "cointegration", "random", "ollivier"}
    assert all(r.n_pairs == 8 and r.low <= r.high for r in ic.values())
    row = study.cascade.first()
    assert row.plain_is_degree and -1 <= row.spearman <= 1 and 0 <= row.jaccard <= 1 and row.edges > 20 and 0 <= row.null_share <= 1
    assert study.pair_communities.count() == row.edges and study.communities.count() == 24
    verdict = pipeline.accept(study).first()
    assert verdict.accepted == (verdict.reasons == "")
    o = pipeline.Orchestrator()
    decisions = pipeline.materialize(o.run(panel), "decisions")
    rows = decisions.collect()
    assert len(rows) == 12 and all(not r.accepted and ("degree" in r.reasons or r.edges < 20) for r in rows if r.curvature == "f_plain")
    text = o.report(decisions, str(tmp_path / "report"))
    assert text.count("\n") == 16 and "Proposed 12 candidates" in text
    with pytest.raises(ValueError):
        pipeline.residual(panel, "other")


def test_judge(spark):
    rows = [(0.9, 0.1, 0.5, 0.3, 50), (0.1, 0.9, 0.99, 0.0, 50), (0.1, 0.1, 0.1, 0.3, 5), (-0.9, 0.1, 0.1, 0.3, 50), (0.1, 0.1, 0.1, 0.3, 50)]
    figures = spark.createDataFrame(rows, "spearman double, jaccard double, r2_on_degree double, null_share double, edges int")
    got = [r.reasons for r in pipeline.judge(figures, pipeline.Rules(min_null_share=0.05)).collect()]
    assert got[0].startswith("spearman") and got[1].count(";") == 2 and got[2] == "too few edges" and got[3].startswith("spearman") and got[4] == ""
    assert [name for name, _ in pipeline.propose()] == [f"cand{k:03d}" for k in range(12)]
