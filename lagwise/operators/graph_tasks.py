"""What looks at a whole graph again and again: transport curvature, communities by removal or merging, rewired nulls.

A graph (a window's, a resample's, a seed's) is one task, in arrays; a study of many graphs runs them side by side.  One graph
has as many vertices as there are assets, so a task's memory is bounded by their square in bytes.  Transport over
one large graph is dealt to ``parts`` tasks that share its edges.

Graphs are taken without direction: of two edges there and back the one from the larger vertex gives the weight.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def undirected(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges u < v, each once, in order."""
    kept: dict[tuple, float] = {}
    for s, d, w in sorted(zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True)):
        if s != d:
            kept[min(s, d), max(s, d)] = w
    order = sorted(kept)
    return np.array([u for u, _ in order], np.int64), np.array([v for _, v in order], np.int64), np.array([kept[e] for e in order], float)


def numbered(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, src, dst) with vertices as places of their names."""
    names, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    return names, at[: len(src)], at[len(src) :]


# transport ------------------------------------------------------------------------------------------------------------


def transport(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> float:
    """The least cost of moving masses ``a`` to masses ``b`` of the same sum: shortest augmenting paths in the residual network."""
    eps = 1e-13
    left, room, flow = a.astype(float).copy(), b.astype(float).copy(), np.zeros_like(cost, dtype=float)
    while left.sum() > eps * len(a) and room.sum() > eps * len(b):
        near, far = np.where(left > eps, 0.0, np.inf), np.full(len(b), np.inf)
        from_a, from_b = np.full(len(b), -1), np.full(len(a), -1)
        while True:  # Bellman and Ford, all arcs at once
            ahead = near[:, None] + cost
            best = ahead.argmin(axis=0)
            value = ahead[best, np.arange(len(b))]
            better = value < far - 1e-12
            far[better], from_a[better] = value[better], best[better]
            back = np.where(flow > eps, far[None, :] - cost, np.inf)
            best = back.argmin(axis=1)
            value = back[np.arange(len(a)), best]
            worse = value < near - 1e-12
            near[worse], from_b[worse] = value[worse], best[worse]
            if not better.any() and not worse.any():
                break
        if not np.isfinite(far[room > eps]).any():
            break
        j = int(np.where(room > eps, far, np.inf).argmin())
        path, end, amount = [], j, room[j]
        while True:
            i = int(from_a[end])
            path.append((i, end, 1.0))
            if from_b[i] < 0:
                amount = min(amount, left[i])
                break
            end = int(from_b[i])
            path.append((i, end, -1.0))
            amount = min(amount, flow[i, end])
        for x, y, sign in path:
            flow[x, y] += sign * amount
        left[path[-1][0]] -= amount
        room[j] -= amount
    return float((flow * cost).sum())


def measure(weights: np.ndarray, x: int, alpha: float) -> np.ndarray:
    """Mass ``alpha`` at a vertex and the rest at its neighbours by weight; all at the vertex if it has none."""
    row = weights[x]
    total = row.sum()
    out = (1 - alpha) * row / total if total > 0 else np.zeros(len(row))
    out[x] += alpha if total > 0 else 1.0
    return out


def ollivier_edges(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, wanted: np.ndarray, alpha: float) -> np.ndarray:
    """1 - W1 of the measures at both ends, for the wanted edges; distances are hops."""
    names, s, d = numbered(src, dst)
    u, v, w = undirected(s, d, weight)
    weights = np.zeros((len(names), len(names)))
    weights[u, v] = weights[v, u] = w
    near = weights > 0
    np.fill_diagonal(near, True)
    two = (near.astype(np.float32) @ near.astype(np.float32)) > 0
    out = np.zeros(len(wanted))
    held: dict[int, np.ndarray] = {}
    for k, e in enumerate(wanted.tolist()):
        x, y = int(s[e]), int(d[e])
        for z in (x, y):
            if z not in held:
                held[z] = measure(weights, z, alpha)
        a, b = held[x], held[y]
        common = np.minimum(a, b)  # mass that both have may stay where it is
        a, b = a - common, b - common
        i, j = np.flatnonzero(a > 1e-15), np.flatnonzero(b > 1e-15)
        if len(i) and len(j):
            hops = np.where(near[np.ix_(i, j)], 1.0, np.where(two[np.ix_(i, j)], 2.0, 3.0))  # ends are adjacent
            out[k] = transport(a[i], b[j], hops)
    return 1.0 - out


def ollivier(edges: DataFrame, alpha: float = 0.0, parts: int = 8, name: str = "ollivier", by: tuple[str, ...] = ()) -> DataFrame:
    """``edges`` with the transport curvature of each; every part has the whole graph and a share of its edges."""
    dealt = edges.select(*by, "src", "dst", "weight").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in (*by, "src", "dst")) + f", {name} double"

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["src", "dst"], ignore_index=True)
        wanted = np.arange(int(t["part"].iloc[0]), len(t), parts)
        value = ollivier_edges(t["src"].to_numpy(), t["dst"].to_numpy(), t["weight"].to_numpy(float), wanted, alpha)
        return t.iloc[wanted][[*by, "src", "dst"]].assign(**{name: value})

    found = dealt.groupBy(*by, "part").applyInPandas(run, schema)
    return edges.join(found, [*by, "src", "dst"])


# communities ----------------------------------------------------------------------------------------------------------


def roots_of(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest vertex that each reaches."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, v, root[u])
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def modularity_of(label: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> float:
    m, k = w.sum(), int(label.max()) + 1
    inside = np.bincount(label[u], w * (label[u] == label[v]), k)
    degree = np.bincount(label[u], w, k) + np.bincount(label[v], w, k)
    return float((inside / m - (degree / (2 * m)) ** 2).sum()) if m > 0 else 0.0


def augmented(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(curvature, sums of w^-1/2 at vertices, triangles at edges) without direction."""
    half = 1 / np.sqrt(w)
    sums = np.bincount(u, half, n) + np.bincount(v, half, n)
    near = [set() for _ in range(n)]
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        near[x].add(y)
        near[y].add(x)
    m = np.array([len(near[x] & near[y]) for x, y in zip(u.tolist(), v.tolist(), strict=True)], float)
    return 4 - np.sqrt(w) * (sums[u] + sums[v]) + 3 * m, sums, m


def communities_by_removal(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, threshold: float = 0.0, iterative: bool = True, max_removals: int | None = None, patience: int = 25) -> np.ndarray:
    """The partition, by smallest vertex, of the largest modularity on the way of removing the most negatively curved edge, again and again.

    It ends when ``patience`` removals in a row have not helped and the last was not below the threshold.  Not iterative: all
    edges below the threshold go at once.  Curvature is kept up to date at the edges that a removal touches.
    """
    if (w <= 0).any():
        raise ValueError("weights must be positive")
    f, sums, m = augmented(u, v, w, n)
    if not iterative:
        return roots_of(n, u[f >= threshold], v[f >= threshold])
    alive = np.ones(len(u), bool)
    at: list[dict[int, int]] = [{} for _ in range(n)]
    for e, (x, y) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        at[x][y] = at[y][x] = e
    best = roots_of(n, u, v)
    most = modularity_of(best, u, v, w)
    idle = 0
    root_w = np.sqrt(w)

    def joined(x: int, y: int) -> bool:
        seen, open_ = {x}, [x]
        while open_:
            for z in at[open_.pop()]:
                if z == y:
                    return True
                if z not in seen:
                    seen.add(z)
                    open_.append(z)
        return False

    for _ in range(len(u) if max_removals is None else max_removals):
        if not alive.any():
            break
        e = int(np.where(alive, f, np.inf).argmin())
        value, x, y = f[e], int(u[e]), int(v[e])
        alive[e] = False
        del at[x][y], at[y][x]
        sums[x] -= 1 / root_w[e]
        sums[y] -= 1 / root_w[e]
        for z in at[x].keys() & at[y].keys():
            m[at[x][z]] -= 1
            m[at[y][z]] -= 1
        touched = np.array([*at[x].values(), *at[y].values()], np.int64)
        f[touched] = 4 - root_w[touched] * (sums[u[touched]] + sums[v[touched]]) + 3 * m[touched]
        better = False
        if not joined(x, y):
            now = roots_of(n, u[alive], v[alive])
            q = modularity_of(now, u, v, w)
            if q > most + 1e-12:
                most, best, better = q, now, True
        idle = 0 if better else idle + 1
        if not better and idle >= patience and value >= threshold:
            break
    return best


def communities_by_merging(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Greedy modularity: from single vertices, the merger that gains most, as long as one gains; by smallest vertex."""
    total = len(u)
    label = np.arange(n)
    if not total:
        return label
    part = np.zeros((n, n))
    part[u, v] = part[v, u] = 1 / (2 * total)
    share = part.sum(axis=1)
    alive = np.ones(n, bool)
    while True:
        gain = np.where((part > 0) & alive[:, None] & alive[None, :], 2 * (part - np.outer(share, share)), -np.inf)
        np.fill_diagonal(gain, -np.inf)
        i, j = divmod(int(gain.argmax()), n)
        if not gain[i, j] > 1e-15:
            return label
        i, j = min(i, j), max(i, j)
        part[i] += part[j]
        part[:, i] += part[:, j]
        share[i] += share[j]
        alive[j] = False
        label[label == j] = i


def _labels(edges: DataFrame, vertices: DataFrame, find, by: tuple[str, ...]) -> DataFrame:
    """(*by, v, root): what ``find`` (n, u, v, w) makes of each graph; vertices without an edge are their own."""
    kind = edges.schema["src"].dataType.simpleString()
    schema = ", ".join([*(f"{c} {edges.schema[c].dataType.simpleString()}" for c in by), f"v {kind}", f"root {kind}"])

    def run(t: pd.DataFrame) -> pd.DataFrame:
        names, s, d = numbered(t["src"].to_numpy(), t["dst"].to_numpy())
        u, v, w = undirected(s, d, t["weight"].to_numpy(float))
        label = find(len(names), u, v, w)
        return pd.DataFrame({**{c: t[c].iloc[0] for c in by}, "v": names, "root": names[label]})

    if by:
        return edges.select(*by, "src", "dst", "weight").groupBy(*by).applyInPandas(run, schema)
    found = edges.select("src", "dst", "weight", F.lit(0).alias("graph")).groupBy("graph").applyInPandas(run, schema)
    return vertices.join(found, "v", "left").select("v", F.coalesce("root", F.col("v").cast(kind)).alias("root"))


def curvature_communities(edges: DataFrame, vertices: DataFrame | None = None, threshold: float = 0.0, iterative: bool = True, max_removals: int | None = None, patience: int = 25, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, v, root) by removal of negatively curved edges."""
    return _labels(edges, vertices, lambda n, u, v, w: communities_by_removal(n, u, v, w, threshold, iterative, max_removals, patience), by)


def modularity_communities(edges: DataFrame, vertices: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, v, root) by greedy mergers, without weights."""
    return _labels(edges, vertices, lambda n, u, v, w: communities_by_merging(n, u, v), by)


# a null ---------------------------------------------------------------------------------------------------------------


def rewired(n: int, u: np.ndarray, v: np.ndarray, swaps: int, tries: int, rng: np.random.Generator) -> list[set[int]]:
    """Neighbours after double edge swaps, which keep every degree; fewer swaps where there is no room for more."""
    near: list[set[int]] = [set() for _ in range(n)]
    ends = [u.tolist(), v.tolist()]
    for x, y in zip(*ends, strict=True):
        near[x].add(y)
        near[y].add(x)
    if len(u) < 2 or n < 4:
        return near
    done = 0
    draws = rng.integers(0, len(u), (tries, 2))
    turns = rng.integers(0, 2, tries)
    for (e, g), turn in zip(draws.tolist(), turns.tolist(), strict=True):
        if done == swaps:
            break
        a, b, c, d = ends[0][e], ends[1][e], ends[0][g], ends[1][g]
        if turn:
            c, d = d, c
        if len({a, b, c, d}) < 4 or d in near[a] or b in near[c]:
            continue
        for x, y in ((a, b), (c, d)):
            near[x].discard(y)
            near[y].discard(x)
        for x, y in ((a, d), (c, b)):
            near[x].add(y)
            near[y].add(x)
        ends[0][e], ends[1][e], ends[0][g], ends[1][g] = a, d, c, b
        done += 1
    return near


def configuration_null(edges: DataFrame, n_null: int = 200, swap_mult: int = 10, seed: int = 0) -> DataFrame:
    """(src, dst, m, mean, sd, z) of every edge u < v: its common neighbours against those of its ends in graphs rewired with all degrees kept.

    Every replicate is a task; 0 where the replicates don't vary.
    """
    reps = edges.select("src", "dst", "weight").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_null))))
    kind = edges.schema["src"].dataType.simpleString()

    def run(t: pd.DataFrame) -> pd.DataFrame:
        rep = int(t["rep"].iloc[0])
        names, s, d = numbered(t["src"].to_numpy(), t["dst"].to_numpy())
        u, v, _ = undirected(s, d, t["weight"].to_numpy(float))
        swaps = 0 if rep == 0 else swap_mult * len(u)  # replicate 0 is the graph itself
        near = rewired(len(names), u, v, swaps, 20 * swaps, np.random.default_rng([seed, rep]))
        m = [len(near[x] & near[y] - {x, y}) for x, y in zip(u.tolist(), v.tolist(), strict=True)]
        return pd.DataFrame({"src": names[u], "dst": names[v], "rep": rep, "m": np.array(m, np.int64)})

    found = reps.groupBy("rep").applyInPandas(run, f"src {kind}, dst {kind}, rep int, m long")
    own, other = F.when(F.col("rep") == 0, F.col("m")), F.when(F.col("rep") > 0, F.col("m").cast("double"))
    sums = found.groupBy("src", "dst").agg(F.max(own).alias("m"), F.avg(other).alias("mean"), F.stddev_samp(other).alias("sd"))
    return sums.withColumn("z", F.when(F.col("sd") > 0, (F.col("m") - F.col("mean")) / F.col("sd")).otherwise(0.0))


def significant(null: DataFrame) -> DataFrame:
    """One row: the share of edges with |z| over 2."""
    return null.agg(F.coalesce(F.avg((F.abs("z") > 2).cast("double")), F.lit(0.0)).alias("share"), F.count("*").alias("n"))


def adjusted_rand(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the adjusted Rand index of two labellings (v, root) and (v, label), by pairs counted in the table of both."""
    both = found.select("v", F.col("root").alias("a")).join(truth.select("v", F.col("label").alias("b")), "v")
    cells = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    two = lambda x: F.sum(x * (x - 1) / 2)
    one = cells.agg(two(F.col("n")).alias("cells"), F.sum("n").alias("of"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("rows"))
    columns = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("columns"))
    row = one.crossJoin(rows).crossJoin(columns)  # one row each
    every = F.col("of") * (F.col("of") - 1) / 2
    expected = F.try_divide(F.col("rows") * F.col("columns"), every)
    most = (F.col("rows") + F.col("columns")) / 2
    return row.select(F.coalesce(F.try_divide(F.col("cells") - expected, most - expected), F.lit(1.0)).alias("ari"))
