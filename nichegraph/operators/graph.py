"""The gene graph: edges, centrality, modules, places of labels; small dense kernels run in one task each.

The graph has a vertex per gene, some thousands at most, whatever the number of points.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichegraph.operators import gauss
from nichegraph.sources.cuts import written

#: Vertices that a dense kernel takes; lengths of paths that differ by less are equal.
MOST_VERTICES, TIE = 8_000, 1e-12
#: Points of a cluster that are all compared with each other.
FEW_POINTS = 500


def graph_edges(pairs: DataFrame, weight: str = "Z", self_loops: bool = False, required: bool = False) -> DataFrame:
    """(a, b, weight) of kept pairs, without self-loops unless asked for. required: ValueError if there are none."""
    e = pairs.filter("keep")
    e = (e if self_loops else e.filter("g_a <> g_b")).select(F.col("g_a").alias("a"), F.col("g_b").alias("b"), F.col(weight).alias("weight"))
    if required and e.isEmpty():
        raise ValueError("no pair of genes is kept")
    return e


def both_ways(edges: DataFrame) -> DataFrame:
    """(i, j, weight) in both directions; a self-loop comes once."""
    return edges.select(F.col("a").alias("i"), F.col("b").alias("j"), "weight").union(edges.filter("a <> b").select("b", "a", "weight"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("gene")).union(edges.select("b")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """(gene, strength, degree)."""
    return both_ways(edges).groupBy(F.col("i").alias("gene")).agg(F.sum("weight").alias("strength"), F.count("*").alias("degree"))


def adjacency_l2(edges: DataFrame) -> DataFrame:
    """(i, j, value): rows of the adjacency matrix at Euclidean length 1."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("i")))
    return both_ways(edges).select("i", "j", F.try_divide("weight", norm).alias("value"))


def _dense(rows: pd.DataFrame, value: str = "weight") -> tuple[list[str], np.ndarray]:
    names = sorted({*rows["a"], *rows["b"]})
    if len(names) > MOST_VERTICES:
        raise ValueError(f"{len(names)} vertices are too many for a dense kernel")
    at = {n: k for k, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    i, j = [at[n] for n in rows["a"]], [at[n] for n in rows["b"]]
    m[i, j] = m[j, i] = rows[value]
    return names, m


def _whole(edges: DataFrame, kernel, schema: str) -> DataFrame:
    return edges.select(F.lit(0).alias("whole"), "a", "b", "weight").groupBy("whole").applyInPandas(kernel, schema)


def distances(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, gene, distance) of all pairs that paths connect, and links (i, j, length): a link's length is 1 / weight.

    Frontier relaxation from all sources at once: what became nearer in a round goes on over its links, and the
    nearest offer counts; a round is a join and a grouping of its frontier. Links of weights up to 0 are left out.
    """
    links = written(both_ways(edges.filter("a <> b")).filter("weight > 0").groupBy("i", "j").agg(F.min(1 / F.col("weight")).alias("length")))
    start = vertices(edges.filter("a <> b"))
    known = written(start.select(F.col("gene").alias("source"), "gene", F.lit(0.0).alias("distance"), F.lit(True).alias("nearer")))
    while True:
        offers = known.filter("nearer").join(links, F.col("gene") == F.col("i")).groupBy("source", F.col("j").alias("gene")).agg(F.min(F.col("distance") + F.col("length")).alias("offer"))
        both = known.select("source", "gene", "distance", F.lit(None).cast("double").alias("offer")).unionByName(offers.withColumn("distance", F.lit(None).cast("double")))
        both = both.groupBy("source", "gene").agg(F.min("distance").alias("old"), F.min("offer").alias("offer"))
        nearer = F.col("offer").isNotNull() & (F.col("old").isNull() | (F.col("offer") < F.col("old") - TIE))
        known = written(both.select("source", "gene", F.when(nearer, F.col("offer")).otherwise(F.col("old")).alias("distance"), nearer.alias("nearer")))
        if known.filter("nearer").isEmpty():
            return known.drop("nearer"), links


def shortest_path_centrality(edges: DataFrame) -> DataFrame:
    """(gene, betweenness, closeness): paths by length 1 / weight; undirected, unnormalised.

    closeness: vertices reached over the sum of distances to them, 0 for none. Shortest paths are counted by the number of
    their links; shares of paths are then summed up backwards, from the pairs with most links. Lengths within
    TIE of each other are equal. No task holds the graph, and there is no bound on vertices.
    """
    known, links = distances(edges)
    far = known.select("source", F.col("gene").alias("j"), F.col("distance").alias("far"))
    steps = known.join(links, F.col("gene") == F.col("i")).join(far, ["source", "j"]).filter((F.abs(F.col("distance") + F.col("length") - F.col("far")) <= TIE) & (F.col("far") > F.col("distance")))
    steps = written(steps.select("source", "gene", "j"))  # the links that shortest paths go over, by source
    paths = known.filter("source = gene").select("source", "gene", F.lit(0).alias("links"), F.lit(1.0).alias("ways"))
    every = paths
    while True:
        paths = written(paths.join(steps, ["source", "gene"]).groupBy("source", F.col("j").alias("gene")).agg(F.sum("ways").alias("ways"), (F.max("links") + 1).alias("links")).select("source", "gene", "links", "ways"))
        if paths.isEmpty():
            break
        every = every.union(paths)
    ways = written(every.groupBy("source", "gene").agg(F.sum("ways").alias("ways"), F.max("links").alias("links")))
    through = None
    of_end = ways.select("source", F.col("gene").alias("j"), F.col("ways").alias("ways_j"), F.col("links").alias("links_j"))
    for n in range(ways.agg(F.max("links")).first()[0] or 0, 1, -1):
        ends = of_end.filter(F.col("links_j") == n)
        if through is not None:
            ends = ends.join(through.groupBy("source", F.col("gene").alias("j")).agg(F.sum("share").alias("own")), ["source", "j"], "left")
        else:
            ends = ends.withColumn("own", F.lit(0.0))
        part = steps.join(ends, ["source", "j"]).join(ways, ["source", "gene"]).filter("source <> gene")
        part = written(part.select("source", "gene", (F.col("ways") / F.col("ways_j") * (1 + F.coalesce("own", F.lit(0.0)))).alias("share")))
        through = part if through is None else through.union(part)
    close = known.filter("source <> gene").groupBy(F.col("source").alias("gene")).agg((F.count("*") / F.sum("distance")).alias("closeness"))
    out = vertices(edges.filter("a <> b")).join(close, "gene", "left")
    if through is not None:
        out = out.join(through.groupBy("gene").agg((F.sum("share") / 2).alias("betweenness")), "gene", "left")
    else:
        out = out.withColumn("betweenness", F.lit(0.0))
    return out.select("gene", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), F.coalesce("closeness", F.lit(0.0)).alias("closeness"))


def eigenvector(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(gene, eigenvector): the leading eigenvector by power iteration, largest entry 1."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        names, m = _dense(rows)
        v = np.ones(len(names))
        for _ in range(rounds):  # the shift keeps bipartite graphs from alternating
            new = m @ v + v
            new /= np.abs(new).max()
            if np.abs(new - v).max() < 1e-13:
                break
            v = new
        return pd.DataFrame({"gene": names, "eigenvector": v})

    return _whole(edges, kernel, "gene string, eigenvector double")


def centrality(edges: DataFrame) -> DataFrame:
    """(gene, strength, degree, betweenness, closeness, eigenvector)."""
    return degree(edges).join(shortest_path_centrality(edges), "gene").join(eigenvector(edges), "gene")


def _simplex(m: np.ndarray) -> np.ndarray:
    """Rows projected on the probability simplex."""
    u = -np.sort(-m, axis=1)
    c = (u.cumsum(1) - 1) / np.arange(1, m.shape[1] + 1)
    k = (u > c).sum(1) - 1
    return np.maximum(m - c[np.arange(len(m)), k][:, None], 0)


def archetypes(edges: DataFrame, k: int, rounds: int = 300, seed: int = 42) -> DataFrame:
    """(matrix, gene, archetype, weight): W (genes' shares of archetypes, rows sum to 1) and H (archetypes' shares of genes).

    Least squares of X - W H X over the simplex, X the row-normalised adjacency: furthest rows first, then
    alternating projected gradient steps that never raise the residual.
    """

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        names, m = _dense(rows)
        x = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        n, kk = len(names), min(k, len(names))
        picks = [int(np.random.default_rng(seed).integers(n))]
        while len(picks) < kk:
            far = np.min([((x - x[p]) ** 2).sum(1) for p in picks], axis=0)
            far[picks] = -1
            picks.append(int(np.argmax(far)))
        h = np.zeros((kk, n))
        h[np.arange(kk), picks] = 1
        w = np.full((n, kk), 1 / kk)
        g = x @ x.T
        for _ in range(rounds):
            hg = h @ g
            a = hg @ h.T
            w = _simplex(w - (w @ a - hg.T) / max(np.linalg.norm(a, 2), 1e-12))
            b = w.T @ w
            h = _simplex(h - (b @ h @ g - w.T @ g) / max(np.linalg.norm(b, 2) * np.linalg.norm(g, 2), 1e-12))
        out = [("W", names[i], j, w[i, j]) for i in range(n) for j in range(kk)] + [("H", names[i], j, h[j, i]) for j in range(kk) for i in range(n)]
        return pd.DataFrame(out, columns=["matrix", "gene", "archetype", "weight"])

    return _whole(edges, kernel, "matrix string, gene string, archetype int, weight double")


def nmf(edges: DataFrame, k: int, rounds: int = 500) -> DataFrame:
    """(gene, component, weight): non-negative factors of the adjacency, started from its singular vectors."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        names, m = _dense(rows)
        m, kk = np.maximum(m, 0), min(k, len(names))
        u, s, v = np.linalg.svd(m)
        w, h = np.zeros((len(names), kk)), np.zeros((kk, len(names)))
        for j in range(kk):
            parts = [(np.maximum(u[:, j] * t, 0), np.maximum(v[j] * t, 0)) for t in (1, -1)]
            a, b = max(parts, key=lambda p: np.linalg.norm(p[0]) * np.linalg.norm(p[1]))
            size = np.linalg.norm(a) * np.linalg.norm(b)
            if size > 0:
                w[:, j], h[j] = a / np.linalg.norm(a) * np.sqrt(s[j] * size), b / np.linalg.norm(b) * np.sqrt(s[j] * size)
        w, h = np.maximum(w, 1e-9), np.maximum(h, 1e-9)
        for _ in range(rounds):
            h *= (w.T @ m) / np.maximum(w.T @ w @ h, 1e-12)
            w *= (m @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
        return pd.DataFrame([(names[i], j, w[i, j]) for i in range(len(names)) for j in range(kk)], columns=["gene", "component", "weight"])

    return _whole(edges, kernel, "gene string, component int, weight double")


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 100) -> DataFrame:
    """(gene, cluster): local moves that raise modularity at the resolution, in order of names; clusters by their first gene."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        names, m = _dense(rows)
        m = np.maximum(m, 0)
        strength, total = m.sum(1), max(m.sum(), 1e-12)
        of = np.arange(len(names))
        for _ in range(rounds):
            moved = False
            for i in range(len(names)):
                own = of[i]
                of[i] = -1
                to = np.unique(np.append(of[(m[i] > 0) & (of >= 0)], own))
                gain = [m[i, of == c].sum() - resolution * strength[i] * strength[of == c].sum() / total for c in to]
                best = int(np.argmax(gain))
                of[i] = to[best] if gain[best] > gain[int(np.flatnonzero(to == own)[0])] + 1e-12 else own
                moved |= of[i] != own
            if not moved:
                break
        first = {c: k for k, c in enumerate(dict.fromkeys(of))}
        return pd.DataFrame({"gene": names, "cluster": [first[c] for c in of]})

    return _whole(edges, kernel, "gene string, cluster int")


def modules(weights: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(module, genes): genes with at least the threshold's weight in an archetype, sorted."""
    return weights.filter(F.col("weight") >= threshold).groupBy(F.col("archetype").alias("module")).agg(F.array_sort(F.collect_list("gene")).alias("genes"))


def all_modules(weights: DataFrame, k: int, threshold: float = 0.3) -> DataFrame:
    """modules() with an empty list for those of the k archetypes that no gene reaches."""
    every = weights.sparkSession.range(k).select(F.col("id").cast("int").alias("module"))
    found = modules(weights, threshold)
    return every.join(found, "module", "left").select("module", F.coalesce("genes", F.array().cast("array<string>")).alias("genes"))


def membership(genes: DataFrame, weights: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(gene, cluster, primary): a gene's archetypes, an empty list if none, and the first or -1."""
    of = weights.filter(F.col("weight") >= threshold).groupBy("gene").agg(F.array_sort(F.collect_list("archetype")).alias("cluster"))
    out = genes.select("gene").distinct().join(of, "gene", "left").select("gene", F.coalesce("cluster", F.array().cast("array<int>")).alias("cluster"))
    return out.withColumn("primary", F.coalesce(F.get("cluster", F.lit(0)), F.lit(-1)))


def top_genes(weights: DataFrame, k: int, group: str = "archetype") -> DataFrame:
    """The k largest weights of each group; ties by name."""
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("weight"), "gene"))
    return weights.withColumn("rank", r).filter(F.col("rank") <= k)


def gene_program(weights: DataFrame, archetype: int, threshold: float = 0.3, top_n: int = 25) -> DataFrame:
    """(gene, weight) of an archetype, at least the threshold, the top_n largest. ValueError for an archetype without weights."""
    if weights.filter(F.col("archetype") == archetype).isEmpty():
        raise ValueError(f"there is no archetype {archetype}")
    return weights.filter((F.col("archetype") == archetype) & (F.col("weight") >= threshold)).orderBy(F.desc("weight"), "gene").limit(top_n).select("gene", "weight")


def umap_distance(edges: DataFrame) -> DataFrame:
    """(i, j, distance) of all ordered pairs of genes: the largest weight less the pair's; the diagonal has the largest."""
    v, w = vertices(edges), both_ways(edges)
    top = edges.agg(F.max("weight").alias("top"))
    every = v.select(F.col("gene").alias("i")).crossJoin(v.select(F.col("gene").alias("j"))).crossJoin(top)  # genes only: a dense result by definition
    return every.join(w, ["i", "j"], "left").select("i", "j", (F.col("top") - F.coalesce("weight", F.lit(0.0))).alias("distance"))


def density_peaks(points: DataFrame, clusters: list[int] | None = None) -> DataFrame:
    """(cluster, gene, x, y, n): of each cluster of more than three points the one in its densest place, where a label goes.

    points: (cluster, gene, x, y). The density is that of a Gaussian kernel with the cluster's own covariance,
    scaled by n ** (-1/3); a constant factor doesn't move the peak and is left out. Of equal densities the first
    gene by name is taken. Points without coordinates are left out; so are clusters whose points are on one line,
    as their covariance has no inverse. clusters: only these.

    In clusters of more than FEW_POINTS series rule out all places but those that may be the densest. These, and all places of
    smaller clusters, are compared by sums over every point of the cluster. Places of one density to nine digits,
    such as a ring's, are all kept for that.
    """
    p = points.filter("x is not null and y is not null and not isnan(x) and not isnan(y) and cluster is not null").select("cluster", "gene", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if clusters is not None:
        p = p.filter(F.col("cluster").isin(clusters))
    of = p.groupBy("cluster").agg(F.count("*").alias("n"), F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"), F.covar_samp("x", "y").alias("xy"), F.avg("x").alias("mx"), F.avg("y").alias("my")).filter("n > 3")
    scale = F.pow(F.col("n").cast("double"), F.lit(-1 / 3))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    of = of.filter(det > 1e-12 * F.col("xx") * F.col("yy")).select("cluster", "n", "mx", "my", (1e-9 + 1e-14 * (F.col("xx") * F.col("yy") / det)).alias("slack"), F.try_divide(F.lit(1.0), F.sqrt(F.col("yy") * scale)).alias("up"), *((F.col(c) / det / scale).alias(c) for c in ("xx", "yy", "xy")))
    # equal rows count by their number squared, as each of them meets all of them
    same = p.groupBy("cluster", "x", "y", "gene").agg(F.count("*").alias("k")).groupBy("cluster", "x", "y").agg(F.sum("k").alias("m"), F.min(F.struct((-F.col("k")).alias("less"), "gene")).alias("top"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    across = F.sqrt("yy") * dx - F.try_divide("xy", F.sqrt("yy")) * dy
    usual = reduce(and_, (F.col(c).between(1e-100, 1e100) for c in ("xx", "yy", "up")))  # doubles hold their products
    many = (F.col("n") > FEW_POINTS) & F.coalesce(usual, F.lit(False))
    places = written(same.join(of, "cluster").select("cluster", "x", "y", "m", (-F.col("top.less")).alias("k"), "top.gene", "n", "xx", "yy", "xy", "slack", many.alias("many"), across.alias("u"), (F.col("up") * dy).alias("v")))
    asked = places.filter("not many").unionByName(gauss.may_be_densest(places.filter("many")))
    other = places.select("cluster", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("m").alias("om"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    kernel = F.exp(-0.5 * (F.col("yy") * dx * dx - 2 * F.col("xy") * dx * dy + F.col("xx") * dy * dy))
    near = asked.join(other, "cluster").groupBy("cluster", "gene", "x", "y", "n").agg(F.sum(F.col("k") * F.col("om") * kernel).alias("density"))
    top = near.groupBy("cluster").agg(F.min(F.struct((-F.round("density", 9)).alias("less"), "gene", "x", "y", "n")).alias("top"))
    return top.select("cluster", "top.gene", "top.x", "top.y", "top.n")
