"""Proximity edges and gene pairs that are together more than an analytic null model expects."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegraph.operators import blocks


def meta_edges(meta: DataFrame, radius: float = 10, by: list[str] = (), most: int = blocks.MOST_ROWS) -> DataFrame:
    """(edge_source, edge_target, weight, gene_source, gene_target) of clusters within the radius; weight: product of sizes.

    Each pair comes once, the smaller id first, from the block of that id's cluster.
    """
    schema = meta.select(*by, F.col("meta_id").alias("edge_source"), F.col("meta_id").alias("edge_target"), F.col("n").cast("long").alias("weight"), F.col("gene").alias("gene_source"), F.col("gene").alias("gene_target")).schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mine, others = _sides(rows)
        a, b = mine["meta_id"].to_numpy(), others["meta_id"].to_numpy()
        found = [(np.zeros(0, int), np.zeros(0, int))]
        for i, j, within in blocks.near(mine, others, radius, "x_centroid", "y_centroid"):
            k, m = np.nonzero(within & (a[i, None] < b[j]))
            found.append((k + i.start, m + j.start))
        one, two = mine.iloc[np.concatenate([f[0] for f in found])], others.iloc[np.concatenate([f[1] for f in found])]
        weight = one["n"].to_numpy(np.int64) * two["n"].to_numpy(np.int64)
        out = pd.DataFrame({"edge_source": one["meta_id"].to_numpy(), "edge_target": two["meta_id"].to_numpy(), "weight": weight, "gene_source": one["gene"].to_numpy(), "gene_target": two["gene"].to_numpy()})
        return out.assign(**{c: rows[c].iloc[0] for c in by})[[*by, *out.columns]]

    rows, task, _ = _tasks(meta, radius, by, most)
    return rows.groupBy(*task).applyInPandas(run, schema)


def _tasks(meta: DataFrame, radius: float, by: list[str], most: int) -> tuple[DataFrame, list[str], bool]:
    rows = meta.select(*by, "meta_id", "gene", "n", "x_centroid", "y_centroid").filter("x_centroid is not null and y_centroid is not null")
    return blocks.dealt(rows, radius, "x_centroid", "y_centroid", F.col("meta_id"), list(by), most)


def _sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return tuple(rows[rows[c]].sort_values("x_centroid") for c in ("asks", "meets"))


def pair_sums(meta: DataFrame, radius: float = 12, undirected: bool = True, by: list[str] = (), most: int = blocks.MOST_ROWS) -> DataFrame:
    """(g_a, g_b, w, m) per pair of genes: the sum of edges' weights and their number, without a row per edge.

    A task adds up its own edges by pairs of genes, as products of matrices: sizes of one gene's clusters, who is
    near, sizes of the other's. What is shuffled is a row per task and pair of genes. Directed pairs follow ids.
    """
    schema = meta.select(*by, F.col("gene").alias("g_a"), F.col("gene").alias("g_b"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("m")).schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mine, others = _sides(rows)
        names, code = np.unique(np.concatenate([mine["gene"], others["gene"]]).astype(str), return_inverse=True)
        ga, gb = code[: len(mine)], code[len(mine) :]
        a, b, na, nb = (d[c].to_numpy(np.int64) for c in ("meta_id", "n") for d in (mine, others))
        w, m = (np.zeros(len(names) ** 2 if len(names) < 2048 else 0, dtype=np.int64) for _ in range(2))
        parts = []
        for i, j, within in blocks.near(mine, others, radius, "x_centroid", "y_centroid"):
            k, q = np.nonzero(within & (a[i, None] < b[j]))
            first, second = ga[i][k], gb[j][q]
            if undirected:  # names are in order, so codes are
                first, second = np.minimum(first, second), np.maximum(first, second)
            keys, weight = first * len(names) + second, na[i][k] * nb[j][q]
            if len(w):
                np.add.at(w, keys, weight)
                np.add.at(m, keys, 1)
            else:
                part = pd.DataFrame({"key": keys, "w": weight, "m": 1}).groupby("key", as_index=False).sum()
                parts.append(part)
        sums = pd.concat(parts).groupby("key", as_index=False).sum() if parts else pd.DataFrame({"key": np.flatnonzero(m), "w": w[m > 0], "m": m[m > 0]})
        out = pd.DataFrame({"g_a": names[sums["key"] // max(1, len(names))], "g_b": names[sums["key"] % max(1, len(names))], "w": sums["w"], "m": sums["m"]})
        return out.assign(**{c: rows[c].iloc[0] for c in by})[[*by, *out.columns]]

    rows, task, _ = _tasks(meta, radius, by, most)
    return rows.groupBy(*task).applyInPandas(run, schema).groupBy(*by, "g_a", "g_b").agg(F.sum("w").alias("w"), F.sum("m").alias("m"))


def gene_frequency(meta: DataFrame, eps: float = 1e-9, by: list[str] = ()) -> DataFrame:
    """(gene, total, f): each gene's share of all cluster sizes."""
    g = meta.groupBy(*by, "gene").agg(F.sum("n").alias("total"))
    if not by:
        return g.crossJoin(g.agg(F.sum("total").alias("every"))).select("gene", "total", (F.col("total") / (F.col("every") + eps)).alias("f"))
    every = g.groupBy(*by).agg(F.sum("total").alias("every"))
    return g.join(every, list(by)).select(*by, "gene", "total", (F.col("total") / (F.col("every") + eps)).alias("f"))


@dataclass(frozen=True)
class NullModel:
    pairs: DataFrame
    genes: DataFrame
    totals: DataFrame


def pair_statistics(meta: DataFrame, radius: float = 12, undirected: bool = True, drop_self: bool = False, eps: float = 1e-9, z_thresh: float = 1.96, positive_pmi: bool = True, by: list[str] = ()) -> NullModel:
    """The null model's parts: per pair O, f_a, f_b, E, PMI, Z and keep; gene frequencies; totals.

    The expected weight has no factor 2 for pairs of different genes. With `by` every slice is a model of its
    own, all in one plan. Directed pairs follow the order of cluster ids.
    """
    by, meta = list(by), meta.persist()  # read three times
    o = pair_sums(meta, radius, undirected, by)
    if drop_self:
        o = o.filter("g_a <> g_b")
    totals = o.groupBy(*by).agg(F.sum("w").alias("S"), F.sum("m").alias("n_edges"), F.count("*").alias("n_pairs"))
    genes = gene_frequency(meta, eps, by)
    side = lambda s: genes.select(*by, F.col("gene").alias(f"g_{s}"), F.col("f").alias(f"f_{s}"))
    p = o.join(side("a"), [*by, "g_a"], "left").join(side("b"), [*by, "g_b"], "left").fillna(0.0, ["f_a", "f_b"])
    s = totals.select(*by, F.col("S").cast("double").alias("s"))
    p = p.join(s, by) if by else p.crossJoin(s)
    p = p.select(*by, "g_a", "g_b", F.col("w").cast("double").alias("O"), "f_a", "f_b", (F.col("f_a") * F.col("f_b") * F.col("s")).alias("E"))
    p = p.withColumn("PMI", F.log((F.col("O") + eps) / (F.col("E") + eps))).withColumn("Z", (F.col("O") - F.col("E")) / F.sqrt(F.col("E") + eps))
    keep = F.col("Z") > z_thresh
    return NullModel(p.withColumn("keep", keep & (F.col("PMI") > 0) if positive_pmi else keep), genes, totals)


def stouffer(slices: list[DataFrame], n_thresh: int = 2, z_thresh: float = 1.96, undirected: bool = True) -> DataFrame:
    """(g_a, g_b, Z, n_slices, keep): Z scores of rows with a finite one, combined as their sum over the root of their number."""
    if not slices:
        raise ValueError("there are no slices")
    for s in slices:
        if missing := {"g_a", "g_b", "Z"} - set(s.columns):
            raise ValueError(f"columns are missing: {sorted(missing)}")
    rows = slices[0].select("g_a", "g_b", "Z")
    for s in slices[1:]:
        rows = rows.unionByName(s.select("g_a", "g_b", "Z"))
    rows = rows.filter(F.col("Z").isNotNull() & ~F.isnan("Z") & (F.abs("Z") < float("inf")))
    a, b = (F.least("g_a", "g_b"), F.greatest("g_a", "g_b")) if undirected else (F.col("g_a"), F.col("g_b"))
    out = rows.groupBy(a.alias("g_a"), b.alias("g_b")).agg((F.sum("Z") / F.sqrt(F.count("*"))).alias("Z"), F.count("*").alias("n_slices"))
    return out.withColumn("keep", (F.col("n_slices") >= n_thresh) & (F.col("Z") > z_thresh))
