"""Overlap of cells and modules: dense points of a module's genes, by neighbour counts, as shares of a cell's points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegraph.operators import blocks
from nichegraph.operators.curve import quantiles

#: Rows of a block from which whole cells are summed up.
DENSE = 2_000


def _sites(pts: DataFrame, module_genes: DataFrame) -> DataFrame:
    """(module, x, y, m): a module's points by place; equal points are one row with their number."""
    return pts.join(module_genes, "gene").groupBy("module", "x", "y").agg(F.count("*").alias("m"))


def near_sums(sites: DataFrame, radius: float, weight: str, most: int = blocks.MOST_ROWS) -> DataFrame:
    """sites (module, x, y, ...) with near: the weights of the module's sites within the radius, its own included.

    Sites are dealt to blocks with a margin of the radius; sums of the parts of a crowded block add up.
    """
    names = [c for c in sites.columns if c not in ("module", "x", "y")]
    rows, task, split = blocks.dealt(sites, radius, "x", "y", F.struct("x", "y"), ["module"], most)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mine, others = rows[rows["asks"]].sort_values("x"), rows[rows["meets"]].sort_values("x")
        w, near = others[weight].to_numpy(np.float64), np.zeros(len(mine))
        if len(others) >= DENSE and len(mine):
            near = tiled_sums(*(d[c].to_numpy(np.float64) for d in (mine, others) for c in ("x", "y")), w, radius)
        else:
            for i, j, within in blocks.near(mine, others, radius, "x", "y"):
                near[i] = within @ w[j]
        return mine[["module", "x", "y", *names]].assign(near=near.astype(np.int64))

    schema = sites.select("module", "x", "y", *names).withColumn("near", F.lit(0).cast("long")).schema
    out = rows.groupBy(*task).applyInPandas(run, schema)
    return out.groupBy("module", "x", "y", *names).agg(F.sum("near").alias("near")) if split else out


def tiled_sums(x: np.ndarray, y: np.ndarray, ox: np.ndarray, oy: np.ndarray, w: np.ndarray, radius: float) -> np.ndarray:
    """For each point the weights of the others within the radius: whole cells near its tile as sums, those on the circle's rim point by point.

    Cells are an eighth of the radius wide, tiles two cells. A column of cells is sorted, so that a run of its cells is
    a stretch of the others and the difference of two running sums.
    """
    c, x0, y0 = radius / 8, ox.min(), oy.min()
    place = lambda v, low: np.floor((v - low) / c).astype(np.int64)
    cx, cy = place(ox, x0), place(oy, y0)
    wide, high = int(cx.max()) + 1, int(cy.max()) + 1
    order = np.argsort(cx * high + cy, kind="stable")
    ox, oy, w = ox[order], oy[order], w[order]
    start = np.searchsorted((cx * high + cy)[order], np.arange(wide * high + 1))
    running = np.concatenate([[0.0], np.cumsum(w)])
    # by column beside the tile's first: cells that a circle round any of the tile's points may reach, and those that all hold
    d = np.arange(-9, 11)
    gap, far = np.maximum(np.maximum(d - 2, -(d + 1)), 0) ** 2, np.maximum(np.abs(d + 1), np.abs(2 - d)) ** 2
    columns = []
    for k, dx in enumerate(d):
        out, inner = d[gap[k] + gap <= 64 * (1 + 1e-9)], d[far[k] + far <= 64 * (1 - 1e-9)]
        if len(out):
            columns.append((dx, out[0], out[-1] + 1, *((inner[0], inner[-1] + 1) if len(inner) else (out[0], out[0]))))
    near, tile = np.zeros(len(x)), np.stack([place(x, x0) // 2, place(y, y0) // 2], axis=1)
    sorted_by = np.lexsort((tile[:, 1], tile[:, 0]))
    ends = np.flatnonzero((np.diff(tile[sorted_by], axis=0) != 0).any(1)) + 1
    for own in np.split(sorted_by, ends):
        tx, ty = 2 * tile[own[0]]
        whole, rim = 0.0, []
        for dx, a, b, p, q in columns:
            if 0 <= tx + dx < wide:
                row = (tx + dx) * high
                a, p, q, b = (start[row + min(max(ty + v, 0), high)] for v in (a, p, q, b))
                whole += running[q] - running[p]
                rim += [slice(a, p), slice(q, b)]
        rx, ry, rw = (np.concatenate([v[s] for s in rim]) if rim else np.zeros(0) for v in (ox, oy, w))
        ex, ey = x[own, None] - rx, y[own, None] - ry
        near[own] = whole + (ex * ex + ey * ey <= float(radius) ** 2) @ rw
    return near


def density(pts: DataFrame, module_genes: DataFrame, radius: float = 10, least: int = 50) -> DataFrame:
    """(module, x, y, m, near, min_samples): points within the radius, itself included, and the module's minimum.

    The minimum is the 80th percentile of the points' neighbours, themselves left out, as a whole number, and
    at least `least`.
    """
    s = near_sums(_sites(pts, module_genes), radius, "m").persist()  # read by the quantiles and the result
    t = quantiles(s.select("module", (F.col("near") - 1).cast("double").alias("value"), F.col("m").alias("freq")), "module", {"t": 0.8})
    t = t.select("module", F.greatest(F.floor("t"), F.lit(least)).cast("long").alias("min_samples"))
    return s.join(F.broadcast(t), "module")  # a row per module


def clustered(pts: DataFrame, module_genes: DataFrame, radius: float = 10, least: int = 50) -> DataFrame:
    """(module, x, y) of clustered places: core places, with at least the minimum near, and places within the radius of one."""
    d = density(pts, module_genes, radius, least).select("module", "x", "y", (F.col("near") >= F.col("min_samples")).cast("int").alias("core"))
    return near_sums(d, radius, "core").filter("near > 0").select("module", "x", "y")


def cell_overlaps(pts: DataFrame, module_genes: DataFrame, n_modules: int, radius: float = 10, least: int = 50) -> DataFrame:
    """(cell, module_0, ...): shares of a cell's points in each module; of several, a point is in the last. Null cells go."""
    genes = module_genes.filter(F.col("module") < n_modules)
    of = clustered(pts, genes, radius, least).join(genes, "module").groupBy("gene", "x", "y").agg(F.max("module").alias("module"))
    rows = pts.filter("cell is not null").join(of, ["gene", "x", "y"], "left")
    total = F.count("*")
    return rows.groupBy("cell").agg(*((F.count_if(F.col("module") == k) / total).alias(f"module_{k}") for k in range(n_modules)))
