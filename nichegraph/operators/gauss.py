"""Sums of a Gaussian kernel over all points of a cluster, in time that grows as their number: series by square cells, no pairs of points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells a kernel reaches (beyond them it is under 3e-18), terms of a cell's series by axis (an error under 1e-13 of a kernel's peak), a block's side in cells, places of a task.
REACH, TERMS, SIDE, MOST_PLACES = 9, 14, 36, 100_000
#: Densities are compared after rounding to nine digits; what may come out equal counts as equal.
NEAR = 2e-9


def _links() -> np.ndarray:
    """For offsets of -REACH to REACH cells: exp(-((offset + (a - b) / 2) ** 2) / 2) as a series in Chebyshev polynomials of a and b, both from -1 to 1."""
    k = np.arange(TERMS)
    angle = np.pi * (k + 0.5) / TERMS
    to = np.cos(k[:, None] * angle) * np.where(k, 2, 1)[:, None] / TERMS
    d = np.arange(-REACH, REACH + 1)[:, None, None] + (np.cos(angle)[:, None] - np.cos(angle)) / 2
    return to @ np.exp(-0.5 * d * d) @ to.T


def _by_cell(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Cells with points, sorted; an order of the points by cell, polynomials of their places in it, and each cell's stretch of it."""
    cells = np.floor(np.stack([u, v], axis=1)).astype(np.int64)
    order = np.lexsort((cells[:, 1], cells[:, 0]))
    cells, (tu, tv) = cells[order], (np.polynomial.chebyshev.chebvander(2 * (c - np.floor(c))[order] - 1, TERMS - 1) for c in (u, v))
    first = np.flatnonzero(np.r_[True, (np.diff(cells, axis=0) != 0).any(1)])
    return cells[first], order, tu, tv, list(zip(first, [*first[1:], len(order)]))


def cell_series(u: np.ndarray, v: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells with points, and for each the sums of its points' weights times the products of polynomials of their places."""
    cells, order, tu, tv, stretches = _by_cell(u, v)
    tu *= m[order, None]
    return cells, np.stack([tu[i:j].T @ tv[i:j] for i, j in stretches])


def kernel_sums(u: np.ndarray, v: np.ndarray, cells: np.ndarray, series: np.ndarray) -> np.ndarray:
    """For each point the sum of weights times exp(-distance ** 2 / 2) over all points that the cells' series are of.

    Takes room for all cells from the points' first to their last, and REACH more on each side.
    """
    own, order, tu, tv, stretches = _by_cell(u, v)
    low, high = np.maximum(own.min(0) - REACH, cells.min(0)), np.minimum(own.max(0) + REACH, cells.max(0))
    seen = ((cells >= low) & (cells <= high)).all(1)
    wide, tall = high - low + 1
    grid = np.zeros((wide, TERMS, tall, TERMS))
    at = cells[seen] - low
    grid[at[:, 0], :, at[:, 1], :] = series[seen]
    links = np.concatenate([_links(), np.zeros((1, TERMS, TERMS))])  # the last for cells out of reach

    def along(axis: int) -> np.ndarray:
        d = np.arange(own[:, axis].min(), own[:, axis].max() + 1)[:, None] - np.arange(low[axis], high[axis] + 1)
        m = links[np.where(abs(d) <= REACH, d + REACH, 2 * REACH + 1)]
        return m.transpose(0, 2, 1, 3).reshape(len(m) * TERMS, -1)

    local = (along(0) @ grid.reshape(wide * TERMS, -1) @ along(1).T).reshape(-1, TERMS, np.ptp(own[:, 1]) + 1, TERMS)
    sums = np.zeros(len(u))
    for (x, y), (i, j) in zip(own - own.min(0), stretches):
        sums[order[i:j]] = ((tu[i:j] @ local[x, :, y]) * tv[i:j]).sum(1)
    return sums


def may_be_densest(places: DataFrame, most: int = MOST_PLACES) -> DataFrame:
    """Those places of a cluster that may have its largest k times the density, as far as series can tell: mostly one or two.

    places: (cluster, u, v, m, k, slack, ...), each (cluster, u, v) once, u and v finite and in bandwidths, m points at a place; slack: the share by
    which densities may be off. A cell is a bandwidth wide. The points of a cell are summed up as a series, blocks of cells
    with a margin as series round their own cells, and these give the density of each place. A task takes a part of a
    block's places and at most (SIDE + 2 REACH) ** 2 series, so work grows as the places, however crowded a block is.
    """
    at = lambda c, by: F.floor((F.floor(c) + SIDE // 2 + by) / SIDE)
    block = ["cluster", "block_u", "block_v"]
    rows = places.withColumns({"block_u": at("u", 0), "block_v": at("v", 0)})
    blocks = rows.groupBy(*block).agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    rows = rows.join(blocks, block).withColumn("part", F.pmod(F.xxhash64("u", "v"), F.col("parts")).cast("int")).drop("parts")

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        cells, series = cell_series(*(rows[c].to_numpy(np.float64) for c in ("u", "v", "m")))
        return pd.DataFrame({"cell_u": cells[:, 0], "cell_v": cells[:, 1], "series": list(series.reshape(len(cells), -1))}).assign(cluster=rows["cluster"].iloc[0])[["cluster", "cell_u", "cell_v", "series"]]

    def densest(mine: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return mine[names].assign(about=0.0)
        series = np.stack(cells["series"].to_numpy()).reshape(-1, TERMS, TERMS)
        about = mine["k"].to_numpy(np.float64) * kernel_sums(*(mine[c].to_numpy(np.float64) for c in ("u", "v")), cells[["cell_u", "cell_v"]].to_numpy(), series)
        return mine[names].assign(about=about)[about >= about.max() * (1 - mine["slack"].to_numpy()) - NEAR]

    names = places.columns
    one = places.select("cluster", F.lit(0).cast("long").alias("cell_u"), F.lit(0).cast("long").alias("cell_v"), F.array(F.lit(0.0)).alias("series"))
    cells = rows.select(*block, "part", "u", "v", "m").groupBy(*block, "part").applyInPandas(summed, one.schema).groupBy("cluster", "cell_u", "cell_v")
    cells = cells.agg(F.collect_list("series").alias("every"))  # one for each part of the block
    added = F.reduce("every", F.array_repeat(F.lit(0.0), TERMS * TERMS), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    cells = cells.select("cluster", "cell_u", "cell_v", F.when(F.size("every") == 1, F.get("every", F.lit(0))).otherwise(added).alias("series"))
    for c in ("u", "v"):
        cells = cells.withColumn(f"block_{c}", F.explode(F.sequence(at(f"cell_{c}", -REACH), at(f"cell_{c}", REACH))))
    cells = cells.join(blocks, block).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    out = rows.groupBy(*block, "part").cogroup(cells.groupBy(*block, "part")).applyInPandas(densest, places.withColumn("about", F.lit(0.0)).schema)
    top = F.max("about").over(Window.partitionBy("cluster"))  # few rows of each task
    return out.withColumn("top", top).filter(F.col("about") >= F.col("top") * (1 - F.col("slack")) - NEAR).drop("about", "top")
