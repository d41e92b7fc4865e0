"""Pairs of rows within a radius: square blocks with margins, crowded ones dealt to part by part tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block's side in radii; rows of a block, its margin included, that one task compares with each other; own rows compared at once.
SIDE, MOST_ROWS, AT_ONCE = 4, 20_000, 512


def dealt(rows: DataFrame, radius: float, x: str, y: str, split_by: Column, by: list[str] = (), most: int = MOST_ROWS) -> tuple[DataFrame, list[str], bool]:
    """rows in the blocks that see them, the columns that name a task, and whether blocks were split.

    A row `asks` in its own block and `meets` the askers of every block within the radius of it. The parts of a
    block come from its number of rows: each part of askers meets each part of all rows in a task of its own.
    """
    size = SIDE * radius
    at = lambda c, by: F.floor((F.col(c).cast("double") + by) / size)
    span = lambda c: F.explode(F.sequence(at(c, -radius), at(c, radius)))
    rows = rows.select("*", span(x).alias("block_x")).select("*", span(y).alias("block_y"))
    rows = rows.withColumn("own", (F.col("block_x") == at(x, 0)) & (F.col("block_y") == at(y, 0)))
    block = [*by, "block_x", "block_y"]
    large = rows.groupBy(*block).agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).filter("parts > 1")
    split = not large.isEmpty()
    if split:
        rows = rows.join(large, block, "left").fillna(1, ["parts"])
        part = F.pmod(F.xxhash64(split_by), F.col("parts")).cast("int")
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        asks = F.transform(every, lambda q: F.struct(part.alias("p"), q.alias("q"), F.lit(True).alias("asks"), F.lit(False).alias("meets")))
        meets = F.transform(every, lambda p: F.struct(p.alias("p"), part.alias("q"), F.lit(False).alias("asks"), F.lit(True).alias("meets")))
        rows = rows.select("*", F.inline(F.when(F.col("own"), F.concat(asks, meets)).otherwise(meets))).drop("parts", "own")
    else:
        rows = rows.select("*", F.lit(0).alias("p"), F.lit(0).alias("q"), F.col("own").alias("asks"), F.lit(True).alias("meets")).drop("own")
    return rows, [*block, "p", "q"], split


def near(mine: pd.DataFrame, others: pd.DataFrame, radius: float, x: str, y: str) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """For stretches of mine and of others, both sorted by x: which are within the radius, as a matrix of booleans."""
    mx, my, ox, oy = (d[c].to_numpy(np.float64) for d in (mine, others) for c in (x, y))
    for i in range(0, len(mine), AT_ONCE):
        part = slice(i, i + AT_ONCE)
        a, b = np.searchsorted(ox, (mx[part][0] - radius * 1.001, mx[part][-1] + radius * 1.001))
        dx, dy = mx[part, None] - ox[a:b], my[part, None] - oy[a:b]
        yield part, slice(a, b), dx * dx + dy * dy <= float(radius) ** 2
