"""Counts by bin over a stream of points, on a grid with a fixed origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegraph.functions.columns import floor_bin


def stream_bin_counts(points: DataFrame, bin_um: float = 8) -> DataFrame:
    """(bin_x, bin_y, n_total, n_unassigned) of a streaming frame (x, y, cell); write it in update mode."""
    bins = points.groupBy(floor_bin(F.col("x"), bin_um).alias("bin_x"), floor_bin(F.col("y"), bin_um).alias("bin_y"))
    return bins.agg(F.count("*").alias("n_total"), F.count_if(F.col("cell").isNull()).alias("n_unassigned"))
