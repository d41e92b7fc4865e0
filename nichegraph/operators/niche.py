"""Raster maps of gene modules: sparse counts, Gaussian blur, z-scores over all pixels, weighted sums.

Only pixels that signal reaches are stored. Every other pixel of a map has one value, the map's background.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichegraph.functions.columns import raster_bin
from nichegraph.operators.curve import quantiles


#: Bins of a strip, in which runs are found.
STRIP = 65_536


def grid_meta(pts: DataFrame, bin_size: float) -> DataFrame:
    """One row (x_min, y_min, width, height) over points with numbers for coordinates; nulls without points."""
    ok = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    g = pts.agg(F.min(ok("x")).alias("x_min"), F.max(ok("x")).alias("x_max"), F.min(ok("y")).alias("y_min"), F.max(ok("y")).alias("y_max"))
    size = lambda c: (F.ceil((F.col(f"{c}_max") - F.col(f"{c}_min")) / bin_size) + 1).cast("int")
    return g.select("x_min", "y_min", size("x").alias("width"), size("y").alias("height"))


def pinned(grid: DataFrame) -> DataFrame:
    """The one row of a grid as a local table, so that plans that read it don't read all points again."""
    return grid.sparkSession.createDataFrame(grid.collect(), grid.schema)


def grid_bins(grid: DataFrame) -> DataFrame:
    """(bin_id) of all bins of the grid: rows of bins are dealt out before each is written out."""
    rows = grid.select("width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1)).alias("gy")).repartition("gy")
    rows = rows.withColumn("gx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") - 1)))
    return rows.select((F.col("gy") * F.col("width") + F.col("gx")).alias("bin_id"))


def with_bins(pts: DataFrame, grid: DataFrame, bin_size: float) -> DataFrame:
    """Points with gx, gy and bin_id, row by row of the grid; points without coordinates go."""
    rows = pts.filter(~F.isnan("x") & ~F.isnan("y")).crossJoin(F.broadcast(grid))  # one row
    rows = rows.withColumn("gx", raster_bin(F.col("x"), F.col("x_min"), bin_size, F.col("width"))).withColumn("gy", raster_bin(F.col("y"), F.col("y_min"), bin_size, F.col("height")))
    return rows.withColumn("bin_id", F.col("gy").cast("long") * F.col("width") + F.col("gx"))


def driver_genes(weights: DataFrame, threshold: float | None = 0.3) -> DataFrame:
    """Genes with more than the threshold's weight in some archetype; None: all."""
    return weights.filter(F.lit(True) if threshold is None else F.col("weight") > threshold).select("gene").distinct()


def pixel_gene_counts(pts: DataFrame, grid: DataFrame, bin_size: float, genes: DataFrame) -> DataFrame:
    """(gene, gx, gy, n) of the given genes; the grid spans all points."""
    return with_bins(pts.join(genes, "gene", "left_semi"), grid, bin_size).groupBy("gene", "gx", "gy").agg(F.count("*").alias("n"))


def kernel(sigma: float) -> list[tuple[int, float]]:
    reach = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    return [(i - reach, v / sum(w)) for i, v in enumerate(w)]


def blurred(counts: DataFrame, grid: DataFrame, sigma: float) -> DataFrame:
    """(gene, gx, gy, b): two one-dimensional passes; what falls off the grid is lost."""
    steps = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in kernel(sigma)))
    rows = counts.select("gene", "gx", "gy", F.col("n").cast("double").alias("b"))
    for axis, extent in (("gx", "width"), ("gy", "height")):
        other = "gy" if axis == "gx" else "gx"
        rows = rows.select("gene", "gx", "gy", "b", F.inline(steps)).select("gene", other, (F.col(axis) + F.col("o")).alias(axis), (F.col("b") * F.col("w")).alias("b"))
        rows = rows.crossJoin(F.broadcast(grid.select(extent))).filter((F.col(axis) >= 0) & (F.col(axis) < F.col(extent)))
        rows = rows.groupBy("gene", "gx", "gy").agg(F.sum("b").alias("b"))
    return rows


@dataclass(frozen=True)
class NicheMaps:
    """touched: (k, bin_id, value); background: (k, value, pixels), the value of the pixels that touched leaves out, and how many."""

    touched: DataFrame
    background: DataFrame
    grid: DataFrame


def niche_maps(pts: DataFrame, weights: DataFrame, bin_size: float = 8, smoothing_radius: float = 4, threshold: float | None = 0.3, only_drivers: bool = True, eps: float = 1e-9) -> NicheMaps:
    """A map per archetype: the sum over genes of weight times the gene's blurred count, z-scored over all pixels.

    With b a gene's blurred counts, the map is the sum of w b / s less the constant sum of w m / s, which is all
    there is where b is 0. Genes with s <= eps add nothing; weights up to the threshold count as 0.
    """
    grid = pinned(grid_meta(pts, bin_size))
    genes = driver_genes(weights, threshold) if only_drivers else weights.select("gene").distinct()
    b = blurred(pixel_gene_counts(pts, grid, bin_size, genes), grid, smoothing_radius / bin_size)
    pixels = grid.select((F.col("width").cast("long") * F.col("height")).alias("pixels"), "width")
    stats = b.groupBy("gene").agg(F.sum("b").alias("s1"), F.sum(F.col("b") * F.col("b")).alias("s2")).crossJoin(F.broadcast(pixels))
    mean = F.col("s1") / F.col("pixels")
    stats = stats.select("gene", mean.alias("mean"), F.sqrt(F.greatest(F.col("s2") / F.col("pixels") - mean * mean, F.lit(0.0))).alias("sd")).filter(F.col("sd") > eps)
    kept = weights if threshold is None else weights.filter(F.col("weight") > threshold)
    scale = kept.join(stats, "gene").select("gene", F.col("archetype").alias("k"), (F.col("weight") / F.col("sd")).alias("a"), (F.col("weight") * F.col("mean") / F.col("sd")).alias("c"))
    constant = weights.select(F.col("archetype").alias("k")).distinct().join(scale.groupBy("k").agg(F.sum("c").alias("c")), "k", "left").fillna(0.0, ["c"])
    sums = b.join(scale.select("gene", "k", "a"), "gene").groupBy("k", "gx", "gy").agg(F.sum(F.col("b") * F.col("a")).alias("v"))
    touched = sums.join(constant, "k").crossJoin(F.broadcast(pixels)).select("k", (F.col("gy").cast("long") * F.col("width") + F.col("gx")).alias("bin_id"), (F.col("v") - F.col("c")).alias("value"))
    rest = constant.join(touched.groupBy("k").agg(F.count("*").alias("m")), "k", "left").crossJoin(F.broadcast(pixels))
    return NicheMaps(touched, rest.select("k", (-F.col("c")).alias("value"), (F.col("pixels") - F.coalesce("m", F.lit(0))).alias("pixels")), grid)


def rounded(maps: NicheMaps, digits: int) -> NicheMaps:
    """Values rounded, so that equal ones tie whatever the order of summation."""
    r = F.round("value", digits) + F.lit(0.0)
    return NicheMaps(maps.touched.withColumn("value", r), maps.background.withColumn("value", r), maps.grid)


def weighted(maps: NicheMaps) -> DataFrame:
    """(k, value, freq): every pixel of every map, the background as one row."""
    return maps.touched.select("k", "value", F.lit(1).cast("long").alias("freq")).union(maps.background.filter("pixels > 0").select("k", "value", "pixels"))


def thresholds(maps: NicheMaps, threshold: str | float) -> DataFrame:
    """(k, t): "pQ" is the exact linear percentile of all pixels of a map, a number is itself."""
    rows = weighted(maps)
    if isinstance(threshold, str):
        return quantiles(rows, "k", {"t": float(threshold[1:]) / 100})
    return rows.select("k").distinct().withColumn("t", F.lit(float(threshold)))


def background_runs(maps: NicheMaps, which: DataFrame, strip: int = STRIP) -> DataFrame:
    """(k, first, last): runs of bin ids that touched leaves out, of the maps in `which` (k), cut at strips of bins.

    They are the gaps between touched bins, found by windows over strips of the grid, so no pixel is written out
    and no task has a whole map. A map without touched bins has a run per strip.
    """
    few = F.broadcast(which.select("k"))  # a row per map
    pixels = maps.grid.select((F.col("width").cast("long") * F.col("height")).alias("pixels"))
    strips = which.select("k").crossJoin(F.broadcast(pixels)).select("k", "pixels", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("pixels") - 1) / strip))).alias("strip"))
    starts = strips.select("k", "strip", (F.col("strip") * strip - 1).alias("bin_id"), F.least((F.col("strip") + 1) * strip, F.col("pixels")).alias("end"))
    there = maps.touched.join(few, "k", "left_semi").select("k", F.floor(F.col("bin_id") / strip).alias("strip"), "bin_id", F.lit(None).cast("long").alias("end"))
    w = Window.partitionBy("k", "strip").orderBy("bin_id")
    until = F.coalesce(F.lead("bin_id").over(w), F.max("end").over(Window.partitionBy("k", "strip")))
    return starts.union(there).select("k", (F.col("bin_id") + 1).alias("first"), (until - 1).alias("last")).filter("first <= last")


def written_out(runs: DataFrame) -> DataFrame:
    """(k, bin_id) of the bins in runs; a run is no longer than a strip."""
    return runs.repartition("k", "first").select("k", F.explode(F.sequence("first", "last")).alias("bin_id"))


def all_pixels(maps: NicheMaps, where: Column) -> DataFrame:
    """Background pixels (k, bin_id, value) of the maps whose background row satisfies `where`."""
    bg = maps.background.filter(where).select("k", "value")
    return written_out(background_runs(maps, bg)).join(F.broadcast(bg), "k")  # a row per map


@dataclass(frozen=True)
class Region:
    """Selected pixels of maps: bins (k, bin_id) are touched ones; background (k) are the maps whose other pixels are all selected."""

    bins: DataFrame
    background: DataFrame
    maps: NicheMaps

    def runs(self) -> DataFrame:
        return background_runs(self.maps, self.background)

    def sizes(self) -> DataFrame:
        """(k, bins) of every map with selected pixels, from the rows and the background's number of pixels."""
        rest = self.maps.background.join(F.broadcast(self.background), "k", "left_semi").select("k", F.col("pixels").alias("bins"))
        return self.bins.groupBy("k").agg(F.count("*").alias("bins")).union(rest).groupBy("k").agg(F.sum("bins").alias("bins"))

    def rows_of(self, by_bin: DataFrame) -> DataFrame:
        """Rows (bin_id, ...) of selected pixels, with their k: background maps take all rows but those of touched bins."""
        of = by_bin.join(self.bins.select("k", "bin_id"), "bin_id").select("k", *by_bin.columns)
        touched = self.maps.touched.join(F.broadcast(self.background), "k", "left_semi").select("k", "bin_id")
        rest = by_bin.crossJoin(F.broadcast(self.background.select("k"))).join(touched, ["k", "bin_id"], "left_anti")  # a row per map
        return of.unionByName(rest.select("k", *by_bin.columns))


def region(maps: NicheMaps, threshold: str | float = "p80", t: DataFrame | None = None) -> Region:
    """Pixels with value >= threshold; t: thresholds() of the maps, if they are there already."""
    t = thresholds(maps, threshold) if t is None else t
    bins = maps.touched.join(F.broadcast(t), "k").filter("value >= t").select("k", "bin_id")  # a row per map
    return Region(bins, maps.background.filter("pixels > 0").join(F.broadcast(t), "k").filter("value >= t").select("k"), maps)


def selected_bins(maps: NicheMaps, threshold: str | float = "p80") -> DataFrame:
    """(k, bin_id) with value >= threshold; background pixels are added where theirs is."""
    r = region(maps, threshold)
    return r.bins.union(written_out(r.runs()))


def symmetric_scale(maps: NicheMaps, q: float = 0.995) -> DataFrame:
    """(k, scale): the percentile of absolute values, else the largest, else 1."""
    a = weighted(maps).withColumn("a", F.abs("value"))
    s = quantiles(a.select("k", F.col("a").alias("value"), "freq"), "k", {"p": q, "m": 1.0})
    return s.select("k", F.when(F.col("p") > 0, F.col("p")).when(F.col("m") > 0, F.col("m")).otherwise(1.0).alias("scale"))


def percentile_categories(maps: NicheMaps, percentiles: list[float] = (90, 95, 98, 99)) -> DataFrame:
    """(k, bin_id, category) of touched pixels: how many of the percentiles the value reaches."""
    cuts = quantiles(weighted(maps), "k", {f"t{i}": p / 100 for i, p in enumerate(sorted(percentiles))})
    rows = maps.touched.join(F.broadcast(cuts), "k")
    return rows.select("k", "bin_id", sum((F.col("value") >= F.col(f"t{i}")).cast("int") for i in range(len(percentiles))).alias("category"))
