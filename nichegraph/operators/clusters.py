"""Point clusters of one gene: quality and frequency filters, binning, adaptive thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichegraph.functions.columns import GENE, decoded, floor_bin, gene_category, is_number
from nichegraph.sources.tables import points

#: By platform: columns of gene, x and y, whether there is a quality value, where the category comes from, and
#: the frequency filter's factor and minimum (None: no such filter). Fixed values.
MODES = {
    "xenium_5k": ("feature_name", "x_location", "y_location", True, "column", 500, 50),
    "xenium": ("feature_name", "x_location", "y_location", True, "name", 0.5, 25),
    "merfish": ("gene", "global_x", "global_y", False, "name", None, None),
    "cosmx": ("target", "x_global_px", "y_global_px", False, "name", 0.5, 25),
    "cosmx_prefiltered": ("target", "x_global_px", "y_global_px", False, None, None, None),
}
PIXEL_UM = 0.18


def quality_filtered(df: DataFrame, mode: str = "xenium_5k") -> DataFrame:
    """(gene, x, y, ...) of points that pass the mode's quality filter, with their other columns; ValueError for unknown modes."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    gene, x, y, has_qv, category, _, _ = MODES[mode]
    df = decoded(df)
    if has_qv:
        df = df.filter(is_number(F.col("qv")) & (F.col("qv") >= 20))
    if category == "column":
        df = df.filter(F.col("codeword_category") == GENE)
    elif category == "name":
        df = df.filter(gene_category(F.col(gene)) == GENE)
    out = points(df, gene, x, y, **{c: c for c in df.columns if c not in (gene, x, y, "gene", "x", "y")})
    if mode == "cosmx":
        out = out.withColumns({c: F.col(c) * F.lit(PIXEL_UM).cast("float") for c in "xy"})
    return out


def frequent_genes(pts: DataFrame, factor: float, least: int) -> DataFrame:
    """(gene, n) with least <= n < all points / factor; null genes count among all points and drop."""
    counts = pts.groupBy("gene").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).filter(F.col("gene").isNotNull() & (F.col("n") >= least) & (F.col("n") < F.col("total") / F.lit(float(factor)))).select("gene", "n")


def prepared(df: DataFrame, mode: str = "xenium_5k", factor: float | None = None, least: int | None = None, no_filter: bool = False) -> DataFrame:
    """Points after both filters; no_filter leaves out the frequency filter alone."""
    pts = quality_filtered(df, mode)
    factor, least = factor or MODES[mode][5], MODES[mode][6] if least is None else least
    if no_filter or factor is None:
        return pts
    return pts.join(frequent_genes(pts, factor, least).select("gene"), "gene", "left_semi")


def bin_counts(pts: DataFrame, bin_um: float = 8) -> DataFrame:
    """(bin_x, bin_y, n) over points of all genes."""
    return pts.groupBy(floor_bin(F.col("x"), bin_um).alias("bin_x"), floor_bin(F.col("y"), bin_um).alias("bin_y")).agg(F.count("*").alias("n"))


def metatranscripts(pts: DataFrame, bin_um: float = 8, min_points: int = 3, adaptive: bool = True, low_below: int = 50, low_min: int = 2, by: list[str] = ()) -> DataFrame:
    """(gene, bin_x, bin_y, n, x_centroid, y_centroid, meta_id): bins of a gene with enough points.

    A bin with fewer than low_below points of any gene needs low_min, others min_points. The count over all
    genes is a window over the grouped table, which needs no join. by: columns of slices, which come first in the result; each
    slice has clusters and ids of its own, all in one plan.
    """
    g = pts.filter(F.col("gene").isNotNull()).groupBy(*by, "gene", floor_bin(F.col("x"), bin_um).alias("bin_x"), floor_bin(F.col("y"), bin_um).alias("bin_y")).agg(
        F.count("*").cast("int").alias("n"), F.avg(F.col("x").cast("double")).cast("float").alias("x_centroid"), F.avg(F.col("y").cast("double")).cast("float").alias("y_centroid")
    )
    if adaptive:
        g = g.withColumn("every", F.sum("n").over(Window.partitionBy(*by, "bin_x", "bin_y")))
        g = g.filter(F.col("n") >= F.when(F.col("every") < low_below, low_min).otherwise(min_points)).drop("every")
    else:
        g = g.filter(F.col("n") >= min_points)
    return with_ids(g.persist(), by)  # read three times


def with_ids(clusters: DataFrame, by: list[str] = ()) -> DataFrame:
    """meta_id: the row's place by gene, bin_x and bin_y within its slice, from 0.

    Rows are numbered within a gene and bin_x; where those start comes from running sums over their counts
    within a gene and over the genes, so no task orders all rows.
    """
    before = lambda *c: Window.partitionBy(*c).rowsBetween(Window.unboundedPreceding, -1)
    named = lambda df, *c: df.withColumnsRenamed({x: f"of_{x}" for x in c})
    same = lambda *c: [F.col(x).eqNullSafe(F.col(f"of_{x}")) for x in c]
    sizes = clusters.groupBy(*by, "gene", "bin_x").agg(F.count("*").alias("m"))
    genes = sizes.groupBy(*by, "gene").agg(F.sum("m").alias("m"))
    genes = named(genes.select(*by, "gene", F.coalesce(F.sum("m").over(before(*by).orderBy("gene")), F.lit(0)).alias("gene_start")), *by, "gene")
    strips = sizes.select(*by, "gene", "bin_x", F.coalesce(F.sum("m").over(before(*by, "gene").orderBy("bin_x")), F.lit(0)).alias("strip_start"))
    strips = strips.join(genes, same(*by, "gene")).select(*by, "gene", "bin_x", (F.col("gene_start") + F.col("strip_start")).alias("start"))
    rank = F.row_number().over(Window.partitionBy(*by, "gene", "bin_x").orderBy("bin_y"))
    rows = clusters.withColumn("rank", rank).join(named(strips, *by, "gene", "bin_x"), same(*by, "gene", "bin_x"))
    return rows.select(*by, "gene", "bin_x", "bin_y", "n", "x_centroid", "y_centroid", (F.col("start") + F.col("rank") - 1).cast("long").alias("meta_id"))
