"""Sources and sinks: points, gene sets, polygons, result bundles."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points derived from lineitem and part: gene, coordinates, quality, cell and slice. transcript_id isn't unique."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.substring("p_brand", 7, 9).cast("int").alias("bn"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_returnflag")
    j = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    x0, y0 = F.expr("(bn % 5) * 80 + ((l_partkey * 37) % 90)"), F.expr("((l_suppkey * 53) % 100) * 4")
    cell = F.concat(F.lit("c"), F.expr("((bn % 5) * 80 + ((l_partkey * 37) % 90)) div 20").cast("string"), F.lit("_"), F.expr("(((l_suppkey * 53) % 100) * 4) div 20").cast("string"))
    return j.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("transcript_id"), F.col("p_brand").alias("feature_name"), (x0 + F.col("l_linenumber") * 0.5).cast("float").alias("x_location"),
        (y0 + F.col("l_quantity") * 0.125).cast("float").alias("y_location"), F.col("l_quantity").cast("float").alias("qv"), F.when(F.col("p_size") == 50, "negative_control").otherwise("predesigned_gene").alias("codeword_category"),
        F.when(F.col("l_tax") == 0, "UNASSIGNED").otherwise(cell).alias("cell_id"), F.col("l_returnflag").alias("slice_id"),
    )


def points(df: DataFrame, gene: str = "feature_name", x: str = "x_location", y: str = "y_location", **more: str) -> DataFrame:
    """(gene, x, y) and more columns under the names that the operators use."""
    return df.select(F.col(gene).alias("gene"), F.col(x).cast("float").alias("x"), F.col(y).cast("float").alias("y"), *(F.col(c).alias(n) for n, c in more.items()))


def read_points(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.parquet(path) if format == "parquet" else spark.read.option("header", True).option("inferSchema", True).csv(path)


def gmt_terms(lines: DataFrame) -> DataFrame:
    """(term, description, genes) of gene-set lines in column value.

    Fields are split by tabs, or by white space where there is no tab; lines of fewer than three fields go;
    a description that is a link is blanked; genes are distinct, in order; of a repeated term the last in
    column line, if there is one, stays.
    """
    f = F.when(F.instr("value", "\t") > 0, F.split("value", "\t")).otherwise(F.split(F.trim("value"), r"\s+"))
    rows = lines.withColumn("f", F.transform(f, lambda x: F.trim(x))).filter(F.size("f") >= 3)
    rows = rows.withColumn("line", F.col("line") if "line" in lines.columns else F.monotonically_increasing_id())
    last = F.row_number().over(Window.partitionBy(F.col("f")[0]).orderBy(F.desc("line")))
    rows = rows.withColumn("last", last).filter("last = 1")
    description = F.when(F.col("f")[1].rlike("(?i)^https?://"), "").otherwise(F.col("f")[1])
    return rows.select(F.col("f")[0].alias("term"), description.alias("description"), F.array_distinct(F.filter(F.slice("f", 3, 1 << 30), lambda x: x != "")).alias("genes"))


def clean_lines(lines: DataFrame) -> DataFrame:
    """lines with column value as term, description and genes between tabs; blank ones go.

    Fields are split by tabs, or by white space where there are fewer than three. Of a line of two, the second
    has the genes and the description is empty.
    """
    tabs = F.split("value", "\t")
    f = F.transform(F.when(F.size(tabs) >= 3, tabs).otherwise(F.split(F.trim("value"), r"\s+")), lambda x: F.trim(x))
    genes = F.filter(F.when(F.size(f) >= 3, F.slice(f, 3, 1 << 30)).otherwise(F.slice(f, 2, 1)), lambda x: x != "")
    about = F.when(F.size(f) >= 3, f[1]).otherwise("")
    rows = lines.filter((F.trim("value") != "") & (F.size(f) >= 2))
    return rows.withColumn("value", F.array_join(F.concat(F.array(f[0], about), genes), "\t"))


def gene_set_lines(spark: SparkSession, folder: str, species: str = "") -> DataFrame:
    """(file, line, value) of the files of gene sets in a folder that are for the species, known by how their names begin.

    Human: c5 or h, mouse: m, in either case; any other species takes all. Without such a file there are no rows.
    """
    kinds = {"human": "^(c5|h)", "mouse": "^m"}
    pattern = next((p for s, p in kinds.items() if species.lower().startswith(s)), "")
    rows = spark.read.text(folder).select(F.lower("_metadata.file_name").alias("name"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    return rows.filter(F.col("name").rlike(pattern)).drop("name")


def save_clean_sets(spark: SparkSession, source: str, target: str) -> None:
    """Cleaned copies of a folder's files of gene sets, a folder for each; a target that exists is left as it is."""
    clean_lines(gene_set_lines(spark, source)).select("value", "file").write.partitionBy("file").mode("ignore").text(target)


def polygon_edges(spark: SparkSession, polygon, feature_index: int = 0, x_offset: float = 0.0, y_offset: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Edges (x1, y1, x2, y2) of a GeoJSON path or dictionary, or a list of points; rings, holes and parts alike.

    Raises ValueError on an empty collection, an index out of range, a missing geometry or another shape.
    """
    if isinstance(polygon, (str, Path)):
        polygon = json.loads(Path(polygon).read_text())
    if isinstance(polygon, dict):
        if polygon.get("type") == "FeatureCollection":
            if not polygon.get("features"):
                raise ValueError("the collection has no features")
            if not 0 <= feature_index < len(polygon["features"]):
                raise ValueError("feature_index is out of range")
            polygon = polygon["features"][feature_index]
        if polygon.get("type") == "Feature":
            polygon = polygon.get("geometry")
        if not polygon or polygon.get("type") not in ("Polygon", "MultiPolygon"):
            raise ValueError("there is no polygon geometry")
        rings = polygon["coordinates"] if polygon["type"] == "Polygon" else [r for p in polygon["coordinates"] for r in p]
    else:
        rings = [polygon]
    edges = []
    for r in rings:
        if len(r) < 3 or any(len(p) != 2 for p in r):
            raise ValueError("a ring needs three points of two coordinates")
        at = [((float(x) + x_offset) * scale, (float(y) + y_offset) * scale) for x, y in r]
        edges += [(*a, *b) for a, b in zip(at, at[1:] + at[:1]) if a != b]
    return spark.createDataFrame(edges, "x1 double, y1 double, x2 double, y2 double")


def save_bundle(folder: str, tables: dict[str, DataFrame]) -> None:
    """Result tables as Parquet, one folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_bundle(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
