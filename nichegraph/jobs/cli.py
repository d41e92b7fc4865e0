"""The workflow as a command: points to clusters, graph, modules and maps, saved as a bundle of tables."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from nichegraph.functions.columns import coerce_threshold, parse_tokens, with_cell
from nichegraph.jobs.bundle import Bundle, files_key
from nichegraph.jobs.colocalization import gene_graph
from nichegraph.operators import clusters, colocation, niche, regions
from nichegraph.sources.tables import gene_set_lines, gmt_terms, read_points


def parse(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="nichegraph")
    p.add_argument("--transcripts-path", required=True)
    p.add_argument("--transcripts-format", default="parquet", choices=["parquet", "csv"])
    p.add_argument("--output-dir", required=True)
    p.add_argument("--mode", default="xenium_5k", choices=sorted(clusters.MODES))
    p.add_argument("--k", type=int, default=25)
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--min-points", type=int, default=3)
    p.add_argument("--bin-size", type=float, default=8.0)
    p.add_argument("--smoothing-radius", type=float, default=8.0)
    p.add_argument("--weight-threshold", type=float, default=0.3)
    p.add_argument("--factor", type=float)
    p.add_argument("--weights", help="a table (gene, archetype, weight) of modules found before")
    p.add_argument("--gene-sets", help="a folder of files of gene sets that modules are tested for")
    p.add_argument("--organism", default="Human", help="whose files of gene sets are taken")
    p.add_argument("--cell-col", help="assignment statistics of niches by this column of cells")
    p.add_argument("--threshold", default="p80")
    p.add_argument("--unassigned-token", action="append")
    p.add_argument("--restart", action="store_true", help="compute every step, whatever the output folder holds")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> dict[str, DataFrame]:
    """Runs the steps that the output folder doesn't hold yet, and returns every table of the run."""
    a = parse(argv)
    spark = SparkSession.builder.getOrCreate()
    bundle, out = Bundle(spark, a.output_dir, a.restart), {}

    def done(name: str, make: Callable[[], DataFrame], *after: str, **parameters) -> DataFrame:
        out[name] = bundle.step(name, make, after, **parameters)
        return out[name]

    pts = done("points", lambda: clusters.prepared(read_points(spark, a.transcripts_path, a.transcripts_format), a.mode, a.factor), source=files_key(spark, a.transcripts_path), format=a.transcripts_format, mode=a.mode, factor=a.factor)
    if a.weights:
        missing = {"gene", "archetype", "weight"} - set(spark.read.parquet(a.weights).columns)
        if missing:
            raise ValueError(f"the weights lack {sorted(missing)}")
        weights = done("weights", lambda: spark.read.parquet(a.weights), source=files_key(spark, a.weights))
    else:
        found = done("clusters", lambda: clusters.metatranscripts(pts, min_points=a.min_points), "points", min_points=a.min_points)
        pairs = done("pairs", lambda: colocation.pair_statistics(found).pairs, "clusters")
        terms = gmt_terms(gene_set_lines(spark, a.gene_sets, a.organism)) if a.gene_sets else None
        g = cache(lambda: gene_graph(pairs, a.k, a.weight_threshold, seed=a.seed, terms=terms))
        graph = {"k": a.k, "seed": a.seed}
        done("edges", lambda: g().edges, "pairs")
        weights = done("weights", lambda: g().w, "edges", **graph)
        done("modules", lambda: g().modules_w, "weights", threshold=a.weight_threshold)
        if terms is not None:
            done("enrichment", lambda: g().enrichment, "modules", gene_sets=files_key(spark, a.gene_sets), organism=a.organism)
    maps = cache(lambda: niche.niche_maps(pts, weights, a.bin_size, a.smoothing_radius, a.weight_threshold))
    drawn = {"bin_size": a.bin_size, "smoothing_radius": a.smoothing_radius, "threshold": a.weight_threshold}
    parts = {name: done(name, lambda of=of: getattr(maps(), of), "points", "weights", **drawn) for name, of in (("niche_values", "touched"), ("niche_background", "background"), ("grid", "grid"))}
    if a.cell_col:
        t, read = coerce_threshold(a.threshold), niche.NicheMaps(*parts.values())
        binned = lambda: niche.with_bins(with_cell(pts, a.cell_col, parse_tokens(a.unassigned_token)), read.grid, a.bin_size)
        done("assignment_stats", lambda: regions.assignment_stats(niche.region(read, t), niche.thresholds(read, t), binned()), *parts, "points", cells=a.cell_col, niches=t, tokens=a.unassigned_token)
    bundle.publish()
    return out | {"timings": spark.read.parquet(f"{bundle.folder}/timings")}


if __name__ == "__main__":
    main()
