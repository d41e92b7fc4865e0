"""Registered queries: each operator on points derived from the given tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nichegraph.functions.columns import cell_id, gene_category, with_cell
from nichegraph.operators import clusters, colocation, enrichment, graph, niche, overlap, regions
from nichegraph.sources.tables import clean_lines, gmt_terms, polygon_edges, table, transcripts_view

#: Parameters that suit the derived points: 25 genes, so a wider frequency bound than a panel of thousands needs.
FACTOR, LEAST, LOW_BELOW, RADIUS, BIN, SMOOTHING, N_MODULES = 23, 50, 12, 12, 8, 8, 5
POLYGON = {"type": "Polygon", "coordinates": [[[40, 40], [360, 60], [300, 300], [80, 260]], [[150, 100], [250, 100], [250, 200], [150, 200]]]}


def _prepared(s: SparkSession, d: str) -> DataFrame:
    return clusters.prepared(transcripts_view(s, d), "xenium_5k", FACTOR, LEAST)


def _meta(s: SparkSession, d: str) -> DataFrame:
    return clusters.metatranscripts(_prepared(s, d), BIN, low_below=LOW_BELOW)


def _all_points(s: SparkSession, d: str) -> DataFrame:
    return clusters.prepared(transcripts_view(s, d), "xenium_5k", no_filter=True)


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums depend on the order of their terms in the last places."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _weights(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "part").select(F.col("p_brand").alias("gene")).distinct().withColumn("n", F.substring("gene", 7, 9).cast("int"))
    g = g.withColumn("archetype", F.explode(F.sequence(F.lit(0), F.lit(N_MODULES - 1))))
    return g.select("gene", "archetype", F.when(F.expr("n % 5 = archetype"), 0.5).when(F.expr("(n + 1) % 5 = archetype"), 0.35).otherwise(0.05).alias("weight"))


def _module_genes(s: SparkSession, d: str) -> DataFrame:
    return _weights(s, d).filter("weight >= 0.3").select(F.col("archetype").alias("module"), "gene")


def _maps(s: SparkSession, d: str) -> niche.NicheMaps:
    maps = niche.rounded(niche.niche_maps(_all_points(s, d), _weights(s, d), BIN, SMOOTHING), 6)
    return niche.NicheMaps(maps.touched.persist(), maps.background.persist(), maps.grid)


def _binned(s: SparkSession, d: str) -> DataFrame:
    pts = _all_points(s, d)
    return niche.with_bins(pts.withColumn("cell", cell_id(pts, "cell_id")), niche.pinned(niche.grid_meta(pts, BIN)), BIN)


def _pairs(s: SparkSession, d: str, **k) -> colocation.NullModel:
    return colocation.pair_statistics(_meta(s, d), RADIUS, **k)


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.graph_edges(_pairs(s, d).pairs).persist()  # few rows, read several times


def _named(s: SparkSession, d: str) -> DataFrame:
    """Points with some gene names replaced by names of control probes."""
    t = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("p_size") == 49, "NegControlProbe1").when(F.col("p_size") == 48, "BLANK1").when(F.col("p_size") == 47, "Gene_1").when(F.col("p_size") == 46, "antisense1").otherwise(F.col("p_brand"))
    return t.select(name.alias("gene"))


def _platform(s: SparkSession, d: str, mode: str) -> DataFrame:
    """Points of another platform's columns, with some names of control probes, after both filters: their number and sums by gene."""
    t, (gene, x, y, *_) = transcripts_view(s, d), clusters.MODES[mode]
    name = F.when((F.col("transcript_id") % 97 == 0) & (F.lit(mode) != "cosmx_prefiltered"), "NegPrb7").otherwise(F.col("feature_name"))
    more = ["qv"] if mode == "xenium" else []
    raw = t.select((name.cast("binary") if mode == "xenium" else name).alias(gene), F.col("x_location").alias(x), F.col("y_location").alias(y), *more)
    pts = clusters.prepared(raw, mode, FACTOR if mode in ("xenium", "cosmx") else None, LEAST)
    return _r(pts.groupBy("gene").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("double")).alias("x"), F.max(F.col("y").cast("double")).alias("y")), 3)


def _gmt(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "part").select("p_brand").distinct().withColumn("n", F.substring("p_brand", 7, 9).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(9))))
    g = g.filter("(n * 7 + t * 3) % 4 = 0").groupBy("t").agg(F.array_sort(F.collect_list("p_brand")).alias("genes"))
    return g.select(F.col("t").cast("long").alias("line"), F.concat_ws("\t", F.concat(F.lit("term"), F.col("t").cast("string")), F.when(F.col("t") % 2 == 0, "http://x").otherwise("about"), F.array_join("genes", "\t")).alias("value"))


def _stats(s: SparkSession, d: str) -> DataFrame:
    maps = _maps(s, d)
    t = niche.pinned(niche.thresholds(maps, "p80"))  # a row per map
    return regions.assignment_stats(niche.region(maps, "p80", t), t, _binned(s, d))


def _knee(s: SparkSession, d: str) -> DataFrame:
    return regions.knee(table(s, d, "events").select("value"))


def _knee_record(s: SparkSession, d: str) -> DataFrame:
    r = regions.knee_record(table(s, d, "events").select("value"), second_fraction=0.8)
    kinds = ("first", "first_sharper", "second", "second_sharper")
    return _r(r.select("n", "start_index", "start_x", *(F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in kinds for c in r.schema[k].dataType.names)))


def _places(s: SparkSession, d: str) -> DataFrame:
    """Customers as points of clusters by nation."""
    c = table(s, d, "customer")
    return c.select(F.col("c_nationkey").alias("cluster"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("gene"), (F.col("c_acctbal") / 100).alias("x"), ((F.col("c_custkey") * 37) % 101).cast("double").alias("y"))


def _lists(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in columns})


def _enriched(s: SparkSession, d: str) -> DataFrame:
    w = _weights(s, d)
    return _lists(_r(enrichment.enrichment(graph.modules(w), gmt_terms(_gmt(s, d)), w.select("gene")), 9), "genes")


def _enriched_all(s: SparkSession, d: str) -> DataFrame:
    """Enrichment by the terms that hold Brand#11, of which some modules have none, and of a sixth module, which is empty."""
    w, terms = _weights(s, d), gmt_terms(_gmt(s, d)).filter("term = 'term1'")
    few = F.when(F.col("archetype") == 2, 0.0).otherwise(F.col("weight"))
    return _lists(_r(enrichment.enriched_modules(graph.all_modules(w.withColumn("weight", few), N_MODULES + 1), terms, w.select("gene")), 9), "genes").drop("genes").fillna("", ["term"]).fillna(0, ["overlap", "module_size", "term_size"]).fillna(-1.0, ["P", "Adjusted_P", "odds_ratio"])


def _raw_sets(s: SparkSession, d: str) -> DataFrame:
    """Lines of gene sets with white space for tabs, of two fields, and blank ones."""
    g = _gmt(s, d)
    spaced = F.when(F.col("line") % 3 == 0, F.concat(F.lit("  "), F.regexp_replace("value", "\t", " "))).when(F.col("line") == 4, "pair\tGeneA").when(F.col("line") == 5, "  ").otherwise(F.col("value"))
    return g.select(spaced.alias("value"))


def _cell_ids(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "lineitem").select(
        F.when(F.col("l_tax") == 0, -1).otherwise(F.col("l_suppkey")).cast("long").alias("whole"), F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_suppkey").cast("double")).alias("floating"),
        F.when(F.col("l_tax") == 0, F.lit(" unAssigned ")).otherwise(F.concat(F.lit("  c"), F.col("l_suppkey").cast("string"))).alias("text"),
    )
    return t.select(*(F.coalesce(cell_id(t, c), F.lit("none")).alias(c) for c in t.columns)).groupBy("whole", "floating", "text").agg(F.count("*").alias("n"))


def _fractional_cells(s: SparkSession, d: str) -> DataFrame:
    """A floating column of ids of which some have a fraction, so that all are written with one."""
    v = F.when(F.col("l_tax") == 0, -1.0).otherwise(F.col("l_suppkey") + F.when(F.col("l_linenumber") == 7, 0.5).otherwise(0.0))
    return with_cell(table(s, d, "lineitem").select(v.alias("v")), "v").groupBy(F.coalesce("cell", F.lit("none")).alias("cell")).agg(F.count("*").alias("n"))


QUERIES = {
    "transcripts_view": transcripts_view,
    "real_gene_filter": lambda s, d: _named(s, d).groupBy("gene", gene_category(F.col("gene")).alias("category")).agg(F.count("*").alias("n")),
    "cell_ids": _cell_ids,
    "cell_ids_fractional": _fractional_cells,
    "gene_frequency_filter": lambda s, d: clusters.frequent_genes(clusters.quality_filtered(transcripts_view(s, d)), FACTOR, LEAST),
    **{f"prepared_{m}": lambda s, d, m=m: _platform(s, d, m) for m in ("xenium", "merfish", "cosmx", "cosmx_prefiltered")},
    "global_bin_counts": lambda s, d: clusters.bin_counts(_prepared(s, d), BIN),
    "metatranscripts": _meta,
    "metatranscripts_by_slice": lambda s, d: _slice_meta(s, d),
    "metatranscripts_fixed_min": lambda s, d: clusters.metatranscripts(_prepared(s, d), BIN, adaptive=False),
    "meta_edges": lambda s, d: colocation.meta_edges(_meta(s, d), 10),
    "gene_freq": lambda s, d: _r(colocation.gene_frequency(_meta(s, d)), 9),
    "pair_stats": lambda s, d: _r(_pairs(s, d).pairs),
    "pair_stats_no_self": lambda s, d: _r(_pairs(s, d, drop_self=True).pairs),
    "null_globals": lambda s, d: _pairs(s, d).totals.crossJoin(_meta(s, d).agg(F.sum("n").alias("total_transcripts"))),
    "graph_edges": lambda s, d: _r(_edges(s, d)),
    "graph_edges_self_loops": lambda s, d: _r(graph.graph_edges(_pairs(s, d).pairs, "PMI", self_loops=True)),
    "pair_stats_directed": lambda s, d: _r(_pairs(s, d, undirected=False).pairs),
    "bin_gene_counts_all_bins": lambda s, d: regions.bin_gene_counts(_binned(s, d), niche.grid_meta(_all_points(s, d), BIN)),
    "niche_map_all_pixels": lambda s, d: _all_pixels(_maps(s, d)),
    "top_genes": lambda s, d: graph.top_genes(_weights(s, d), 3),
    "graph_vertices": lambda s, d: graph.vertices(_edges(s, d)),
    "stouffer": lambda s, d: _stouffer(s, d),
    "grid_meta": lambda s, d: niche.grid_meta(_all_points(s, d), BIN),
    "bin_gene_counts": lambda s, d: regions.bin_gene_counts(_binned(s, d)),
    "bin_gene_split": lambda s, d: regions.bin_gene_split(_binned(s, d)),
    "bin_counts": lambda s, d: regions.bin_counts(_binned(s, d)),
    "cells_by_bin": lambda s, d: _lists(regions.cells_by_bin(_binned(s, d)), "cells"),
    "driver_genes": lambda s, d: niche.driver_genes(_weights(s, d), 0.35),
    "pixel_gene_counts": lambda s, d: niche.pixel_gene_counts(_all_points(s, d), niche.grid_meta(_all_points(s, d), BIN), BIN, niche.driver_genes(_weights(s, d))),
    "blurred_maps": lambda s, d: _r(_blurred(s, d)),
    "niche_maps": lambda s, d: _maps(s, d).touched,
    "niche_bins_p98": lambda s, d: niche.selected_bins(_maps(s, d), "p98"),
    "niche_support": lambda s, d: regions.support(niche.selected_bins(_maps(s, d), "p80"), regions.bin_gene_counts(_binned(s, d)), ["Brand#11", "Brand#22", "Brand#33"]),
    "percentile_categories": lambda s, d: niche.percentile_categories(_maps(s, d)),
    "symmetric_scale": lambda s, d: _r(niche.symmetric_scale(_maps(s, d)), 5),
    "niche_assignment_stats": lambda s, d: _r(_stats(s, d), 5),
    "cells_in_selected_bins": lambda s, d: regions.cells_in(niche.selected_bins(_maps(s, d), "p98"), regions.cells_by_bin(_binned(s, d))),
    "gene_program_topk": lambda s, d: graph.gene_program(_weights(s, d), 0, 0.3, 5),
    "knee_threshold": lambda s, d: _r(_knee(s, d)),
    "knee_record": _knee_record,
    "label_places": lambda s, d: _r(graph.density_peaks(_places(s, d))),
    "bins_in_polygon": lambda s, d: regions.bins_in_polygon(regions.bin_counts(_binned(s, d)), polygon_edges(s, POLYGON), niche.grid_meta(_all_points(s, d), BIN), BIN),
    "module_density_threshold": lambda s, d: overlap.density(_all_points(s, d), _module_genes(s, d)).groupBy("module").agg(F.max("min_samples").alias("min_samples"), F.sum("m").alias("n_points"), F.sum(F.col("m") * (F.col("near") - 1)).alias("n_neighbours")),
    "cell_overlaps": lambda s, d: _r(_overlaps(s, d)),
    "gmt_terms": lambda s, d: _lists(gmt_terms(_gmt(s, d)), "genes"),
    "enrichment": _enriched,
    "enrichment_all_modules": _enriched_all,
    "clean_gene_sets": lambda s, d: clean_lines(_raw_sets(s, d)),
    "degree_centrality": lambda s, d: _r(graph.degree(_edges(s, d))),
    "adjacency_l2": lambda s, d: _r(graph.adjacency_l2(_edges(s, d))),
    "modules_from_w": lambda s, d: _lists(graph.modules(_weights(s, d)), "genes"),
    "membership": lambda s, d: _lists(graph.membership(_weights(s, d), _weights(s, d).filter("archetype < 2")), "cluster"),
    "umap_distance": lambda s, d: _r(graph.umap_distance(_edges(s, d))),
    "archetypes": lambda s, d: graph.archetypes(_edges(s, d), 4),
    "nmf": lambda s, d: graph.nmf(_edges(s, d), 4),
    "communities": lambda s, d: graph.communities(_edges(s, d)),
    "shortest_path_centrality": lambda s, d: _r(graph.shortest_path_centrality(_edges(s, d))),
    "eigenvector": lambda s, d: graph.eigenvector(_edges(s, d)),
}


def _slices(s: SparkSession, d: str) -> DataFrame:
    """Pair statistics of every slice, in one plan."""
    return colocation.pair_statistics(_slice_meta(s, d), RADIUS, by=["slice_id"]).pairs


def _slice_meta(s: SparkSession, d: str) -> DataFrame:
    return clusters.metatranscripts(_prepared(s, d), BIN, low_below=LOW_BELOW, by=["slice_id"])


def _stouffer(s: SparkSession, d: str) -> DataFrame:
    return _r(colocation.stouffer([_slices(s, d)]))


def _blurred(s: SparkSession, d: str) -> DataFrame:
    pts = _all_points(s, d)
    grid = niche.grid_meta(pts, BIN)
    return niche.blurred(niche.pixel_gene_counts(pts, grid, BIN, niche.driver_genes(_weights(s, d))), grid, SMOOTHING / BIN)


def _all_pixels(maps: niche.NicheMaps) -> DataFrame:
    """(k, bin_id, value) of every pixel."""
    return maps.touched.select("k", "bin_id", "value").union(niche.all_pixels(maps, F.col("pixels") > 0))


def _overlaps(s: SparkSession, d: str) -> DataFrame:
    pts = _all_points(s, d)
    return overlap.cell_overlaps(pts.withColumn("cell", cell_id(pts, "cell_id")), _module_genes(s, d), N_MODULES)


_T = """t AS (SELECT l_orderkey*8 + l_linenumber AS transcript_id, p_brand AS feature_name,
  CAST((bn%5)*80 + ((l_partkey*37)%90) + l_linenumber*0.5 AS FLOAT) AS x_location,
  CAST(((l_suppkey*53)%100)*4 + l_quantity*0.125 AS FLOAT) AS y_location, CAST(l_quantity AS FLOAT) AS qv,
  CASE WHEN p_size = 50 THEN 'negative_control' ELSE 'predesigned_gene' END AS codeword_category,
  CASE WHEN l_tax = 0 THEN 'UNASSIGNED' ELSE 'c' || CAST(((bn%5)*80 + ((l_partkey*37)%90))//20 AS VARCHAR) || '_' || CAST((((l_suppkey*53)%100)*4)//20 AS VARCHAR) END AS cell_id,
  l_returnflag AS slice_id FROM (SELECT *, CAST(substr(p_brand,7) AS INT) AS bn FROM lineitem JOIN part ON l_partkey = p_partkey))"""
_Q = _T + """, q AS (SELECT feature_name AS gene, x_location AS x, y_location AS y, nullif(cell_id, 'UNASSIGNED') AS cell, slice_id FROM t WHERE qv >= 20 AND codeword_category = 'predesigned_gene')"""
_P = _Q + f""", fq AS (SELECT gene, count(*) AS n FROM q GROUP BY gene HAVING count(*) >= {LEAST} AND count(*) < (SELECT count(*) FROM q) / {FACTOR}.0),
  p AS (SELECT * FROM q WHERE gene IN (SELECT gene FROM fq))"""


def _meta_sql(src: str, keep: str) -> str:
    return f"""(SELECT gene, bin_x, bin_y, n, x_centroid, y_centroid, CAST(row_number() OVER (ORDER BY gene, bin_x, bin_y) - 1 AS BIGINT) AS meta_id FROM
      (SELECT *, sum(n) OVER (PARTITION BY bin_x, bin_y) AS every FROM (SELECT gene, CAST(floor(CAST(x / CAST({BIN} AS FLOAT) AS FLOAT)) AS INT) AS bin_x, CAST(floor(CAST(y / CAST({BIN} AS FLOAT) AS FLOAT)) AS INT) AS bin_y,
        CAST(count(*) AS INT) AS n, CAST(avg(CAST(x AS DOUBLE)) AS FLOAT) AS x_centroid, CAST(avg(CAST(y AS DOUBLE)) AS FLOAT) AS y_centroid FROM {src} GROUP BY 1, 2, 3)) WHERE {keep})"""


_ADAPT = f"n >= CASE WHEN every < {LOW_BELOW} THEN 2 ELSE 3 END"
_M = _P + ", m AS " + _meta_sql("p", _ADAPT)


def _e(radius: float, m: str = "m", name: str = "e") -> str:
    return f""", {name} AS (SELECT a.meta_id AS edge_source, b.meta_id AS edge_target, CAST(a.n AS BIGINT) * b.n AS weight, a.gene AS gene_source, b.gene AS gene_target FROM {m} a JOIN {m} b ON a.meta_id < b.meta_id
      AND a.x_centroid BETWEEN b.x_centroid - {radius + 1} AND b.x_centroid + {radius + 1}
      AND (CAST(a.x_centroid AS DOUBLE) - b.x_centroid) * (CAST(a.x_centroid AS DOUBLE) - b.x_centroid) + (CAST(a.y_centroid AS DOUBLE) - b.y_centroid) * (CAST(a.y_centroid AS DOUBLE) - b.y_centroid) <= {radius * radius})"""


def _stats_sql(m: str = "m", e: str = "e", out: str = "s", where: str = "true") -> str:
    return f""", {out}f AS (SELECT gene, CAST(sum(n) AS BIGINT) AS total, sum(n) / ((SELECT sum(n) FROM {m}) + 1e-9) AS f FROM {m} GROUP BY gene),
      {out}o AS (SELECT least(gene_source, gene_target) AS g_a, greatest(gene_source, gene_target) AS g_b, CAST(sum(weight) AS DOUBLE) AS O, count(*) AS m FROM {e} WHERE {where} GROUP BY 1, 2),
      {out}z AS (SELECT g_a, g_b, O, a.f AS f_a, b.f AS f_b, a.f * b.f * (SELECT sum(O) FROM {out}o) AS E FROM {out}o JOIN {out}f a ON a.gene = g_a JOIN {out}f b ON b.gene = g_b),
      {out} AS (SELECT *, ln((O + 1e-9) / (E + 1e-9)) AS PMI, (O - E) / sqrt(E + 1e-9) AS Z FROM {out}z)"""


_S = _M + _e(RADIUS) + _stats_sql()
_KEEP = "(Z > 1.96 AND PMI > 0)"
_G = _S + f", ge AS (SELECT g_a AS a, g_b AS b, Z AS weight FROM s WHERE {_KEEP} AND g_a <> g_b), gb AS (SELECT a AS i, b AS j, weight FROM ge UNION ALL SELECT b, a, weight FROM ge)"
_W = f"w AS (SELECT gene, CAST(k AS INT) AS archetype, CAST(CASE WHEN n % 5 = k THEN 0.5 WHEN (n + 1) % 5 = k THEN 0.35 ELSE 0.05 END AS DOUBLE) AS weight FROM (SELECT DISTINCT p_brand AS gene, CAST(substr(p_brand, 7) AS INT) AS n FROM part), range({N_MODULES}) r(k))"
_GRID = f""", g AS (SELECT min(CAST(x AS DOUBLE)) AS x_min, min(CAST(y AS DOUBLE)) AS y_min, CAST(ceil((max(CAST(x AS DOUBLE)) - min(CAST(x AS DOUBLE))) / {BIN}) + 1 AS INT) AS width, CAST(ceil((max(CAST(y AS DOUBLE)) - min(CAST(y AS DOUBLE))) / {BIN}) + 1 AS INT) AS height FROM q),
  b AS (SELECT *, CAST(gy AS BIGINT) * width + gx AS bin_id FROM (SELECT q.*, g.*, least(greatest(CAST(floor((CAST(x AS DOUBLE) - x_min) / {BIN}) AS INT), 0), width - 1) AS gx, least(greatest(CAST(floor((CAST(y AS DOUBLE) - y_min) / {BIN}) AS INT), 0), height - 1) AS gy FROM q, g))"""
_B = _Q + _GRID
_C = _B + ", " + _W + """, c AS (SELECT gene, gx, gy, count(*) AS n FROM b WHERE gene IN (SELECT gene FROM w WHERE weight > 0.3) GROUP BY ALL),
  k0 AS (SELECT CAST(i AS INT) AS o, exp(-0.5 * i * i / 1.0) AS v FROM range(-4, 5) r(i)), kk AS (SELECT o, v / (SELECT sum(v) FROM k0) AS v FROM k0),
  b1 AS (SELECT gene, gx + o AS gx, gy, sum(n * v) AS b FROM c, kk, g WHERE gx + o >= 0 AND gx + o < width GROUP BY ALL),
  b2 AS (SELECT gene, gx, gy + o AS gy, sum(b * v) AS b FROM b1, kk, g WHERE gy + o >= 0 AND gy + o < height GROUP BY ALL)"""
_C = _C.replace("GROUP BY ALL),\n  b2", "GROUP BY gene, gx + o, gy),\n  b2").replace("gy + o < height GROUP BY ALL", "gy + o < height GROUP BY gene, gx, gy + o")
_N = _C + """, px AS (SELECT CAST(width AS BIGINT) * height AS pixels, width FROM g),
  st AS (SELECT gene, sum(b) / any_value(pixels) AS mean, sqrt(greatest(sum(b * b) / any_value(pixels) - (sum(b) / any_value(pixels)) * (sum(b) / any_value(pixels)), 0)) AS sd FROM b2, px GROUP BY gene),
  sc AS (SELECT w.gene, archetype AS k, weight / sd AS a, weight * mean / sd AS c FROM w JOIN st USING (gene) WHERE weight > 0.3 AND sd > 1e-9), co AS (SELECT k, sum(c) AS c FROM sc GROUP BY k),
  tv AS (SELECT k, gx, gy, sum(b * a) AS v FROM b2 JOIN sc USING (gene) GROUP BY k, gx, gy),
  tm AS (SELECT tv.k, CAST(gy AS BIGINT) * width + gx AS bin_id, round(v - c, 6) + 0.0 AS value FROM tv JOIN co ON co.k = tv.k, px),
  fm AS (SELECT co.k, r.i AS bin_id, coalesce(tm.value, round(-c, 6) + 0.0) AS value FROM co CROSS JOIN (SELECT unnest(range(pixels)) AS i FROM px) r LEFT JOIN tm ON tm.k = co.k AND tm.bin_id = r.i)"""


def _sel(p: int, name: str = "sel") -> str:
    return f""", {name}t AS (SELECT k, quantile_cont(value, {p / 100}) AS t FROM fm GROUP BY k), {name} AS (SELECT fm.k, bin_id FROM fm JOIN {name}t USING (k) WHERE value >= t)"""


_CELLS = ", cb AS (SELECT DISTINCT bin_id, cell FROM b WHERE cell IS NOT NULL)"
_SLICES = _P + "".join(f", m{x} AS {_meta_sql(f'(SELECT * FROM p WHERE slice_id = {chr(39)}{x}{chr(39)})', _ADAPT)}{_e(RADIUS, f'm{x}', f'e{x}')}{_stats_sql(f'm{x}', f'e{x}', f's{x}')}" for x in "ANR")
_MG = ", mg AS (SELECT archetype AS module, gene FROM w WHERE weight >= 0.3), mp AS (SELECT module, x, y, count(*) AS m FROM q JOIN mg USING (gene) GROUP BY module, x, y)"
_NEAR = """, nb AS (SELECT a.module, a.x, a.y, a.m, sum(b.m) AS near FROM mp a JOIN mp b ON a.module = b.module AND b.x BETWEEN a.x - 10 AND a.x + 10 AND b.y BETWEEN a.y - 10 AND a.y + 10
   AND (CAST(a.x AS DOUBLE) - b.x) * (CAST(a.x AS DOUBLE) - b.x) + (CAST(a.y AS DOUBLE) - b.y) * (CAST(a.y AS DOUBLE) - b.y) <= 100 GROUP BY a.module, a.x, a.y, a.m),
  mt AS (SELECT module, CAST(greatest(floor(quantile_cont(near - 1, 0.8)), 50) AS BIGINT) AS min_samples FROM nb, range(m) GROUP BY module)"""
_GMT = """, gs AS (SELECT 'term' || t AS term, CASE WHEN t % 2 = 0 THEN '' ELSE 'about' END AS description, gene FROM (SELECT DISTINCT p_brand AS gene, CAST(substr(p_brand, 7) AS INT) AS n FROM part), range(10) r(t) WHERE (n * 7 + t * 3) % 4 = 0)"""
_KNEE = """WITH RECURSIVE x AS MATERIALIZED (SELECT CAST(value AS DOUBLE) AS v, row_number() OVER (ORDER BY value) - 1 AS i FROM events WHERE value IS NOT NULL AND isfinite(value)),
 n AS (SELECT count(*) AS n FROM x), d0 AS (SELECT i, v, CASE WHEN lag(v) OVER o IS NULL THEN lead(v) OVER o - v WHEN lead(v) OVER o IS NULL THEN v - lag(v) OVER o ELSE (lead(v) OVER o - lag(v) OVER o) / 2 END AS d FROM x WINDOW o AS (ORDER BY i)),
 d1 AS (SELECT i, v, sum(d) OVER (ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11 AS d FROM d0), up AS (SELECT i, d > (SELECT quantile_cont(d, 0.2) FROM d1 WHERE d > 0) AS u FROM d1),
 rn AS (SELECT i, u, sum(CAST(NOT u AS INT)) OVER (ORDER BY i) AS r FROM up), st AS (SELECT coalesce(min(f), 0) AS s FROM (SELECT min(i) AS f FROM rn WHERE u GROUP BY r HAVING count(*) >= 25)),
"""


def _knees_sql(second_fraction: float = 0.95) -> str:
    """Places f (knee, i) of the four knees."""

    def seg(name: str, start: str, fraction: float) -> str:
        return f""" {name}a AS (SELECT i - {start} AS j, v, min(v) OVER () AS lo, max(v) OVER () AS hi, count(*) OVER () AS m FROM x WHERE i >= {start}),
          {name}b AS (SELECT j, v, m, abs((v - lo) / (hi - lo + 1e-12) - j / (m - 1) * ((hi - lo) / (hi - lo + 1e-12))) / sqrt(1 + ((hi - lo) / (hi - lo + 1e-12)) * ((hi - lo) / (hi - lo + 1e-12))) AS d FROM {name}a),
          {name}p AS (SELECT j AS pj, d AS pd, m FROM {name}b ORDER BY d DESC, j LIMIT 1), {name}c AS (SELECT pj, m, coalesce((SELECT min(j) FROM {name}b WHERE j >= pj AND d <= {fraction} * pd), m - 1) AS c FROM {name}p),
          {name}s AS (SELECT pj, CASE WHEN c <= pj AND pj < m - 1 THEN pj + 1 ELSE c END AS sj FROM {name}c)"""

    return _KNEE + seg("ka", "(SELECT s FROM st)", 0.95) + "," + seg("kb", "((SELECT s FROM st) + (SELECT pj FROM kas))", second_fraction) + """,
      f AS (SELECT 'first' AS knee, (SELECT s FROM st) + pj AS i FROM kas UNION ALL SELECT 'first_sharper', (SELECT s FROM st) + sj FROM kas UNION ALL SELECT 'second', (SELECT s FROM st) + (SELECT pj FROM kas) + pj FROM kbs UNION ALL SELECT 'second_sharper', (SELECT s FROM st) + (SELECT pj FROM kas) + sj FROM kbs)"""


def _knee_sql() -> str:
    return _knees_sql() + """
      SELECT knee, round(t, 6) AS threshold, round((SELECT count(*) FROM x WHERE v > t) / (SELECT n FROM n), 6) AS occupancy FROM (SELECT knee, v AS t FROM f JOIN x USING (i))"""


def _knee_record_sql() -> str:
    of = {"index_fit": "i - s", "index_all": "ia", "x": "round(ia / (n - 1), 6) + 0.0", "threshold": "round(t, 6) + 0.0", "occupancy": "round(o, 6) + 0.0", "percentile": "round(100 * (1 - o), 6) + 0.0"}
    kinds = ("first", "first_sharper", "second", "second_sharper")
    return _knees_sql(0.8) + f""", ft AS (SELECT knee, i, v AS t, (SELECT min(i) FROM x y WHERE y.v = x.v) AS ia, (SELECT count(*) FROM x y WHERE y.v > x.v) / (SELECT n FROM n) AS o FROM f JOIN x USING (i))
      SELECT any_value(n) AS n, any_value(s) AS start_index, round(any_value(s) / (any_value(n) - 1), 6) + 0.0 AS start_x, {', '.join(f"max({e}) FILTER (knee = '{k}') AS {k}_{c}" for k in kinds for c, e in of.items())} FROM ft, n, st"""


def _poly_sql() -> str:
    e = [(a, b) for r in POLYGON["coordinates"] for a, b in zip(r, r[1:] + r[:1])]
    rows = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in e)
    return _B + f""", pe(x1, y1, x2, y2) AS (VALUES {rows}), pt AS (SELECT DISTINCT bin_id, x_min + (bin_id % width + 0.5) * {BIN} AS px, y_min + (bin_id // width + 0.5) * {BIN} AS py FROM b),
      cr AS (SELECT bin_id, (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) AS turn, (y1 > py) <> (y2 > py) AS spans, y2 > y1 AS rises, px BETWEEN least(x1, x2) AND greatest(x1, x2) AND py BETWEEN least(y1, y2) AND greatest(y1, y2) AS box FROM pt, pe)
      SELECT bin_id FROM cr GROUP BY bin_id HAVING sum(CASE WHEN spans AND ((rises AND turn > 0) OR (NOT rises AND turn < 0)) THEN 1 ELSE 0 END) % 2 = 1 AND NOT bool_or(turn = 0 AND box)"""


def _enrich_sql() -> str:
    return "WITH " + _W + _GMT + """, bgn AS (SELECT count(DISTINCT gene) AS size FROM w), md AS (SELECT archetype AS module, gene FROM w WHERE weight >= 0.3),
      h AS (SELECT module, term, count(*) AS overlap, string_agg(gene, ',' ORDER BY gene) AS genes FROM md JOIN gs USING (gene) GROUP BY 1, 2),
      z AS (SELECT h.*, (SELECT count(*) FROM md WHERE md.module = h.module) AS a, (SELECT count(*) FROM gs WHERE gs.term = h.term) AS b, size AS n FROM h, bgn),
      lf AS (SELECT i, coalesce(sum(ln(greatest(i, 1))) OVER (ORDER BY i), 0) AS l FROM range(0, 1000) r(i)),
      pr AS (SELECT z.*, (SELECT sum(exp(bx.l - kx.l - bk.l + nb.l - ak.l - nr.l - nn.l + aa.l + na.l)) FROM range(greatest(overlap, a + b - n), least(a, b) + 1) r(x)
         JOIN lf bx ON bx.i = b JOIN lf kx ON kx.i = x JOIN lf bk ON bk.i = b - x JOIN lf nb ON nb.i = n - b JOIN lf ak ON ak.i = a - x JOIN lf nr ON nr.i = n - b - a + x JOIN lf nn ON nn.i = n JOIN lf aa ON aa.i = a JOIN lf na ON na.i = n - a) AS P FROM z),
      rk AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY P, term) AS rank, count(*) OVER (PARTITION BY module) AS c FROM pr)
      SELECT module, term, overlap, a AS module_size, b AS term_size, round(least(P, 1.0), 9) AS P, round(least(1.0, min(P * c / rank) OVER (PARTITION BY module ORDER BY rank DESC)), 9) AS Adjusted_P,
        round(((overlap + 0.5::DOUBLE) * (n - a - b + overlap + 0.5::DOUBLE)) / ((a - overlap + 0.5::DOUBLE) * (b - overlap + 0.5::DOUBLE)), 9) AS odds_ratio, genes FROM rk WHERE rank <= 200"""


def _enrich_all_sql() -> str:
    tested = _enrich_sql().replace("weight >= 0.3)", "weight >= 0.3 AND archetype <> 2)").replace("JOIN gs USING (gene)", "JOIN (SELECT * FROM gs WHERE term = 'term1') gs USING (gene)")
    return f"SELECT CAST(r.m AS INT) AS module, coalesce(term, '') AS term, coalesce(overlap, 0) AS overlap, coalesce(module_size, 0) AS module_size, coalesce(term_size, 0) AS term_size, coalesce(P, -1) AS P, coalesce(Adjusted_P, -1) AS Adjusted_P, coalesce(odds_ratio, -1) AS odds_ratio FROM range(0, {N_MODULES + 1}) r(m) LEFT JOIN ({tested}) e ON e.module = r.m"


def _rs(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


def _platform_sql(mode: str) -> str:
    name = "feature_name" if mode == "cosmx_prefiltered" else "CASE WHEN transcript_id % 97 = 0 THEN 'NegPrb7' ELSE feature_name END"
    xy = ", ".join(f"CAST({c}_location * CAST(0.18 AS FLOAT) AS FLOAT) AS {c}" if mode == "cosmx" else f"{c}_location AS {c}" for c in "xy")
    kept = {"xenium": "qv >= 20 AND gene <> 'NegPrb7'", "cosmx_prefiltered": "true"}.get(mode, "gene <> 'NegPrb7'")
    often = f"WHERE gene IN (SELECT gene FROM f GROUP BY gene HAVING count(*) >= {LEAST} AND count(*) < (SELECT count(*) FROM f) / {FACTOR}.0)" if mode in ("xenium", "cosmx") else ""
    return f"WITH {_T}, f AS (SELECT * FROM (SELECT {name} AS gene, {xy}, qv FROM t) WHERE {kept}) SELECT gene, count(*) AS n, round(sum(CAST(x AS DOUBLE)), 3) + 0.0 AS x, round(max(CAST(y AS DOUBLE)), 3) + 0.0 AS y FROM f {often} GROUP BY gene"


_PAIR = f"SELECT g_a, g_b, {_rs('O', 'f_a', 'f_b', 'E', 'PMI', 'Z')}, {_KEEP} AS keep FROM s"
ORACLE_SQL = {
    "transcripts_view": f"WITH {_T} SELECT * FROM t",
    "real_gene_filter": """SELECT gene, CASE WHEN regexp_matches(gene, 'BLANK|NegControl|antisense|Blank|SystemControl|Negative|NegPrb|_') THEN 'something_else' ELSE 'predesigned_gene' END AS category, count(*) AS n FROM
      (SELECT CASE p_size WHEN 49 THEN 'NegControlProbe1' WHEN 48 THEN 'BLANK1' WHEN 47 THEN 'Gene_1' WHEN 46 THEN 'antisense1' ELSE p_brand END AS gene FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2""",
    "cell_ids": "SELECT CASE WHEN l_tax = 0 THEN 'none' ELSE CAST(l_suppkey AS VARCHAR) END AS whole, CASE WHEN l_tax = 0 THEN 'none' ELSE CAST(l_suppkey AS VARCHAR) END AS floating, CASE WHEN l_tax = 0 THEN 'none' ELSE 'c' || l_suppkey END AS text, count(*) AS n FROM lineitem GROUP BY 1, 2, 3",
    "cell_ids_fractional": "SELECT CASE WHEN l_tax = 0 THEN 'none' ELSE CAST(l_suppkey + CASE WHEN l_linenumber = 7 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS VARCHAR) END AS cell, count(*) AS n FROM lineitem GROUP BY 1",
    "gene_frequency_filter": f"WITH {_P} SELECT gene, n FROM fq",
    **{f"prepared_{m}": _platform_sql(m) for m in ("xenium", "merfish", "cosmx", "cosmx_prefiltered")},
    "global_bin_counts": f"WITH {_P} SELECT CAST(floor(x / {BIN}) AS INT) AS bin_x, CAST(floor(y / {BIN}) AS INT) AS bin_y, count(*) AS n FROM p GROUP BY 1, 2",
    "metatranscripts": f"WITH {_M} SELECT * FROM m",
    "metatranscripts_by_slice": f"WITH {_SLICES} {' UNION ALL '.join(f"SELECT '{x}' AS slice_id, * FROM m{x}" for x in 'ANR')}",
    "metatranscripts_fixed_min": f"WITH {_P}, m AS {_meta_sql('p', 'n >= 3')} SELECT * FROM m",
    "meta_edges": f"WITH {_M}{_e(10)} SELECT * FROM e",
    "gene_freq": f"WITH {_S} SELECT gene, total, {_rs('f', digits=9)} FROM sf",
    "pair_stats": f"WITH {_S} {_PAIR}",
    "pair_stats_no_self": f"WITH {_M}{_e(RADIUS)}{_stats_sql(where='gene_source <> gene_target')} {_PAIR}",
    "null_globals": f"WITH {_S} SELECT CAST(sum(O) AS BIGINT) AS S, CAST(sum(m) AS BIGINT) AS n_edges, count(*) AS n_pairs, (SELECT CAST(sum(n) AS BIGINT) FROM m) AS total_transcripts FROM so",
    "graph_edges": f"WITH {_G} SELECT a, b, {_rs('weight')} FROM ge",
    "graph_edges_self_loops": f"WITH {_S} SELECT g_a AS a, g_b AS b, {_rs('PMI')[:-3]}weight FROM s WHERE {_KEEP}",
    "pair_stats_directed": f"WITH {_M}{_e(RADIUS)}{_stats_sql().replace('least(gene_source, gene_target)', 'gene_source').replace('greatest(gene_source, gene_target)', 'gene_target')} {_PAIR}",
    "bin_gene_counts_all_bins": f"WITH {_B}, n AS (SELECT bin_id, gene, count(*) AS n FROM b GROUP BY 1, 2), every AS (SELECT unnest(range(CAST(width AS BIGINT) * height)) AS bin_id FROM g) SELECT bin_id, gene, coalesce(n, 0) AS n FROM every LEFT JOIN n USING (bin_id)",
    "niche_map_all_pixels": f"WITH {_N} SELECT k, bin_id, value FROM fm",
    "top_genes": f"WITH {_W} SELECT *, CAST(row_number() OVER (PARTITION BY archetype ORDER BY weight DESC, gene) AS INT) AS rank FROM w QUALIFY rank <= 3",
    "graph_vertices": f"WITH {_G} SELECT DISTINCT i AS gene FROM gb",
    "stouffer": f"WITH {_SLICES}, u AS ({' UNION ALL '.join(f'SELECT g_a, g_b, Z FROM s{x}' for x in 'ANR')}) SELECT g_a, g_b, round(sum(Z) / sqrt(count(*)), 6) + 0.0 AS Z, count(*) AS n_slices, count(*) >= 2 AND sum(Z) / sqrt(count(*)) > 1.96 AS keep FROM u GROUP BY 1, 2",
    "grid_meta": f"WITH {_B} SELECT * FROM g",
    "bin_gene_counts": f"WITH {_B} SELECT bin_id, gene, count(*) AS n FROM b GROUP BY 1, 2",
    "bin_gene_split": f"WITH {_B} SELECT bin_id, gene, count(cell) AS assigned, count(*) - count(cell) AS unassigned FROM b GROUP BY 1, 2",
    "bin_counts": f"WITH {_B} SELECT bin_id, count(*) AS n_total, count(*) - count(cell) AS n_unassigned FROM b GROUP BY 1",
    "cells_by_bin": f"WITH {_B}{_CELLS} SELECT bin_id, string_agg(cell, ',' ORDER BY cell) AS cells FROM cb GROUP BY 1",
    "driver_genes": f"WITH {_W} SELECT DISTINCT gene FROM w WHERE weight > 0.35",
    "pixel_gene_counts": f"WITH {_C} SELECT * FROM c",
    "blurred_maps": f"WITH {_C} SELECT gene, gx, gy, {_rs('b')} FROM b2",
    "niche_maps": f"WITH {_N} SELECT k, bin_id, value FROM tm",
    "niche_bins_p98": f"WITH {_N}{_sel(98)} SELECT k, bin_id FROM sel",
    "niche_support": f"""WITH {_N}{_sel(80)}, su AS (SELECT bin_id, count(DISTINCT gene) AS t, count(*) AS n FROM b WHERE gene IN ('Brand#11', 'Brand#22', 'Brand#33') GROUP BY 1)
      SELECT k, sel.bin_id, coalesce(t, 0) AS n_gene_types, coalesce(n, 0) AS n_gene_transcripts, coalesce(t, 0) >= 2 AND coalesce(n, 0) >= 5 AS passes_support FROM sel LEFT JOIN su ON su.bin_id = sel.bin_id""",
    "percentile_categories": f"""WITH {_N}, ct AS (SELECT k, quantile_cont(value, 0.9) AS a, quantile_cont(value, 0.95) AS b, quantile_cont(value, 0.98) AS c, quantile_cont(value, 0.99) AS d FROM fm GROUP BY k)
      SELECT tm.k, bin_id, CAST(value >= a AS INT) + CAST(value >= b AS INT) + CAST(value >= c AS INT) + CAST(value >= d AS INT) AS category FROM tm JOIN ct ON ct.k = tm.k""",
    "symmetric_scale": f"WITH {_N} SELECT k, round(CASE WHEN quantile_cont(abs(value), 0.995) > 0 THEN quantile_cont(abs(value), 0.995) WHEN max(abs(value)) > 0 THEN max(abs(value)) ELSE 1.0 END, 5) AS scale FROM fm GROUP BY k",
    "niche_assignment_stats": f"""WITH {_N}{_sel(80)}{_CELLS}, bp AS (SELECT bin_id, count(cell) AS a, count(*) - count(cell) AS u FROM b GROUP BY 1),
      sm AS (SELECT k, count(*) AS bins, CAST(coalesce(sum(a), 0) AS BIGINT) AS a, CAST(coalesce(sum(u), 0) AS BIGINT) AS u FROM sel LEFT JOIN bp USING (bin_id) GROUP BY k), ce AS (SELECT k, count(DISTINCT cell) AS n FROM sel JOIN cb USING (bin_id) GROUP BY k)
      SELECT k AS niche_k, round(t, 5) + 0.0 AS threshold_value, bins AS n_selected_bins, coalesce(n, 0) AS n_cells_subset, a AS assigned_transcripts, u AS unassigned_transcripts, a + u AS total_transcripts, round(a / nullif(a + u, 0), 5) AS prop_assigned, round(u / nullif(a + u, 0), 5) AS prop_unassigned
      FROM selt JOIN sm USING (k) LEFT JOIN ce USING (k)""",
    "cells_in_selected_bins": f"WITH {_N}{_sel(98)}{_CELLS} SELECT DISTINCT k, cell FROM sel JOIN cb USING (bin_id)",
    "gene_program_topk": f"WITH {_W} SELECT gene, weight FROM w WHERE archetype = 0 AND weight >= 0.3 ORDER BY weight DESC, gene LIMIT 5",
    "knee_threshold": _knee_sql(),
    "knee_record": _knee_record_sql(),
    "label_places": """WITH p AS (SELECT c_nationkey AS cluster, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS gene, c_acctbal / 100 AS x, CAST((c_custkey * 37) % 101 AS DOUBLE) AS y FROM customer),
      c AS (SELECT cluster, count(*) AS n, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy, pow(count(*), 1.0 / 3) AS s FROM p GROUP BY cluster HAVING count(*) > 3),
      d AS (SELECT a.cluster, a.gene, a.x, a.y, n, sum(exp(-0.5 * s * (yy * (a.x - b.x) * (a.x - b.x) - 2 * xy * (a.x - b.x) * (a.y - b.y) + xx * (a.y - b.y) * (a.y - b.y)) / (xx * yy - xy * xy))) AS density FROM p a JOIN c ON c.cluster = a.cluster JOIN p b ON b.cluster = a.cluster GROUP BY 1, 2, 3, 4, 5)
      SELECT cluster, gene, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, n FROM d QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(density, 9) DESC, gene) = 1""",
    "shortest_path_centrality": "WITH RECURSIVE " + _G + """, ln AS (SELECT i, j, 1 / weight AS len FROM gb WHERE weight > 0), vs AS (SELECT DISTINCT i AS g FROM gb),
      sp(r, s, v, d) AS (SELECT 0, g, g, CAST(0 AS DOUBLE) FROM vs UNION ALL SELECT r + 1, s, j, min(d + len) FROM sp JOIN (SELECT * FROM ln UNION ALL SELECT g, g, 0 FROM vs) ON v = i WHERE r < 24 GROUP BY r, s, j),
      ds AS (SELECT s, v, d FROM sp WHERE r = 24), st AS (SELECT a.s, a.v, b.v AS w FROM ds a JOIN ln ON a.v = i JOIN ds b ON b.s = a.s AND b.v = j WHERE abs(a.d + len - b.d) <= 1e-12 AND b.d > a.d),
      np(h, s, v, n) AS (SELECT 0, g, g, CAST(1 AS DOUBLE) FROM vs UNION ALL SELECT h + 1, np.s, w, sum(n) FROM np JOIN st ON st.s = np.s AND st.v = np.v GROUP BY h, np.s, w),
      ws AS (SELECT s, v, sum(n) AS n FROM np GROUP BY 1, 2), sd AS (SELECT ds.s, ds.v, d, n FROM ds JOIN ws ON ws.s = ds.s AND ws.v = ds.v),
      bt AS (SELECT a.v AS gene, sum(a.n * b.n / c.n) / 2 AS b FROM sd a JOIN sd b ON b.s = a.v JOIN sd c ON c.s = a.s AND c.v = b.v WHERE a.s <> a.v AND b.v <> a.v AND a.s <> b.v AND abs(a.d + b.d - c.d) <= 1e-11 GROUP BY 1),
      cl AS (SELECT s AS gene, count(*) / sum(d) AS c FROM ds WHERE s <> v GROUP BY 1)
      SELECT g AS gene, round(coalesce(b, 0), 6) + 0.0 AS betweenness, round(coalesce(c, 0), 6) + 0.0 AS closeness FROM vs LEFT JOIN bt ON bt.gene = g LEFT JOIN cl ON cl.gene = g""",
    "bins_in_polygon": f"WITH {_poly_sql()}",
    "module_density_threshold": f"WITH {_Q}, {_W}{_MG}{_NEAR} SELECT module, min_samples, CAST(sum(m) AS BIGINT) AS n_points, CAST(sum(m * (near - 1)) AS BIGINT) AS n_neighbours FROM nb JOIN mt USING (module) GROUP BY 1, 2",
    "cell_overlaps": f"""WITH {_Q}, {_W}{_MG}{_NEAR}, co AS (SELECT nb.module, x, y FROM nb JOIN mt USING (module) WHERE near >= min_samples),
      cl AS (SELECT DISTINCT mp.module, mp.x, mp.y FROM mp JOIN co ON co.module = mp.module AND (CAST(mp.x AS DOUBLE) - co.x) * (CAST(mp.x AS DOUBLE) - co.x) + (CAST(mp.y AS DOUBLE) - co.y) * (CAST(mp.y AS DOUBLE) - co.y) <= 100),
      la AS (SELECT gene, x, y, max(cl.module) AS module FROM cl JOIN mg ON mg.module = cl.module GROUP BY 1, 2, 3)
      SELECT cell, {', '.join(f'round(count(*) FILTER (la.module = {k}) / count(*), 6) AS module_{k}' for k in range(N_MODULES))} FROM q LEFT JOIN la ON la.gene = q.gene AND la.x = q.x AND la.y = q.y WHERE cell IS NOT NULL GROUP BY cell""",
    "gmt_terms": f"WITH {_W}{_GMT} SELECT term, description, string_agg(gene, ',' ORDER BY gene) AS genes FROM gs GROUP BY 1, 2",
    "enrichment": _enrich_sql(),
    "enrichment_all_modules": _enrich_all_sql(),
    "clean_gene_sets": f"""WITH {_W}{_GMT}, raw AS (SELECT CAST(substr(term, 5) AS INT) AS t, term, string_agg(gene, chr(9) ORDER BY gene) AS genes FROM gs GROUP BY 1, 2)
        SELECT CASE WHEN t = 4 THEN 'pair' || chr(9) || chr(9) || 'GeneA' ELSE term || chr(9) || CASE WHEN t % 2 = 0 THEN 'http://x' ELSE 'about' END || chr(9) || genes END AS value FROM raw WHERE t <> 5""",
    "degree_centrality": f"WITH {_G} SELECT i AS gene, round(sum(weight), 6) AS strength, count(*) AS degree FROM gb GROUP BY 1",
    "adjacency_l2": f"WITH {_G} SELECT i, j, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY i)), 6) AS value FROM gb",
    "modules_from_w": f"WITH {_W} SELECT archetype AS module, string_agg(gene, ',' ORDER BY gene) AS genes FROM w WHERE weight >= 0.3 GROUP BY 1",
    "membership": f'WITH {_W} SELECT gene, coalesce(string_agg(CAST(archetype AS VARCHAR), \',\' ORDER BY archetype) FILTER (weight >= 0.3 AND archetype < 2), \'\') AS cluster, coalesce(min(archetype) FILTER (weight >= 0.3 AND archetype < 2), -1) AS "primary" FROM w GROUP BY gene',
    "umap_distance": f"WITH {_G}, v AS (SELECT DISTINCT i AS gene FROM gb) SELECT a.gene AS i, b.gene AS j, round((SELECT max(weight) FROM ge) - coalesce(gb.weight, 0), 6) + 0.0 AS distance FROM v a CROSS JOIN v b LEFT JOIN gb ON gb.i = a.gene AND gb.j = b.gene",
}
