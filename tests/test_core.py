"""Operators on points: hand-worked tables, boundaries, brute force, and invariants of the iterative kernels."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nichegraph.functions.columns import cell_id, coerce_threshold, gene_category, parse_tokens, with_cell
from nichegraph.operators import clusters, colocation, curve, enrichment, graph, niche, overlap, regions
from nichegraph.sources.tables import gmt_terms, polygon_edges

GOLDEN = [("A", 1, 1), ("A", 3, 1), ("B", 2, 5), ("B", 4, 5), ("B", 6, 5), ("A", 9, 1), ("A", 11, 3), ("C", 100, 100), ("B", -1, -1), ("B", -3, -1)]
POINTS = "gene string, x float, y float"


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([(g, float(x), float(y)) for g, x, y in GOLDEN], POINTS)


def test_golden_clusters_and_pairs(golden):
    meta = clusters.metatranscripts(golden)
    rows = {r.meta_id: (r.gene, r.bin_x, r.bin_y, r.n, r.x_centroid, r.y_centroid) for r in meta.collect()}
    assert rows == {0: ("A", 0, 0, 2, 2.0, 1.0), 1: ("A", 1, 0, 2, 10.0, 2.0), 2: ("B", -1, -1, 2, -2.0, -1.0), 3: ("B", 0, 0, 3, 4.0, 5.0)}
    edges = {(r.edge_source, r.edge_target, r.weight) for r in colocation.meta_edges(meta, 12).collect()}
    assert edges == {(0, 1, 4), (0, 2, 4), (0, 3, 6), (1, 3, 6), (2, 3, 6)}
    pairs = {(r.g_a, r.g_b): r for r in colocation.pair_statistics(meta).pairs.collect()}
    assert pairs["A", "B"].O == 16 and pairs["A", "B"].keep and not pairs["A", "A"].keep
    assert pairs["A", "B"].Z == pytest.approx(3.781095, abs=1e-5) and pairs["B", "B"].PMI == pytest.approx(-0.290764, abs=1e-5)


def test_radius_is_inclusive_and_matches_brute_force(spark):
    draw = np.random.default_rng(3)
    xy = np.round(draw.uniform(-50, 50, (300, 2)) * 8) / 8
    meta = spark.createDataFrame([(i, "g", 1, float(a), float(b)) for i, (a, b) in enumerate([*xy.tolist(), (200, 200), (200, 210)])], "meta_id long, gene string, n int, x_centroid float, y_centroid float")
    got = {(r.edge_source, r.edge_target) for r in colocation.meta_edges(meta, 10).collect()}
    every = np.vstack([xy, [[200, 200], [200, 210]]])
    d = ((every[:, None] - every[None]) ** 2).sum(2)
    assert got == {(i, j) for i in range(len(every)) for j in range(i + 1, len(every)) if d[i, j] <= 100}
    assert (300, 301) in got


def test_prepare_boundaries(spark):
    rows = [("g", 1.0, 1.0, q, c) for q, c in [(20.0, "predesigned_gene"), (19.9, "predesigned_gene"), (float("nan"), "predesigned_gene"), (30.0, "other"), (None, "predesigned_gene")]]
    df = spark.createDataFrame(rows, "feature_name string, x_location float, y_location float, qv float, codeword_category string")
    assert clusters.quality_filtered(df).count() == 1
    with pytest.raises(ValueError):
        clusters.quality_filtered(df, "none")
    pts = spark.createDataFrame([("a", 0.0, 0.0)] * 4 + [("b", 0.0, 0.0)] * 2 + [(None, 0.0, 0.0)] * 2, POINTS)
    assert {r.gene for r in clusters.frequent_genes(pts, 2, 2).collect()} == {"b"}  # 4 is not below 8 / 2
    cos = spark.createDataFrame([("a", 100.0, 10.125)], "target string, x_global_px float, y_global_px float")
    r = clusters.prepared(cos, "cosmx", 0.5, 1).first()
    assert r.x == np.float32(100) * np.float32(0.18) and r.y == np.float32(10.125) * np.float32(0.18) != np.float32(10.125 * 0.18)
    assert clusters.metatranscripts(pts.limit(0)).count() == 0


def test_names_ids_tokens(spark):
    df = spark.createDataFrame([("NegControlX",), ("Abc",), ("a_b",), ("blank",)], "g string")
    assert [r[0] for r in df.select(gene_category(F.col("g"))).collect()] == ["something_else", "predesigned_gene", "something_else", "predesigned_gene"]
    df = spark.createDataFrame([(1, 2.0, " c1 "), (-1, float("nan"), "unassigned"), (None, 2.5, ""), (7, -1.0, None)], "i int, f double, s string")
    got = df.select(*(cell_id(df, c).alias(c) for c in "ifs")).collect()
    assert [tuple(r) for r in got] == [("1", "2", "c1"), (None, None, None), (None, "2.5", None), ("7", None, None)]
    assert coerce_threshold("P98") == "p98" and coerce_threshold("0.5") == 0.5 and parse_tokens(["5", "x"]) == ["UNASSIGNED", -1, 5, "x"]


def test_stouffer(spark):
    a = spark.createDataFrame([("x", "y", 2.0), ("x", "z", float("nan"))], "g_a string, g_b string, Z double")
    b = spark.createDataFrame([("y", "x", 2.0)], "g_a string, g_b string, Z double")
    r = colocation.stouffer([a, b]).collect()
    assert len(r) == 1 and r[0].Z == pytest.approx(4 / math.sqrt(2)) and r[0].n_slices == 2 and r[0].keep
    with pytest.raises(ValueError):
        colocation.stouffer([])
    with pytest.raises(ValueError):
        colocation.stouffer([a.drop("Z")])


def test_niche_maps_match_dense(spark):
    draw = np.random.default_rng(1)
    n, size, radius = 400, 8, 8
    x, y, g = np.round(draw.uniform(0, 120, n), 0), np.round(draw.uniform(0, 90, n), 0), draw.integers(0, 3, n)
    pts = spark.createDataFrame([(f"g{a}", float(b), float(c)) for a, b, c in zip(g, x, y)], POINTS)
    w = np.array([[0.6, 0.1], [0.1, 0.7], [0.2, 0.2]])
    weights = spark.createDataFrame([(f"g{i}", k, float(w[i, k])) for i in range(3) for k in range(2)], "gene string, archetype int, weight double")
    maps = niche.niche_maps(pts, weights, size, radius)
    grid = maps.grid.first()
    dense = np.zeros((grid.height, grid.width, 3))
    np.add.at(dense, (((y - y.min()) // size).astype(int), ((x - x.min()) // size).astype(int), g), 1)
    for axis in (0, 1):
        out = np.zeros_like(dense)
        for o, v in niche.kernel(radius / size):
            moved = np.roll(dense, o, axis)
            cut = [slice(None)] * 3
            cut[axis] = slice(0, o) if o > 0 else slice(dense.shape[axis] + o, None)
            if o:
                moved[tuple(cut)] = 0
            out += v * moved
        dense = out
    z = (dense - dense.mean((0, 1))) / dense.std((0, 1))
    z[..., 2] = 0
    want = z @ np.where(w > 0.3, w, 0)
    for r in maps.touched.collect():
        assert r.value == pytest.approx(want[r.bin_id // grid.width, r.bin_id % grid.width, r.k], abs=1e-9)
    t = {r.k: r.t for r in niche.thresholds(maps, "p80").collect()}
    assert t[0] == pytest.approx(np.percentile(want[..., 0], 80), abs=1e-9)
    picked = niche.selected_bins(maps, -100.0).groupBy("k").count().collect()
    assert {r["count"] for r in picked} == {grid.height * grid.width}


def test_knee(spark):
    v = np.concatenate([np.linspace(0, 1, 80), np.linspace(1, 10, 20)])
    df = spark.createDataFrame([(float(a),) for a in v], "value double")
    got = {r.knee: r for r in regions.knee(df, start_mode=0).collect()}
    ys, xs = (v - v.min()) / (v.max() - v.min()), np.linspace(0, 1, len(v))
    at = int(np.argmax(np.abs(ys - xs)))
    assert got["first"].threshold == v[at] and got["first"].occupancy == pytest.approx((v > v[at]).mean())
    assert got["first_sharper"].threshold > got["first"].threshold
    with pytest.raises(ValueError):
        regions.knee(df.limit(5))


def test_curve_in_pieces_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.round(rng.normal(size=300), 1), np.full(150, 0.5), rng.normal(size=50)])  # ties, and one value in a third of the rows
    df = spark.createDataFrame([(float(v),) for v in x], "value double")
    runs = curve.sorted_runs(df, len(x), strip=40)
    assert runs.count() == len(np.unique(x))
    rows = curve.pieces(runs, len(x), size=37, before=3, after=5).toPandas()
    own = rows[rows.own].sort_values("i")
    assert own.i.tolist() == list(range(len(x))) and own.value.tolist() == sorted(x)
    for p, g in rows.groupby("piece"):
        assert sorted(g.i) == list(range(max(0, p * 37 - 3), min(len(x), (p + 1) * 37 + 5)))
    for q in (0.0, 0.2, 0.77, 1.0):
        assert curve.quantile(df, q, strip=40) == pytest.approx(np.quantile(x, q), abs=1e-12)
    assert curve.quantile(df.limit(0), 0.5) is None


def test_knee_is_the_same_in_pieces(spark):
    x = np.concatenate([np.zeros(200), np.linspace(0, 1, 300) ** 3, np.linspace(1, 9, 60)])
    df = spark.createDataFrame([(float(v),) for v in x], "value double")
    for mode in ("auto", 5):
        whole, parts = (sorted(map(tuple, regions.knee(df, mode, piece=k).collect())) for k in (10_000, 50))
        assert whole == parts and len(whole) == 4
    with pytest.raises(ValueError):
        regions.knee(df, "other")


def test_floating_cells_follow_the_whole_column(spark):
    ids = lambda values: [r.cell for r in with_cell(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()]
    assert ids([3.0, -1.0, None, float("nan"), 4.0]) == ["3", None, None, None, "4"]
    assert ids([3.0, -1.0, 4.5]) == ["3.0", None, "4.5"]
    assert ids([-1.0, None]) == [None, None]


def test_polygon(spark):
    edges = polygon_edges(spark, {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4]], [[1, 1], [2, 1], [2, 2], [1, 2]]]})
    grid = spark.createDataFrame([(0.0, 0.0, 6, 6)], "x_min double, y_min double, width int, height int")
    bins = spark.range(36).withColumnRenamed("id", "bin_id")
    got = {r.bin_id for r in regions.bins_in_polygon(bins, edges, grid, 1.0).collect()}
    assert got == {y * 6 + x for x in range(4) for y in range(4)} - {7}
    for bad in ({"type": "FeatureCollection", "features": []}, {"type": "Feature", "geometry": None}, [(0, 0), (1, 1)]):
        with pytest.raises(ValueError):
            polygon_edges(spark, bad)


def test_overlap_matches_dbscan_rule(spark):
    draw = np.random.default_rng(5)
    xy = np.vstack([draw.normal(0, 4, (90, 2)), draw.uniform(-80, 80, (60, 2))]).astype(np.float32)
    pts = spark.createDataFrame([("g", float(a), float(b), "c1") for a, b in xy], "gene string, x float, y float, cell string")
    genes = spark.createDataFrame([(0, "g")], "module int, gene string")
    d = ((xy[:, None].astype(float) - xy[None]) ** 2).sum(2) <= 100
    m = int(max(np.percentile(d.sum(1) - 1, 80), 5))
    near = d[:, d.sum(1) >= m].any(1)
    assert overlap.cell_overlaps(pts, genes, 1, least=5).first().module_0 == pytest.approx(near.mean())


def test_graph_kernels(spark):
    e = [("a", "b", 2.0), ("b", "c", 1.0), ("c", "d", 4.0), ("a", "c", 0.5), ("x", "y", 1.0)]
    edges = spark.createDataFrame(e, "a string, b string, weight double")
    paths = {r.gene: r for r in graph.shortest_path_centrality(edges).collect()}
    assert paths["b"].betweenness == pytest.approx(2) and paths["c"].betweenness == pytest.approx(2) and paths["a"].betweenness == 0
    assert paths["a"].closeness == pytest.approx(3 / (0.5 + 1.5 + 1.75)) and paths["x"].closeness == 1
    v = {r.gene: r.eigenvector for r in graph.eigenvector(edges.filter("a <> 'x'")).collect()}
    names = sorted(v)
    m = np.zeros((4, 4))
    for a, b, w in e[:4]:
        m[names.index(a), names.index(b)] = m[names.index(b), names.index(a)] = w
    x = np.array([v[n] for n in names])
    assert np.allclose(m @ x, (m @ x).max() * x, atol=1e-6)
    aa = graph.archetypes(edges, 2).toPandas()
    assert (aa.weight >= 0).all() and np.allclose(aa[aa.matrix == "W"].groupby("gene").weight.sum(), 1) and np.allclose(aa[aa.matrix == "H"].groupby("archetype").weight.sum(), 1)
    assert (graph.nmf(edges, 2).toPandas().weight >= 0).all()
    c = {r.gene: r.cluster for r in graph.communities(edges).collect()}
    assert c["x"] == c["y"] != c["a"]


def test_gmt_and_enrichment(spark):
    lines = spark.createDataFrame([(1, "t1\thttp://a\tg1\tg2\tg2"), (2, "t2 d g1 g3"), (3, "short\tx"), (4, "t1\tlast\tg3")], "line long, value string")
    got = {r.term: (r.description, r.genes) for r in gmt_terms(lines).collect()}
    assert got == {"t1": ("last", ["g3"]), "t2": ("d", ["g1", "g3"])}
    bg = spark.createDataFrame([(f"g{i}",) for i in range(20)], "gene string")
    modules = spark.createDataFrame([(0, [f"g{i}" for i in range(6)])], "module int, genes array<string>")
    terms = spark.createDataFrame([("t", [f"g{i}" for i in range(2, 10)])], "term string, genes array<string>")
    r = enrichment.enrichment(modules, terms, bg).first()
    want = sum(math.comb(8, x) * math.comb(12, 6 - x) for x in range(4, 7)) / math.comb(20, 6)
    assert r.overlap == 4 and r.P == pytest.approx(want)


def test_support_errors(spark):
    empty = spark.createDataFrame([], "bin_id long")
    with pytest.raises(ValueError):
        regions.support(empty, empty, [])
    with pytest.raises(ValueError):
        regions.assignment_stats(empty, empty, empty, 0)


def test_command_runs(spark, tmp_path, golden):
    from nichegraph.jobs.cli import main

    source = str(tmp_path / "in")
    golden.select(F.col("gene").alias("target"), F.col("x").alias("x_global_px"), F.col("y").alias("y_global_px")).write.parquet(source)
    main(["--transcripts-path", source, "--output-dir", str(tmp_path / "out"), "--mode", "cosmx_prefiltered", "--k", "2"])
    assert spark.read.parquet(str(tmp_path / "out" / "pairs")).count() == 3


def test_stream_counts(spark, tmp_path):
    from nichegraph.streaming.bin_counts import stream_bin_counts

    pd.DataFrame({"x": np.array([1, 2, 9], np.float32), "y": np.array([1, 1, 1], np.float32), "cell": ["a", None, "b"]}).to_parquet(tmp_path / "p.parquet")
    src = spark.readStream.schema("x float, y float, cell string").parquet(str(tmp_path))
    q = stream_bin_counts(src).writeStream.outputMode("complete").format("memory").queryName("bins").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.bin_x, r.n_total, r.n_unassigned) for r in spark.table("bins").collect()} == {(0, 2, 1), (1, 1, 0)}


def test_near_sums_of_split_blocks_equal_brute_force(spark):
    from nichegraph.operators import overlap

    draw = np.random.default_rng(3)
    rows = [(int(m), float(x), float(y), int(w)) for m, x, y, w in zip(draw.integers(0, 2, 400), draw.normal(0, 15, 400).round(1), draw.normal(0, 15, 400).round(1), draw.integers(1, 4, 400))]
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "module int, x double, y double, m int")
    want = {r[:3]: sum(o[3] for o in rows if o[0] == r[0] and (o[1] - r[1]) ** 2 + (o[2] - r[2]) ** 2 <= 25) for r in rows}
    for most in (20_000, 30):
        got = overlap.near_sums(df, 5, "m", most).collect()
        assert len(got) == len(rows) and {(r.module, r.x, r.y): r.near for r in got} == want


def test_tiled_sums_equal_brute_force():
    from nichegraph.operators.overlap import tiled_sums

    draw = np.random.default_rng(8)
    for n, step, spread in ((900, 0.5, 60), (900, 10, 60), (300, 0.01, 3), (1, 1, 1)):
        ox, oy = (np.round(draw.uniform(low, low + spread, n) / step) * step for low in (100, -30))
        w, some = draw.integers(1, 5, n).astype(float), slice(0, n // 2 + 1)
        want = [w[(ox - a) ** 2 + (oy - b) ** 2 <= 100].sum() for a, b in zip(ox[some], oy[some])]
        assert tiled_sums(ox[some], oy[some], ox, oy, w, 10.0).tolist() == want


def test_quantiles_by_key_of_many_strips(spark):
    from nichegraph.operators.curve import quantiles

    draw = np.random.default_rng(4)
    values = {k: draw.normal(size=n).round(2) for k, n in ((0, 500), (1, 3), (2, 1))}
    df = spark.createDataFrame([(k, float(v), 1 + i % 3) for k, vs in values.items() for i, v in enumerate(vs)], "k int, value double, freq long")
    for strip in (1_000_000, 20):
        got = {r.k: (r.a, r.b, r.c) for r in quantiles(df, "k", {"a": 0.0, "b": 0.83, "c": 1.0}, strip).collect()}
        for k, vs in values.items():
            every = np.repeat(vs, [1 + i % 3 for i in range(len(vs))])
            assert got[k] == pytest.approx(tuple(np.quantile(every, q) for q in (0, 0.83, 1)))


def test_gene_set_folders(spark, tmp_path):
    from nichegraph.sources.tables import gene_set_lines, save_clean_sets

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "h.all.gmt").write_text("A\thttp://x\tg1\tg2\n\nB  about g3 g4\nP\tg5\n")
    (tmp_path / "in" / "M2.gmt").write_text("C\tc\tg6\n")
    names = lambda species: {r.file for r in gene_set_lines(spark, str(tmp_path / "in"), species).collect()}
    assert (names("Human"), names("mouse"), names("")) == ({"h.all.gmt"}, {"M2.gmt"}, {"h.all.gmt", "M2.gmt"})
    (tmp_path / "in" / "M2.gmt").rename(tmp_path / "in" / "x.gmt")
    assert gene_set_lines(spark, str(tmp_path / "in"), "mouse").isEmpty()
    for _ in range(2):  # the second call leaves the copies as they are
        save_clean_sets(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    clean = {r.value for r in spark.read.text(str(tmp_path / "out")).select("value").collect()}
    assert clean == {"A\thttp://x\tg1\tg2", "B\tabout\tg3\tg4", "P\t\tg5", "C\tc\tg6"}


def test_gene_graph_in_one_call(spark):
    from nichegraph.jobs.colocalization import gene_graph

    genes = [f"g{i}" for i in range(8)]
    pairs = [(a, b, 5.0 if i // 4 == j // 4 else 0.5, True) for i, a in enumerate(genes) for j, b in enumerate(genes) if i < j and (i // 4 == j // 4 or (i, j) == (3, 4))]
    df = spark.createDataFrame(pairs, "g_a string, g_b string, Z double, keep boolean")
    terms = spark.createDataFrame([("t", genes[:3])], "term string, genes array<string>")
    got = gene_graph(df, k=2, w_threshold=0.6, with_centrality=True, terms=terms)
    assert sorted(map(sorted, (r.genes for r in got.modules_w.collect()))) == [genes[:4], genes[4:]]
    assert {r.module for r in got.enrichment.collect()} == {0, 1} and sorted((r.term or "") for r in got.enrichment.collect()) == ["", "t"]
    assert got.centrality.count() == 8 and got.modules_h.count() == 2
    with pytest.raises(ValueError):
        gene_graph(df.withColumn("keep", F.lit(False)))
    with pytest.raises(ValueError):
        graph.gene_program(got.w, 7)
