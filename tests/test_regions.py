"""Regions as background runs, cells as sets of numbers, scanlines, crowded blocks, paths, labels, the knee's record."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichegraph.operators import blocks, colocation, graph, niche, regions
from nichegraph.sources.tables import polygon_edges


def maps_of(spark, width, height, touched, background):
    n = width * height
    t = spark.createDataFrame(touched, "k int, bin_id long, value double")
    counts = {k: sum(r[0] == k for r in touched) for k in background}
    b = spark.createDataFrame([(k, v, n - counts[k]) for k, v in background.items()], "k int, value double, pixels long")
    return niche.NicheMaps(t, b, spark.createDataFrame([(0.0, 0.0, width, height)], "x_min double, y_min double, width int, height int"))


def test_background_runs_are_the_gaps(spark):
    draw = np.random.default_rng(1)
    some = sorted(draw.choice(91, 30, replace=False).tolist())
    touched = [(0, b, 1.0) for b in some] + [(1, b, 1.0) for b in range(91)] + [(3, 90, 0.0), (3, 0, 2.0)]
    maps = maps_of(spark, 13, 7, touched, {0: 0.5, 1: 0.5, 2: 0.5, 3: 0.5})
    for strip in (7, 10, niche.STRIP):
        got = niche.background_runs(maps, maps.background.filter("k < 3"), strip).collect()
        bins = {k: sorted(b for r in got if r.k == k for b in range(r.first, r.last + 1)) for k in range(4)}
        assert bins == {0: [b for b in range(91) if b not in some], 1: [], 2: list(range(91)), 3: []}
        assert all(r.first // strip == r.last // strip for r in got)
    picked = {(r.k, r.bin_id) for r in niche.selected_bins(maps, 0.5).collect()}
    assert picked == {(0, b) for b in range(91)} | {(1, b) for b in range(91)} | {(2, b) for b in range(91)} | {(3, b) for b in range(90)}
    sizes = {r.k: r.bins for r in niche.region(maps, 0.5).sizes().collect()}
    assert sizes == {0: 91, 1: 91, 2: 91, 3: 90}
    high = niche.region(maps, 1.5)
    assert high.background.isEmpty() and {r.k: r.bins for r in high.sizes().collect()} == {3: 1}


def test_assignment_stats_over_background(spark):
    draw = np.random.default_rng(2)
    width, height = 30, 20
    touched = [(k, int(b), float(v)) for k in range(3) for b, v in zip(draw.choice(600, 200, replace=False), draw.normal(size=200).round(2))]
    maps = maps_of(spark, width, height, touched, {0: 0.1, 1: -9.0, 2: 0.1})
    points = [(int(b), None if c == 0 else f"c{c}", None if g == 9 else "g") for b, c, g in zip(draw.integers(0, 600, 900), draw.integers(0, 60, 900), draw.integers(0, 10, 900))]
    binned = spark.createDataFrame(points, "bin_id long, cell string, gene string").withColumn("n", F.lit(7))
    t = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 50.0)], "k int, t double")
    got = {r.niche_k: r for r in regions.assignment_stats(niche.region(maps, 0.0, t), t, binned).collect()}
    for k, low in ((0, 0.0), (1, 0.0), (2, 50.0)):
        values = {b: v for kk, b, v in touched if kk == k}
        bins = {b for b in range(600) if values.get(b, {0: 0.1, 1: -9.0, 2: 0.1}[k]) >= low}
        here = [p for p in points if p[0] in bins]
        r = got[k]
        assert (r.n_selected_bins, r.n_cells_subset) == (len(bins), len({p[1] for p in here if p[1]}))
        assert (r.assigned_transcripts, r.unassigned_transcripts) == (sum(bool(p[1] and p[2]) for p in here), sum(bool(not p[1] and p[2]) for p in here))
    assert got[2].prop_assigned is None


def test_cells_in_names_the_sets_members(spark):
    rows = [(b, sorted({f"c{(b * 7 + i) % 40}" for i in range(b % 4)})) for b in range(200)]
    cells = spark.createDataFrame([r for r in rows if r[1]], "bin_id long, cells array<string>")
    selected = spark.createDataFrame([(k, b) for k in range(3) for b in range(k * 13, k * 13 + 9)], "k int, bin_id long")
    want = {(k, c) for k in range(3) for b in range(k * 13, k * 13 + 9) for c in rows[b][1]}
    assert sorted(map(tuple, regions.cells_in(selected, cells).collect())) == sorted(want)
    assert {r.cell for r in regions.cells_in(selected.select("bin_id").distinct(), cells).collect()} == {c for _, c in want}
    many = spark.range(100_000).select(F.concat(F.lit("c"), "id").alias("cell"))  # numbers over several bitmaps
    numbers = regions.cell_numbers(many)
    assert numbers.agg(F.count_distinct("number"), F.min("number"), F.max("number")).first()[:] == (100_000, 1, 100_000)
    odd = numbers.filter("number % 3 = 0").withColumn("k", F.lit(1))
    assert regions.members(regions.cell_sets(odd, ["k"]), numbers, ["k"]).select("cell").exceptAll(odd.select("cell")).isEmpty()


def inside(px, py, edges):
    odd = False
    for x1, y1, x2, y2 in edges:
        turn = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
        if turn == 0 and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
            return False
        if (y1 > py) != (y2 > py) and ((y2 > y1 and turn > 0) or (y2 < y1 and turn < 0)):
            odd = not odd
    return odd


@pytest.mark.parametrize("center", [True, False])
def test_scanlines_equal_every_edge(spark, center):
    star = [(20 + (18 if i % 2 else 7) * np.cos(i * np.pi / 8), 15 + (14 if i % 2 else 5) * np.sin(i * np.pi / 8)) for i in range(16)]
    shape = {"type": "MultiPolygon", "coordinates": [[star, [(17, 12), (23, 12), (23, 18), (17, 18)]], [[(2, 2), (8, 2), (8, 8), (5, 5), (2, 8)]], [[(-5, 30), (60, 30), (60, 33), (-5, 33)]], [[(30.25, 1), (39.75, 9), (30.25, 9)]]]}
    edges = polygon_edges(spark, shape)
    grid = spark.createDataFrame([(0.0, 0.0, 45, 36)], "x_min double, y_min double, width int, height int")
    bins = spark.range(45 * 36).select(F.col("id").alias("bin_id"))
    got = {r.bin_id for r in regions.bins_in_polygon(bins, edges, grid, 1.0, center).collect()}
    every, s = [tuple(e) for e in edges.collect()], 0.5 if center else 0.0
    assert got == {b for b in range(45 * 36) if inside(b % 45 + s, b // 45 + s, every)} and got


def test_ten_thousand_edges_with_holes(spark):
    at = np.linspace(0, 2 * np.pi, 5000, endpoint=False)
    ring = lambda r, wave: [(float(500 + (r + 20 * np.sin(wave * a)) * np.cos(a)), float(500 + (r + 20 * np.sin(wave * a)) * np.sin(a))) for a in at]
    outer, hole = ring(430, 40), ring(200, 25)
    edges = polygon_edges(spark, {"type": "Polygon", "coordinates": [outer, hole]})
    assert edges.count() == 10_000
    grid = spark.createDataFrame([(0.0, 0.0, 100, 100)], "x_min double, y_min double, width int, height int")
    out = regions.bins_in_polygon(spark.range(10_000).select(F.col("id").alias("bin_id")), edges, grid, 10.0)
    got = {r.bin_id for r in out.collect()}
    every = np.array([tuple(e) for e in edges.collect()])
    px, py = np.arange(10_000) % 100 * 10 + 5.0, np.arange(10_000) // 100 * 10 + 5.0
    odd = np.zeros(10_000, bool)
    for x1, y1, x2, y2 in every:
        turn = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
        odd ^= ((y1 > py) != (y2 > py)) & (((y2 > y1) & (turn > 0)) | ((y2 < y1) & (turn < 0)))
    assert got == set(np.flatnonzero(odd).tolist())
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Cross" in x or "NestedLoop" in x]
    assert len(joins) == 2  # with the grid alone, which is one row


def test_crowded_cell_of_fifty_thousand_clusters(spark):
    n = 50_000
    rows = spark.range(n).select(F.col("id").alias("meta_id"), F.concat(F.lit("g"), F.col("id") % 3).alias("gene"), (1 + F.col("id") % 2).cast("int").alias("n"), (F.col("id") % 100 / 100).cast("float").alias("x_centroid"), (F.floor(F.col("id") / 100) / 1000).cast("float").alias("y_centroid"))
    got = {(r.g_a, r.g_b): (r.w, r.m) for r in colocation.pair_sums(rows, 12).collect()}
    i = np.arange(n)
    size, count = {}, {}
    for g in range(3):
        size[g], count[g] = int((1 + i[i % 3 == g] % 2).sum()), int((i % 3 == g).sum())
    for a in range(3):
        for b in range(a, 3):  # all are within the radius
            squares = int(((1 + i[i % 3 == a] % 2) ** 2).sum())
            want = (size[a] * size[b], count[a] * count[b]) if a != b else ((size[a] ** 2 - squares) // 2, count[a] * (count[a] - 1) // 2)
            assert got[f"g{a}", f"g{b}"] == want


def test_pair_sums_equal_edges_whatever_the_parts(spark):
    draw = np.random.default_rng(5)
    rows = [(int(i), f"g{draw.integers(0, 5)}", int(draw.integers(1, 9)), float(x), float(y), "s" if i % 3 else "t") for i, (x, y) in enumerate(draw.normal(0, 20, (400, 2)).round(1))]
    meta = spark.createDataFrame(rows, "meta_id long, gene string, n int, x_centroid float, y_centroid float, slice string")
    for undirected in (True, False):
        for by in ([], ["slice"]):
            want = {}
            for a in rows:
                for b in rows:
                    fa, fb = np.float32(a[3:5]).astype(float), np.float32(b[3:5]).astype(float)
                    if a[0] < b[0] and (not by or a[5] == b[5]) and ((fa - fb) ** 2).sum() <= 144:
                        g = (min(a[1], b[1]), max(a[1], b[1])) if undirected else (a[1], b[1])
                        w, m = want.get(((a[5],) if by else ()) + g, (0, 0))
                        want[((a[5],) if by else ()) + g] = (w + a[2] * b[2], m + 1)
            for most in (blocks.MOST_ROWS, 25):
                got = {tuple(r)[:-2]: tuple(r)[-2:] for r in colocation.pair_sums(meta, 12, undirected, by, most).collect()}
                assert got == want
    assert colocation.pair_sums(meta.limit(0), 12).isEmpty() and colocation.meta_edges(meta.limit(0), 12).isEmpty()
    some = colocation.meta_edges(meta, 12, ["slice"], 25)
    assert some.columns == ["slice", "edge_source", "edge_target", "weight", "gene_source", "gene_target"]
    assert some.filter("edge_source >= edge_target").isEmpty() and some.distinct().count() == some.count() == sum(m for _, m in want.values())


def brute_paths(edges):
    names, near = sorted({n for a, b, _ in edges for n in (a, b)}), {}
    for a, b, w in edges:
        if w > 0:
            near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = 1 / w
    between, close = dict.fromkeys(names, 0.0), {}
    for s in names:
        far, ways, before, order, heap, seen = {}, {s: 1.0}, {s: []}, [], [(0.0, s)], {s: 0.0}
        while heap:
            d, v = heapq.heappop(heap)
            if v in far:
                continue
            far[v] = d
            order.append(v)
            for w, length in near.get(v, {}).items():
                if w not in seen or d + length < seen[w] - 1e-12:
                    seen[w], ways[w], before[w] = d + length, ways[v], [v]
                    heapq.heappush(heap, (seen[w], w))
                elif w not in far and abs(d + length - seen[w]) <= 1e-12:
                    ways[w] += ways[v]
                    before[w].append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += ways[v] / ways[w] * (1 + share[w])
        for v in order:
            between[v] += share[v] / 2 if v != s else 0
        close[s] = (len(far) - 1) / sum(far.values()) if len(far) > 1 else 0.0
    return {n: (between[n], close[n]) for n in names}


def test_shortest_paths_equal_one_source_at_a_time(spark):
    draw = np.random.default_rng(7)
    grid = [(f"{i}{j}", f"{i + a}{j + b}", 1.0) for i in range(4) for j in range(4) for a, b in ((0, 1), (1, 0)) if i + a < 4 and j + b < 4]  # many equal paths
    mixed = [(f"v{a:02}", f"v{b:02}", float(draw.integers(1, 4))) for a in range(15) for b in range(a) if draw.random() < 0.25] + [("p", "q", 2.0), ("q", "r", -1.0), ("r", "r", 5.0)]
    for edges in (grid, mixed):
        got = {r.gene: (r.betweenness, r.closeness) for r in graph.shortest_path_centrality(spark.createDataFrame(edges, "a string, b string, weight double")).collect()}
        want = brute_paths([e for e in edges if e[0] != e[1]])
        assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], abs=1e-9) for g in want)


def test_label_places(spark):
    draw = np.random.default_rng(9)
    points = [(c, f"g{c}{i}", float(x), float(y)) for c in range(3) for i, (x, y) in enumerate(draw.normal(c, 1 + c, (20, 2)))] + [(7, f"few{i}", i * 1.0, i * i * 1.0) for i in range(3)] + [(8, f"line{i}", i * 1.0, 2.0 * i) for i in range(9)]
    df = spark.createDataFrame([*points, (0, "none", None, 1.0)], "cluster int, gene string, x double, y double")
    got = {r.cluster: r for r in graph.density_peaks(df).collect()}
    assert sorted(got) == [0, 1, 2]
    for c in range(3):
        xy = np.array([p[2:] for p in points if p[0] == c])
        inverse = np.linalg.inv(np.cov(xy.T) * len(xy) ** (-1 / 3))
        d = xy[:, None] - xy[None]
        best = int(np.argmax(np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", d, inverse, d)).sum(1)))
        assert (got[c].gene, got[c].x, got[c].n) == (f"g{c}{best}", xy[best][0], 20)
    assert [r.cluster for r in graph.density_peaks(df, [1]).collect()] == [1]


def test_knee_record(spark):
    v = np.concatenate([np.zeros(40), np.linspace(0, 1, 300), np.linspace(1, 10, 60), np.full(10, 10.0)])
    df = spark.createDataFrame([(float(a),) for a in v], "value double")
    for piece in (1_000_000, 64):
        r = regions.knee_record(df, "zero", piece=piece).first()
        fit = v[r.start_index :]
        ys, xs = (fit - fit.min()) / (fit.max() - fit.min() + 1e-12), np.linspace(0, 1, len(fit))
        at = int(np.argmax(np.abs(ys - xs * ys[-1])))
        assert (r.n, r.start_index) == (410, 41) and r.first.index_fit == at and r.first.threshold == fit[at]
        assert r.first.index_all == np.searchsorted(v, fit[at]) and r.first.x == pytest.approx(r.first.index_all / 409)
        assert r.first.occupancy == pytest.approx((v > fit[at]).mean()) and r.first.percentile == pytest.approx(100 * (v <= fit[at]).mean())
        assert r.second.index_fit > at and r.first_sharper.index_fit > at
    r = regions.knee_record(df, "zero", second=False, sharper=False).first()
    assert r.second is None and r.first_sharper is None and r.second_sharper is None and r.first is not None
    wide = regions.knee_record(df, "zero", second_fraction=0.5).first()
    assert wide.second_sharper.index_fit >= regions.knee_record(df, "zero").first().second_sharper.index_fit
    with pytest.raises(ValueError):
        regions.knee_record(df, 405)
    with pytest.raises(ValueError):
        regions.knee_record(df, "never")


def test_clusters_by_slice_are_those_of_each(spark):
    from nichegraph.operators import clusters

    draw = np.random.default_rng(12)
    rows = [(f"g{draw.integers(0, 3)}" if i % 50 else None, float(x), float(y), None if i % 3 == 0 else "ab"[i % 2]) for i, (x, y) in enumerate(draw.uniform(0, 60, (600, 2)))]
    pts = spark.createDataFrame(rows, "gene string, x float, y float, slice string")
    both = clusters.metatranscripts(pts, by=["slice"])
    assert both.columns == ["slice", "gene", "bin_x", "bin_y", "n", "x_centroid", "y_centroid", "meta_id"]
    for s in ("a", "b", None):
        own = clusters.metatranscripts(pts.filter(F.col("slice").eqNullSafe(s)))
        got = both.filter(F.col("slice").eqNullSafe(s)).drop("slice")
        assert own.count() > 20 and own.exceptAll(got).isEmpty() and got.exceptAll(own).isEmpty()
    with pytest.raises(ValueError):
        graph.graph_edges(spark.createDataFrame([("a", "b", 1.0, False)], "g_a string, g_b string, Z double, keep boolean"), required=True)
