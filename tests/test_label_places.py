import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nichegraph.operators import gauss, graph


def brute_place(points: list[tuple[str, float, float]]) -> tuple[str, float, float, int]:
    """All points against all; equal rows meet all of them each."""
    xy = np.array([p[1:] for p in points])
    low = np.linalg.cholesky(np.linalg.inv(np.cov(xy.T) * len(xy) ** (-1 / 3)))
    u, v = ((xy - xy.mean(0)) @ low).T
    density = np.concatenate([np.exp(-0.5 * ((u[i : i + 256, None] - u) ** 2 + (v[i : i + 256, None] - v) ** 2)).sum(1) for i in range(0, len(xy), 256)])
    times = Counter(points)
    return (*min((-round(d * times[p], 9), *p) for d, p in zip(density, points))[1:], len(points))


def test_crowded_clusters_equal_brute_force_in_time(spark):
    draw = np.random.default_rng(21)
    crowd = draw.normal(5, 2, (30_000, 2)) @ np.array([[1, 0.9], [0, 0.3]])
    tails = draw.standard_cauchy((3_000, 2))  # some points far off, in blocks of their own
    twice = draw.uniform(-1, 1, (1_500, 2)).round(2)
    angle = 2 * np.pi * np.arange(600) / 600
    clusters = {
        0: [(f"g{i:05}", float(x), float(y)) for i, (x, y) in enumerate(crowd)],
        1: [(f"g{i:05}", float(x), float(y)) for i, (x, y) in enumerate(tails)],
        2: [(f"g{i % 700:05}", float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([twice, twice[::3]]))],
        3: [(f"g{599 - i:05}", float(x), float(y)) for i, (x, y) in enumerate(np.stack([np.cos(angle), np.sin(angle)], axis=1).round(12))],
        4: [(f"g{i:05}", float(i % 7), float(i % 5)) for i in range(2_000)],  # many points at few places
        5: [(f"g{i:05}", 1e6 + x / 1e3, y) for i, (x, y) in enumerate(draw.normal(0, 1, (700, 2)).tolist())] + [("twin", 1e6, 0.25)] * 2,
    }
    df = spark.createDataFrame(pd.DataFrame([(c, *p) for c, points in clusters.items() for p in points], columns=["cluster", "gene", "x", "y"]))
    start = time.time()
    got = {r.cluster: (r.gene, r.x, r.y, r.n) for r in graph.density_peaks(df).collect()}
    assert time.time() - start < 90  # pairs of 30,000 points take minutes
    assert got == {c: brute_place(points) for c, points in clusters.items()}
    assert got[3][0] == "g00000" and got[5][0] == "twin"


@pytest.mark.parametrize("most", [gauss.MOST_PLACES, 90])
def test_places_that_may_be_densest(spark, most):
    draw = np.random.default_rng(22)
    u, v, m = *draw.normal(0, 9, (2, 2_000)), draw.integers(1, 4, 2_000)
    d = (m * np.exp(-0.5 * ((u[:, None] - u) ** 2 + (v[:, None] - v) ** 2))).sum(1)
    np.testing.assert_allclose(gauss.kernel_sums(u, v, *gauss.cell_series(u, v, m)), d, rtol=1e-12)
    k = np.where(np.arange(2_000) == 7, 1_000, 1)
    rows = pd.DataFrame({"cluster": "a", "i": np.arange(2_000), "u": u, "v": v, "m": m, "k": k, "slack": 1e-9})
    both = pd.concat([rows, rows.assign(cluster="b", k=1)])
    for slack in (1e-9, 0.05):
        out = gauss.may_be_densest(spark.createDataFrame(both).withColumn("slack", F.lit(slack)), most).collect()
        assert {r.i for r in out if r.cluster == "a"} == {7}
        assert {r.i for r in out if r.cluster == "b"} == set(np.flatnonzero(d >= d.max() * (1 - slack)))
        assert out[0].__fields__ == list(rows.columns)
