"""Nearest neighbours against brute force: recall at two sizes, ties, repeated rows and ids, odd vectors, columns of any name."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichegraph.llm import ann_search, shared


def brute(rows, k=10, every=100):
    best = {}
    for q, w in rows:
        if q % every == 0:
            mine = best.setdefault(q, {})
            for i, v in rows:
                if i != q:
                    d = float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()))
                    mine[i] = min(d, mine.get(i, d))
    return {q: sorted((d, i) for i, d in found.items())[:k] for q, found in best.items()}


def test_op9_recall_and_share_of_rows_ranked(spark, monkeypatch):
    table, ranked, within = shared.table(spark, "/root/testdata/sf0.1", "embeddings"), [], ann_search.pairs_within

    def counted(*args):
        pairs = shared.written(within(*args))
        ranked.append(pairs.count())
        return pairs

    monkeypatch.setattr(ann_search, "pairs_within", counted)
    got = ann_search.neighbours(table).toPandas()
    e = table.toPandas()
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    queries, hits = ids[ids % 100 == 0], 0
    for q in queries:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        far[ids == q] = np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and np.allclose(mine.score, [far[ids == v][0] for v in mine.vec_id], rtol=0, atol=1e-12)
        hits += len(set(mine.vec_id) & set(ids[np.lexsort((ids, far))[:10]]))
    assert hits / (10 * len(queries)) >= 0.95 and set(got.query_id) == set(queries)
    assert ranked[0] < 0.2 * len(ids) * len(queries)


@pytest.mark.parametrize("block", [20_000, 40])
def test_op9_ties_repeats_and_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(ann_search, "BLOCK", block)
    monkeypatch.setattr(ann_search, "QUERY_BLOCK", max(2, block // 20))
    draw = np.random.default_rng(6)
    rows = [(i, draw.normal(size=8).round(2).tolist()) for i in range(400)]
    hot = rows[100][1]
    rows += [(i, hot) for i in range(500, 720)]  # a vector that many ids share, queries among them
    rows += rows[:30] + [(200, rows[7][1]), (33, rows[8][1]), (-100, rows[9][1])]
    odd = [(10**6, None), (10**6 + 100, [0.0] * 8), (10**6 + 200, [float("nan")] * 8), (10**6 + 300, [None] * 8), (None, [1.0] * 8), (10**6 + 400, [float("inf")] * 8), (10**6 + 500, [1.0] * 3), (10**6 + 600, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    for c in ("code", "rank", "v", "ids", "k1", "q", "found", "slot", "score", "query_id"):
        df = df.withColumn(c, F.col("vec_id").cast("string"))
    got = {}
    for r in ann_search.neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute(rows)
    assert got.keys() == want.keys()
    for q in (100, 500, 600, 700):  # exact ties: the smallest ids of the shared vector
        assert got[q] == [(0.0, i) for i in [100, *range(500, 720)] if i != q][:10]
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values())) and all(s == pytest.approx(dict((i, d) for d, i in brute([r for r in rows if r[0] in (q, v)])[q])[v]) for q in (0, 200) for s, v in got[q])


def test_op9_small_and_empty_tables(spark):
    table = shared.table(spark, "/root/testdata/sf0.001", "embeddings").select("vec_id", "embedding")
    assert ann_search.neighbours(table.limit(0)).count() == 0
    assert ann_search.neighbours(table.filter("vec_id < 4")).count() == 3
    assert ann_search.neighbours(table.filter("vec_id = 0")).count() == 0
