"""Targets that are met, that contradict each other, and shares of what the sampling keeps."""

import numpy as np
from pyspark.sql import functions as F

from nichegraph.llm import mixing

CELLS = "source string, lang string, topic string, tokens long, documents long"


def target(spark, shares):
    return spark.createDataFrame(list(shares.items()), "value string, share double")


def test_op4_contradicting_targets_end_and_say_their_gap(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10, 1), ("b", "y", "t", 30, 1), ("c", "y", "t", 20, 1)], CELLS)  # a is x, so their shares can't differ
    targets = {"source": target(spark, {"a": 0.5, "b": 0.25, "c": 0.25}), "lang": target(spark, {"x": 0.2, "y": 0.8}), "topic": target(spark, {"t": 1.0})}
    got = {r.source: r for r in mixing.rake(cells, targets).collect()}
    assert abs(got["a"].weight - 0.2) < 1e-9 and abs(got["a"].gap - 0.3) < 1e-9 and abs(got["b"].gap - 0.15) < 1e-9
    met = mixing.rake(cells, targets | {"lang": target(spark, {"x": 0.5, "y": 0.5})}).collect()
    assert all(r.gap <= mixing.TOLERANCE for r in met)


def test_op4_many_cells_are_raked_as_few(spark, monkeypatch):
    draw = np.random.default_rng(5)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", "t", int(draw.integers(1, 90)), 1) for i in range(3) for j in range(2)], CELLS)
    targets = {"source": target(spark, {"s0": 0.2, "s1": 0.3, "s2": 0.5}), "lang": target(spark, {"l0": 0.6, "l1": 0.4})}
    one = {(r.source, r.lang): r.weight for r in mixing.rake(cells, targets).collect()}
    monkeypatch.setattr(mixing, "ONE_TASK", 2)
    many = {(r.source, r.lang): r.weight for r in mixing.rake(cells, targets).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-9 for k in one)


def test_op4_sampled_tokens_have_the_targets_shares(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("word "), (F.col("id") % 40 + 5).cast("int"))).alias("text"), F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"),
        F.when(F.col("id") % 10 < 7, "web").otherwise("book").alias("source"), F.lit(0).cast("long").alias("n_chars"),
    )
    targets = {"source": target(spark, {"web": 0.55, "book": 0.45}), "lang": target(spark, {"de": 0.45, "en": 0.55}), "topic": target(spark, {"prose": 1.0})}
    rows = mixing.with_probability(docs, targets).filter("_draw < _probability")
    total = rows.agg(F.sum("_tokens")).first()[0]
    for d, shares in (("_source", {"web": 0.55, "book": 0.45}), ("_lang", {"de": 0.45, "en": 0.55})):
        got = {r[0]: r[1] / total for r in rows.groupBy(d).agg(F.sum("_tokens")).collect()}
        assert all(abs(got[v] - p) < 0.02 for v, p in shares.items())
    assert 0.55 < total / docs.agg(F.sum(F.regexp_count("text", F.lit("word")))).first()[0] <= 1


def test_op4_slow_targets_are_met(spark):
    cells = spark.createDataFrame([("a", "x", "t", 100, 1), ("a", "y", "t", 100, 1), ("b", "x", "t", 0, 1), ("b", "y", "t", 100, 1)], CELLS)
    targets = {"source": target(spark, {"a": 0.502, "b": 0.498}), "lang": target(spark, {"x": 0.5, "y": 0.5})}
    got = {(r.source, r.lang): r for r in mixing.rake(cells, targets).collect()}
    assert all(r.gap <= 1e-6 for r in got.values())
    for k, w in {("a", "x"): 0.5, ("a", "y"): 0.002, ("b", "y"): 0.498, ("b", "x"): 0.0}.items():
        assert abs(got[k].weight - w) < 1e-5


def test_op4_leaps_end_at_the_weights_of_plain_sweeps(spark):
    draw = np.random.default_rng(6)
    n = (draw.integers(0, 50, (4, 3, 2)) ** 2 * (draw.random((4, 3, 2)) < 0.8)).astype(float)
    names = ["source", "lang", "topic"]
    want, goal = n / n.sum(), [draw.dirichlet(np.ones(k)) * 0.3 + n.sum(tuple(x for x in range(3) if x != i)) / n.sum() * 0.7 for i, k in enumerate(n.shape)]
    for _ in range(20_000):
        for i in range(3):
            sums = want.sum(tuple(x for x in range(3) if x != i), keepdims=True)
            want = want * goal[i].reshape([-1 if x == i else 1 for x in range(3)]) / np.maximum(sums, 1e-300)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", int(n[i, j, k]), 1) for i in range(4) for j in range(3) for k in range(2)], CELLS)
    got = mixing.rake(cells, {d: target(spark, {f"{d[0]}{v}": float(p) for v, p in enumerate(g)}) for d, g in zip(names, goal)}).collect()
    assert all(abs(r.weight - want[int(r.source[1]), int(r.lang[1]), int(r.topic[1])]) < 1e-5 for r in got)
