"""The two classifiers' fits and scores against plain loops, and terms that tell about the label in pairs only."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from nichegraph.llm import quality_rules, shared, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def pairs_of_terms(kind, n=3000):
    draw, texts, y = np.random.default_rng(0), [], []
    for i in range(n):
        if kind == "insult":  # both together in every 33rd text, each by itself as often in clean ones
            some = [[0, 1], [0], [1]][i % 33] if i % 33 < 3 else []
        else:
            some = np.flatnonzero(draw.integers(0, 2, 2)).tolist()
        y.append(float(len(some) == 1 if kind == "xor" else len(some) == 2))
        texts.append(np.sort(np.array(some + list(10 + draw.choice(200, 15, replace=False)), dtype=np.int32)))
    return texts, np.array(y)


@pytest.mark.parametrize("kind", ["xor", "and", "insult"])
def test_op5_learns_pairs_that_additive_weights_miss(kind):
    texts, y = pairs_of_terms(kind)
    half = len(y) // 2
    m = toxicity.fit(texts[:half], y[:half])
    assert np.mean([(m.score(t) >= 0.5) == k for t, k in zip(texts[half:], y[half:])]) > 0.95
    assert np.mean([m.score(t) >= 0.5 for t, k in zip(texts[half:], y[half:]) if k]) > 0.95


def test_op5_score_equals_a_double_loop():
    draw = np.random.default_rng(1)
    m = toxicity.Machine(0.1, draw.normal(size=50), draw.normal(size=(50, 4)) / 2)
    for n in (0, 1, 7, 20):
        ids = np.sort(draw.choice(50, n, replace=False))
        x = m.bias + sum(m.w[i] for i in ids) + sum(m.v[i] @ m.v[j] for i in ids for j in ids if i < j)
        assert m.score(ids) == pytest.approx(1 / (1 + np.exp(-x)))


def test_op5_pairs_add_to_additive_weights_on_real_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = shared.table(spark, d, "documents"), shared.table(spark, d, "labels")
    rows = docs.join(labels, "doc_id").filter("toxic is not null").select("doc_id", "text", "toxic").toPandas().sort_values("doc_id")
    terms = toxicity.Terms()
    x, y = [toxicity.features(t or "", terms) for t in rows.text], rows.toxic.to_numpy(float)
    train = rows.doc_id.to_numpy() % 3 > 0
    m = toxicity.fit([t for t, k in zip(x, train) if k], y[train])
    flat = toxicity.Machine(m.bias, m.w, np.zeros_like(m.v))
    right = [np.mean([(n.score(t) >= 0.5) == k for t, k, tr in zip(x, y, train) if not tr]) for n in (m, flat)]
    assert right[0] > 0.97 and right[0] >= right[1]


def plain_statistics(text):
    raw = text.encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    share = lambda n, of: n / max(1, of)
    letters = [c for c in raw if chr(c).isalpha() and c < 128]
    signs = [c for c in raw if 33 <= c < 127 and not chr(c).isalnum() and c not in b",.|"]
    runs = {w: c for w, c in Counter(words).items()}
    return {
        "size": np.log1p(len(raw)), "words": np.log1p(len(words)), "upper": share(sum(65 <= c <= 90 for c in letters), len(letters)), "digits": share(sum(48 <= c <= 57 for c in raw), len(raw)),
        "spaces": share(raw.count(b" "), len(raw)), "breaks": share(raw.count(b"\n"), len(raw)), "periods": share(raw.count(b"."), len(raw)), "bars": share(raw.count(b"|") + raw.count(b"\t"), len(raw)), "signs": share(len(signs), len(raw)),
        "high_bytes": share(sum(c >= 128 for c in raw), len(raw)), "word_size": share(sum(map(len, words)), len(words)), "longest_word": max(map(len, words), default=0), "distinct": share(len(runs), len(words)), "top_word": share(max(runs.values(), default=0), len(words)),
        "same_as_before": share(sum(a == b for a, b in zip(words, words[1:])), len(words)), "short_words": share(sum(len(w) <= 2 for w in words), len(words)), "odd_words": share(sum(bool(re.search(rb"[!-/:-@[-`{-~]$", w)) for w in words), len(words)),
        "repeated_lines": 1 - share(len(set(lines)), len(lines)), "line_size": share(len(raw), len(lines)), "repeated_pairs": 1 - len(set(zip(words, words[1:]))) / (len(words) - 1) if len(words) > 1 else 0.0,
    }


def test_op6_statistics_equal_plain_code():
    draw = random.Random(2)
    texts = ["", "one", "Ünïcode ΑΒΓ 😀\tA|b\n\nx. y! y! 12"] + ["".join(draw.choice("ab cD1.,|\n\t!é ") for _ in range(n)) for n in (5, 80, 900)]
    for t in texts:
        want = plain_statistics(t)
        got = dict(zip(quality_rules.STATISTICS, quality_rules.statistics_of(t)))
        if "\x7f" not in t:
            assert got == pytest.approx(want), t


def test_op6_rules_as_columns_equal_numpy(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(400, len(quality_rules.STATISTICS))).round(1)
    y = ((x[:, 0] > 0.3) & (x[:, 3] <= 0.5) | (x[:, 7] > 1)).astype(float)
    rules = quality_rules.fit(x, y)
    odds = [rules.intercept + sum(w for parts, w in rules.rules if all((r[k] > t) == above for k, above, t in parts)) for r in x]
    assert rules.rules and np.mean((np.array(odds) >= 0) == y) > 0.95
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *quality_rules.STATISTICS])
    from pyspark.sql import functions as F

    got = {r.i: r.o for r in df.select("i", rules.log_odds(F.struct(*quality_rules.STATISTICS)).alias("o")).collect()}
    assert all(got[i] == pytest.approx(o) for i, o in enumerate(odds))


def test_op6_every_leaf_moves_its_rows():
    x = np.zeros((200, 2))
    x[:100, 0], x[150:, 1] = 1, 1  # the first cut's left side can't be cut again
    y = (x[:, 0] > 0).astype(float)
    y[160:] = 1
    rules = quality_rules.tree_rules(x, y, rounds=30, depth=3)
    assert ((0, True, 0.0),) in rules and ((0, False, 0.0), (1, True, 0.0)) in rules and len(rules) <= 12


def test_training_rows_are_bounded_as_rows(spark):
    from nichegraph.llm import labelled

    docs = spark.createDataFrame([(1, f"text {i % 50}") for i in range(3000)] + [(2, "other"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1)], "doc_id long, quality int")
    whole = labelled.training_rows(docs.filter("doc_id > 1"), labels, "quality", 1000, 999, 30)
    assert sorted(map(tuple, whole.collect())) == [(2, "other", 0), (3, "", 1)]
    for most, n in ((30, 30), (100, 52)):
        rows = labelled.training_rows(docs, labels, "quality", 1000, 999, most).collect()
        assert len(rows) == len(set(rows)) == n
