"""Near copies by exact similarity, and rows of repeated ids."""

import random

import numpy as np
import pytest

from nichegraph.llm import near_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    x, y = set(near_dedup.shingles(a, 5).tolist()), set(near_dedup.shingles(b, 5).tolist())
    return len(x & y) / len(x | y)


def test_op8_stage_finds_copies_of_0_8_to_0_95(spark):
    draw = random.Random(5)
    texts, copies = [], 0
    for _ in range(80):
        words = [f"w{draw.randrange(5000)}" for _ in range(300)]
        texts.append(" ".join(words))
        for at in draw.sample(range(300), draw.randrange(1, 6)):
            words[at] = "changed"
        copies += jaccard(texts[-1], " ".join(words)) >= 0.8
        texts.append(" ".join(words))
    apart = 160 - copies
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([*texts, "", None, "a b", "A  b"])], DOCS)
    left = near_dedup.deduplicated(df, similarity=0.8)
    assert copies > 60 and left.columns == df.columns
    assert abs(left.count() - (apart + 2)) <= 1
    assert near_dedup.deduplicated(df).count() > apart + 40
    kept = {r.doc_id for r in left.collect()}
    assert set(range(0, 160, 2)) <= kept


def test_op8_repeated_ids_with_unequal_texts(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(200)) for k in "ab")
    rows = [(1, a, "en", "s", 0), (2, a, "en", "s", 0), (1, b, "en", "s", 0), (3, b, "en", "s", 0), (None, a, "en", "s", 0), (None, "c c", "en", "s", 0), (None, "c c", "en", "s", 0), (None, "d d", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    for options in ({}, {"similarity": 0.8}):
        got = near_dedup.deduplicated(df, **options).collect()
        assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, a), (1, b), (0, "c c"), (0, "d d")])
    c = " ".join(f"c{i}" for i in range(200))
    df = spark.createDataFrame([(1, a, "en", "s", 0), (2, a, "en", "s", 0), (0, b, "en", "s", 0), (1, b, "en", "s", 0), (4, c, "en", "s", 0)], DOCS)
    assert sorted((r.doc_id, r.text) for r in near_dedup.deduplicated(df, similarity=0.8).collect()) == sorted([(1, a), (0, b), (4, c)])


def test_op8_stage_links_by_fingerprints_and_by_runs_of_words(spark):
    draw = random.Random(8)
    words = [f"w{draw.randrange(5000)}" for _ in range(400)]
    first, tail = " ".join(words), " ".join(f"t{i}" for i in range(90))
    # far in sets of runs of words but near in fingerprint: a passage repeated so often that it outvotes the rest
    passage = "same words again " * 400
    one, two = (passage + " ".join(f"{k}{i}" for i in range(5)) for k in "xy")
    assert (near_dedup.simhash(one) ^ near_dedup.simhash(two)).bit_count() <= 2 and jaccard(one, two) < 0.8
    # near in words but far in fingerprint
    three = first + " " + tail
    assert (near_dedup.simhash(three) ^ near_dedup.simhash(first)).bit_count() > 2 and jaccard(first, three) >= 0.8
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([one, two, first, three, first, "alone here"])], DOCS)
    assert sorted(r.doc_id for r in near_dedup.deduplicated(df, similarity=0.8).collect()) == [0, 2, 5]
    assert sorted(r.doc_id for r in near_dedup.deduplicated(df).collect()) == [0, 2, 3, 5]


def families(draw, n):
    """A template with a few words drawn anew in every text, so that similarities lie around the bound, and chains of edits."""
    base = [f"t{draw.randrange(4000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for at in draw.sample(range(120), 3):
            words[at] = f"n{draw.randrange(10**6)}"
        out.append(" ".join(words))
    words = list(base)
    for step in range(n // 4):
        words[step * 3 % 120] = f"c{step}"
        out.append(" ".join(words))
    return out


def components(texts, similarity=0.8):
    sets, root = [set(near_dedup.shingles(t, 5).tolist()) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if root[i] != root[j] and both >= similarity * (len(a) + len(sets[j]) - both):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return root


@pytest.mark.parametrize("band, text", [(near_dedup.BAND_PART, near_dedup.TEXT_PART), (40, 20_000)])
def test_op8_stage_on_templates_equals_all_pairs(spark, monkeypatch, band, text):
    monkeypatch.setattr(near_dedup, "BAND_PART", band)
    monkeypatch.setattr(near_dedup, "TEXT_PART", text)
    draw = random.Random(11)
    texts = families(draw, 120) + families(draw, 60) + [" ".join(f"u{draw.randrange(9999)}" for _ in range(50)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components(texts)
    got = [r.component_id for r in near_dedup.similar_classes(df).orderBy("doc_id").collect()]
    assert 2 < len(set(want)) < len(texts) - 50 and got == want


def test_op8_linked_passes_over_no_link():
    draw = np.random.default_rng(2)
    near = np.triu(draw.random((200, 200)) < 0.006, 1)
    near |= near.T
    want = np.arange(200)
    for i, j in zip(*np.nonzero(near)):
        near_dedup.unite(want, np.array([i]), np.array([j]))
    got = np.arange(200)
    for i, j in near_dedup.linked(200, lambda i, others: near[i, others]):
        near_dedup.unite(got, np.array([i]), np.array([j]))
    assert (got == want).all()


def test_op8_filter_lets_all_keys_pass_and_few_others(spark):
    rows = spark.range(5000).selectExpr("md5(cast(id as string)) AS key", "id", "'x' AS text")
    keys = rows.filter("id % 50 = 0").select("key")
    few = near_dedup.among(rows, keys)
    assert few.columns == rows.columns and keys.exceptAll(few.select("key")).isEmpty() and few.count() < 110
    crowded = near_dedup.among(rows, keys, 1 << 9)
    assert keys.exceptAll(crowded.select("key")).isEmpty() and 100 < crowded.count() < 5000
    assert near_dedup.among(rows, keys.limit(0)).isEmpty()
