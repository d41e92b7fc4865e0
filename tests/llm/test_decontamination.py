"""Benchmark passages by the positional index against brute force: windows, proximity, odd rows."""

import hashlib
import re
from collections import defaultdict

import pytest

from nichegraph.llm import decontamination, shared

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, found = words(t), set()
        hit = [0] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    found |= x
                    hit[k : k + n] = [1] * n
        out.append(str((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0)))
    return sorted(out)


def got(docs, items):
    return sorted(str(tuple(r)) for r in decontamination.contamination(docs, items).collect())


def test_equals_brute_force(spark):
    docs, items = (shared.table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "benchmark"))
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert got(docs, items) == want and any("True" in x for x in want)


def odd(spark):
    p = "one two three four five six seven eight nine ten eleven twelve".split()
    docs = [
        (1, " ".join(p)), (1, " ".join(p)), (2, "Zero, " + " - ".join(p[:10]).upper() + "!"), (3, " ".join(p[:9])), (4, None), (5, ""), (6, "..., __ \x00"), (None, " ".join(p[2:] + p)),
        (7, "a b c a b c a b c"), (8, "ÉTÉ étÉ Été"), (9, "x " * 50_000 + " ".join(p)), (10, " ".join(reversed(p))), (11, "one two"), (12, "three four five six seven eight nine ten"),
    ]
    items = [(10, " ".join(p)), (9, " ".join(p)), (100, "a b c a"), (5, None), (6, " ... "), (None, "ÉtÉ"), (7, "words that no document has at all, so many of them here"), (8, "x x x x x x x x x x x x")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "text AS term", "doc_id AS n", "text AS block"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "text AS words", "text AS term")


@pytest.mark.parametrize("block, turn", [(decontamination.BLOCK_WORDS, decontamination.ITEM_WORDS), (30, 12)])
def test_odd_rows_blocks_and_turns(spark, monkeypatch, block, turn):
    monkeypatch.setattr(decontamination.index, "__defaults__", (block,))
    monkeypatch.setattr(decontamination.matches, "__defaults__", (10, None, turn))
    docs, items, d, i = odd(spark)
    assert got(d, i) == brute(docs, items)


def test_empty_tables(spark):
    docs, items, d, i = odd(spark)
    assert got(d.limit(0), i) == [] and got(d, i.limit(0)) == brute(docs, [])


def test_one_index_serves_phrases_and_proximity(spark):
    docs = [(1, "red green blue"), (2, "blue x green y red"), (3, "red x x x x green blue"), (4, "red red green"), (5, "green blue"), (6, "blue green x x red blue green")]
    indexed = decontamination.index(spark.createDataFrame(docs, "doc_id long, text string"))
    items = spark.createDataFrame([("p", "Red, green. Blue")], "item_id string, text string")
    ids = decontamination.documents_of(indexed)

    def found(span):
        return sorted(tuple(r) for r in decontamination.matches(indexed, items, span=span).join(ids, ["block", "doc"]).select("doc_id", "begin", "end").collect())

    assert found(None) == [(1, 0, 3)]
    assert found(3) == [(1, 0, 3), (6, 4, 7)]
    assert found(5) == [(1, 0, 3), (2, 0, 5), (6, 0, 7)]
    assert [x[0] for x in found(7)] == [1, 2, 3, 6]
    with pytest.raises(ValueError):
        decontamination.matches(indexed, items, span=65)
