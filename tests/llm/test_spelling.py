"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from nichegraph.llm import shared, spelling

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    n, near, form = Counter(), defaultdict(set), {}
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            n[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 31 == 0 else r] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    wild = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            wild[k, w[:k] + w[k + 1 :]].add(w)
            if (x := w[:k] + w[k + 1 :]) in n:
                near[w].add(x)
                near[x].add(w)
    for v in wild.values():
        for a in v:
            near[a] |= v - {a}
    for w in n:
        if near[w] and n[b := min(near[w], key=lambda x: (-n[x], x))] >= 10 * n[w]:
            form[w] = b
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append(str((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)))
    return sorted(out)


def got(df, **k):
    return sorted(str(tuple(r)) for r in spelling.variants(df, **k).collect())


@pytest.mark.parametrize("part", [spelling.PART, 20])
def test_equals_brute_force(spark, part):
    t = shared.table(spark, "/root/testdata/sf0.001", "documents")
    assert got(t, part=part) == brute([tuple(r) for r in t.select("doc_id", "text").collect()])


def test_chains_ties_and_odd_rows(spark):
    words = {"abcdefghij": 1200, "abcdefghi": 110, "abcdefgh": 10, "bbcdefgh": 9, "ÀÉßäÿñü×÷": 40, "ÀÉßäÿñü×": 3, "qabcdefghij": 1200, "aaaaaaaaaa": 5, "aaaaaaaaa": 50, "zwanzig": 30, "zwanzih": 30, "zwanzik": 3, "x" * 30_000: 2, "x" * 29_999 + "y": 2}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(words.items())]
    rows += [(None, "Nothing nothing NOTHING, nothinG"), (100, None), (101, ""), (102, "1234567 _ ..."), (7, "zwanzig\nzwanzig"), (7, "zwanzig\nzwanzig")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS word", "doc_id AS n", "text AS block")
    want = brute(rows)
    assert got(df) == want == got(df, part=2)
    assert any("'abcdefghij', 10" in x or "'abcdefgh', 'abcdefghi', 'abcdefghij'" in x for x in want)  # a chain of two steps


def test_near_equals_edits_of_all_pairs():
    draw = np.random.default_rng(3)
    for size, other in ((7, 7), (7, 8), (1, 2)):
        a, b = (["".join(draw.choice(list("abÿ"), n)) for _ in range(60)] for n in (size, other))
        i, j = spelling.near(spelling._codes("".join(a), 60), spelling._codes("".join(b), 60), False)
        edits = lambda x, y: sum(p != q for p, q in zip(x, y)) == 1 if len(x) == len(y) else any(y[:k] + y[k + 1 :] == x for k in range(len(y)))
        assert set(zip(i.tolist(), j.tolist())) == {(p, q) for p in range(60) for q in range(60) if edits(a[p], b[q])}


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
