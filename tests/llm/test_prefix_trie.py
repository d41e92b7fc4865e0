"""The prefix trie against a brute-force one, in one range and in many."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from nichegraph.llm import prefix_trie, shared

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    whole, nodes, kids, leaves, saved = {}, defaultdict(list), Counter(), Counter(), Counter()
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
        for d in range(len(whole[c]) + 1):
            nodes[tuple(whole[c][:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, v in nodes.items():
        s = (len(v) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += s
            leaves[k[:d]] += kids[k] == 0
    ends = lambda k, v: hashlib.sha256(",".join(map(str, sorted(c for c in v if len(whole[c]) == len(k)))).encode()).hexdigest()
    return sorted(str((min(v), len(k), min(nodes[k[:-1]]) if k else None, len(v), kids[k], leaves[k], saved[k], ends(k, v))) for k, v in nodes.items())


def got(df, **k):
    return sorted(str(tuple(r)) for r in prefix_trie.trie(df, **k).collect())


@pytest.mark.parametrize("range_turns", [prefix_trie.RANGE_TURNS, 40])
def test_equals_brute_force(spark, range_turns):
    t = shared.table(spark, "/root/testdata/sf0.001", "conversations")
    assert got(t, range_turns=range_turns) == brute([tuple(r) for r in t.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("range_turns", [prefix_trie.RANGE_TURNS, 30])
def test_odd_rows(spark, range_turns, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 3)  # lists of ids are hashed over several stretches
    rows = [(c, t, "user", f"turn {t} of all") for c in range(100, 190) for t in range(4)]  # a hot conversation
    rows += [(7, t, None, None) for t in range(90)] + [(7, None, "a", "first"), (8, 0, "", ""), (9, 0, "u", "x" * 100_000), (None, 1, "u", "nobody's")]
    rows += [(200, 0, "u", "one"), (201, 0, "u", "alone"), (215, 1, "u", "one"), (215, 1, "u", "one"), (-3, 0, "u", "below"), (-20, 5, "u", "zero")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "text AS path", "role AS words", "turn AS depth", "text AS key")
    want = brute(rows)
    assert got(df, range_turns=range_turns) == want
    assert max(int(x.split(", ")[1]) for x in want) > 80


def test_family_without_its_first(spark):
    rows = [(25, 0, "u", "a"), (25, 1, "u", "b"), (26, 0, "u", "c")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_table(spark):
    out = prefix_trie.trie(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"] and out.count() == 0
