"""Each document's next one and both fingerprints against plain code, with outlying, null and repeated ids."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nichegraph.llm import fingerprints

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def signed_hash(t):
    h = xxhash.xxh64_intdigest(t.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def plain(t):
    votes = np.zeros(64, dtype=np.int64)
    for w in re.findall(r"[^\W_]+", t.lower()):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        votes += [len(w) if h >> b & 1 else -len(w) for b in range(64)]
    return sum(1 << b for b in range(64) if votes[b] > 0)


def tables():
    text = lambda i: " ".join(f"w{(i * 7 + j) % 90}" for j in range(i % 30))
    even = [(i * 3, text(i)) for i in range(300)]
    return {
        "outlier": [*even, (2**62, "last one of all"), (-(2**61), "first")],
        "null ids": [*even[:40], *((None, f"null {i} {text(i)}") for i in range(300))],
        "one id": [*even[:40], *((30, f"same {i} {text(i)}") for i in range(300)), (31, "next")],
        "one row": [(5, "a b c d")],
        "no ids": [(None, "a b"), (None, None)],
    }


@pytest.mark.parametrize("name", tables())
def test_op1_next_texts_and_fingerprints(spark, monkeypatch, name):
    monkeypatch.setattr(fingerprints, "RUN", 8)
    rows = [(d, t or "") for d, t in tables()[name]]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in tables()[name]], DOCS)
    sizes = [r["count"] for r in fingerprints.run_of(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).groupBy("run").count().collect()]
    assert max(sizes) <= 60 and sum(sizes) == len(rows)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, signed_hash(r[1]), r[1]))
    want = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(t) // 2
        edited = t[: len(t) - k] + after[:k]
        a, b, c = plain(t), plain(edited), plain(after)
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", 1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprints.fingerprints(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
