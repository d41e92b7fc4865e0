"""Stages on columns whose names they use themselves, and the pipeline against a plain version of it."""

import hashlib
import re
import struct
from collections import Counter, defaultdict

import xxhash

import corpus_pipeline
from nichegraph.llm import bpe_trie, mixing, near_dedup, quality_rules, shared

from .test_secret_stretches import plain_spans

SF = "/root/testdata/sf0.001"
NAMES = ["code", "spans", "base_spans", "more_spans", "weight", "_s", "_draw", "_topic", "_weight", "_tokens", "_probability", "_short", "_row", "_code", "_key", "_id", "key", "root", "signature"]


def test_pipeline_keeps_columns_of_any_name(spark):
    docs = shared.table(spark, SF, "documents").limit(40)
    for c in NAMES:
        docs = docs.withColumn(c, docs.doc_id.cast("string"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert rows and all(r[c] == str(r.doc_id) for r in rows for c in NAMES), name


def redacted(text):
    out, at = "", 0
    for a, _, b in plain_spans(text)[1]:
        out += text[at:a] + "[secret]" if a >= at else ""
        at = max(at, b)
    return out + text[at:]


def topic(t):
    n = len(t)
    for name, signs, least in (("markup", "<>{}[];", 50), ("table", "|\t", 25), ("numbers", "0123456789", 10), ("list", "\n", 60)):
        if n and sum(map(t.count, signs)) * least > n:
            return name
    return "empty" if not n else "long" if n > 8000 else "prose"


def test_pipeline_equals_a_plain_one(spark):
    from tokenizers import Tokenizer

    source = shared.table(spark, SF, "documents")
    rules = quality_rules.trained(source, shared.table(spark, SF, "labels"))
    docs = []
    for r in source.collect():
        x = quality_rules.statistics_of(r.text)
        odds = rules.intercept + sum(w for parts, w in rules.rules if all((x[k] > t) == above for k, above, t in parts))
        docs += [(r.doc_id, r.text, r.source, r.lang)] if odds >= 0 else []
    sets, root = [set(near_dedup.shingles(d[1], 5).tolist()) for d in docs], list(range(len(docs)))
    codes = [near_dedup.simhash(d[1]) for d in docs]
    docs_of = sorted(range(len(docs)), key=lambda i: docs[i][0])
    for i in docs_of:
        for j in docs_of:
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and ((codes[i] ^ codes[j]).bit_count() <= 2 or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)):
                a, b = sorted((root[i], root[j]), key=lambda k: docs[k][0])
                root = [a if x == b else x for x in root]
    docs = [(d, redacted(t), s or "", g or "") for i, (d, t, s, g) in enumerate(docs) if root[i] == i]
    keys = [(s, g, topic(t)) for _, t, s, g in docs]
    tokens = Counter()
    for k, d in zip(keys, docs):
        tokens[k] += len(re.findall(shared.WORD, d[1]))
    weight, total = {k: float(n) for k, n in tokens.items()}, sum(tokens.values())
    targets = []
    for i, temper in enumerate(mixing.TEMPER.values()):
        sums = defaultdict(int)
        for k, n in tokens.items():
            sums[k[i]] += n
        targets.append({v: n**temper / sum(m**temper for m in sums.values()) for v, n in sums.items()})
    for _ in range(200):
        for i, target in enumerate(targets):
            sums = defaultdict(float)
            for k, w in weight.items():
                sums[k[i]] += w
            weight = {k: w * target[k[i]] / sums[k[i]] if sums[k[i]] else 0.0 for k, w in weight.items()}
    low, high = 0.0, 1e12
    for _ in range(200):
        c = (low + high) / 2
        stays = sum(n * min(1, c * weight[k] / n) for k, n in tokens.items() if n)
        low, high = (c, high) if stays < mixing.LEAST_SHARE * total else (low, c)
    c = max(high, 1 / max(weight[k] / n for k, n in tokens.items() if n))
    lib = Tokenizer.from_file(bpe_trie.default_path())
    lib.no_truncation()
    lib.no_padding()
    want, close = {}, set()
    for k, (d, t, _, _) in zip(keys, docs):
        p = min(1, c * weight[k] / tokens[k]) if tokens[k] else 1
        draw = (xxhash.xxh64_intdigest(struct.pack("<i", 17), xxhash.xxh64_intdigest(str(d), 42)) >> 11) / 2**53
        close |= {d} if abs(draw - p) < 1e-4 else set()
        if draw < p:
            ids = lib.encode(t, add_special_tokens=False).ids
            want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert len(close) < 3 and {d: v for d, v in got.items() if d not in close} == {d: v for d, v in want.items() if d not in close}
