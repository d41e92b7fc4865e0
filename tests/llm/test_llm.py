"""Corpus operators against brute force, libraries and held-out labels, and on degenerate tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from nichegraph.llm import bpe_trie, fingerprints, interpolated_lm, mixing, near_dedup, quality_rules, secret_scan, shared, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def rows_of(texts, start=0):
    return [(start + i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, signs beyond the BMP, extra columns with clashing names."""
    texts = ["", None, " \t\n", "one", "two words", "İstanbul ΣΑΣ 😀 é " * 5, "word " * 60_000, "AKIA" + "A1B2C3D4E5F6G7H8" + " token = 'abc123def456'", "same text here now", "same text here now"]
    rows = [*rows_of(texts), (3, "one", "en", "s0", 3), (None, "without id", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("code", "score", "label", "run", "batch", "tokens", "spans", "weight", "_s", "_draw", "root", "base_spans", "more_spans", "_source", "_cell_source"):
        df = df.withColumn(c, df.doc_id.cast("string"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return shared.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None), (0, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda d, l: fingerprints.fingerprints(d),
    "op3": lambda d, l: interpolated_lm.scored(d),
    "op4": lambda d, l: mixing.calibrated(d),
    "op5": lambda d, l: toxicity.scored(d, l),
    "op6": lambda d, l: quality_rules.scored(d, l),
    "op7": lambda d, l: bpe_trie.digests(d),
    "op8": lambda d, l: near_dedup.classes(d),
    "op10": lambda d, l: secret_scan.scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(odd, labels, name):
    out = OPERATORS[name](odd, labels)
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    if "score" in out.columns and name != "op3":
        assert all(0 <= r.score <= 1 for r in got)
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).count() == 0


def test_stages_on_odd_and_empty_tables(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, odd.limit(0)):
            out = stage(spark, df, SF)
            assert out.count() <= df.count()
            if name != "tokens":
                assert out.columns == df.columns


def test_op1_edits_votes_and_search(docs):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(text)

    def brute(t):
        votes = np.zeros(64, dtype=np.int64)
        for w in re.findall(r"[^\W_]+", t.lower()):
            h = xxhash.xxh64_intdigest(w.encode(), 42)
            votes += [len(w) if h >> b & 1 else -len(w) for b in range(64)]
        return sum(1 << b for b in range(64) if votes[b] > 0)

    for i, d in enumerate(ids):
        t, after = text[d], text[ids[(i + 1) % len(ids)]]
        k = len(t) // 2
        edited = t[: len(t) - k] + after[:k]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if t.isascii() and i % 5 == 0:
            assert int(r.fingerprint, 16) == brute(t)
        assert r.near_next == 1 - (int(r.fingerprint, 16) ^ int(got[ids[(i + 1) % len(ids)]].fingerprint, 16)).bit_count() / 64
    codes = [int(r.fingerprint, 16) for r in got.values()]
    for d in ids:
        if d % 50 == 0:
            assert got[d].near_docs == sum((int(got[d].fingerprint, 16) ^ c).bit_count() <= 3 for c in codes) - 1


def test_op1_block_tables_lose_nothing(spark):
    draw = random.Random(4)
    base = [draw.getrandbits(64) for _ in range(40)]
    codes = {b ^ sum(1 << x for x in draw.sample(range(64), n)) for b in base for n in range(5)}
    sign = lambda c: c - (1 << 64) if c >> 63 else c
    df = spark.createDataFrame([(sign(c),) for c in codes], "code long")
    got = Counter((r.query % (1 << 64), r.code % (1 << 64)) for r in fingerprints.within_radius(df, df).collect())
    assert got == Counter((a, b) for a in codes for b in codes if (a ^ b).bit_count() <= 3)


def test_op2_round_trip(spark):
    big, small = "<p>é" * 400, "x" * 999
    pages = spark.createDataFrame([(1, "http://a", big), (2, "http://b\n", big), (3, None, big), (3, None, big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (None, "u", "y" * 2000)], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(1, 2000, sha(big), "revisit", 3), (2, 2000, sha(big), "revisit", 3), (3, 2000, sha(big), "response", None), (3, 2000, sha(big), "response", None), (4, 999, sha(small), "response", None), (5, 999, sha(small), "response", None), (6, 0, sha(""), "response", None), (7, 0, sha(""), "response", None), (None, 2000, sha("y" * 2000), "response", None)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0
    folder = shared.fresh_dir(spark, "warc")
    index = warc.write_archives(pages, folder)
    some = warc.read_records(index.filter("page_id = '4'"), folder).collect()
    assert [(r.url, bytes(r.payload)) for r in some] == [("u", small.encode())]


def test_op3_equals_an_independent_model(spark, docs, monkeypatch):
    monkeypatch.setattr(interpolated_lm, "BATCH_BYTES", 100_000)
    monkeypatch.setattr(interpolated_lm, "RANGE_BYTES", 150_000)
    again = docs.filter("doc_id % 9 = 0").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(again).union(again)
    got = interpolated_lm.scored(docs).collect()
    texts = [(r.doc_id, [*r.text.encode().lower().split(), None]) for r in docs.collect()]
    train = [t for d, t in texts if zlib.crc32(str(d).encode()) % 7 != 2]
    one, two = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([0, *t], t))
    context = Counter({**one, 0: len(train)})
    n, v = sum(one.values()), len(one)
    weights = np.full((32, 3), 1 / 3)
    for _ in range(interpolated_lm.ROUNDS):
        sums = np.zeros((32, 3)) + [1e-9, 1e-6, 1e-6]
        for t in train:
            for a, b in zip([0, *t], t):
                c = context[a] - 1
                k = min(31, int(math.log2(c + 1)))
                share = weights[k] * [(two[a, b] - 1) / c if c else 0, (one[b] - 1) / n, 1 / (v + 1)]
                sums[k] += share / share.sum()
        weights = sums / sums.sum(1, keepdims=True)
    want = {}
    for d, t in texts:
        score = 0.0
        for a, b in zip([0, *t], t):
            w = weights[min(31, int(math.log2(context[a] + 1)))]
            score += math.log10(w @ [two[a, b] / context[a] if context[a] else 0, one[b] / n, 1 / (v + 1)])
        want[d] = (len(t), sum(one[w] > 0 for w in t), n, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), score)
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in texts)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and abs(r.base_score - w[3]) < 1e-9 * w[0] and abs(r.score - w[4]) < 1e-9 * w[0]
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op4_raking_meets_targets(spark):
    draw = np.random.default_rng(2)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", int(draw.integers(1, 1000)), 1) for i in range(4) for j in range(3) for k in range(2)], "source string, lang string, topic string, tokens long, documents long")
    share = {"source": [0.1, 0.2, 0.3, 0.4], "lang": [0.5, 0.25, 0.25], "topic": [0.7, 0.3]}
    targets = {d: spark.createDataFrame([(f"{d[0]}{i}", p) for i, p in enumerate(ps)], "value string, share double") for d, ps in share.items()}
    got = mixing.rake(cells, targets).toPandas()
    w = got.tokens.to_numpy(float)
    for _ in range(200):
        for d, ps in share.items():
            for i, p in enumerate(ps):
                at = (got[d] == f"{d[0]}{i}").to_numpy()
                w[at] *= p / w[at].sum()
    assert np.allclose(got.weight, w, atol=1e-5)


def test_op4_sampling_is_calibrated(docs):
    got = mixing.calibrated(docs).toPandas()
    assert got.probability.max() == 1 and ((got.draw < got.probability) == got.kept).all()
    kept = mixing.mixed(docs).toPandas()
    assert sorted(kept.doc_id) == sorted(got.doc_id[got.kept])


def test_op4_a_rare_language_leaves_the_corpus(spark):
    rows = [(i, "word " * 100, "en" if i % 3 else "de", f"s{i % 2}", 500) for i in range(6000)]
    df = spark.createDataFrame([*rows, (6000, "word", None, "s0", 4)], DOCS)
    got = mixing.calibrated(df).toPandas()
    assert abs((got.probability * got.tokens).sum() / got.tokens.sum() - mixing.LEAST_SHARE) < 1e-6
    assert got.tokens[got.kept].sum() > 0.55 * got.tokens.sum()
    rare = got[got.lang == ""].iloc[0]
    assert rare.probability == 1 and rare.short == pytest.approx(rare.weight - 1 / (got.probability * got.tokens).sum()) and rare.short > 0
    rest = got[got.lang != ""]
    assert (rest.short == 0).all() and np.allclose(rest.probability / (rest.weight / rest.groupby(["source", "lang", "topic"]).tokens.transform("sum")), (rest.probability * rest.groupby(["source", "lang", "topic"]).tokens.transform("sum") / rest.weight).iloc[0])


def test_op5_op6_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = shared.table(spark, d, "documents"), shared.table(spark, d, "labels")
    known = labels.toPandas()
    q = quality_rules.scored(docs, labels).toPandas().merge(known, on="doc_id")
    t = toxicity.scored(docs, labels).toPandas().merge(known, on="doc_id")
    q, t = q[q.held_out], t[t.held_out]
    assert (q.predicted == q.quality).mean() > 0.95
    assert (t.predicted == t.toxic).mean() > 0.85 and t.predicted[t.toxic == 0].mean() < 0.02
    assert quality_rules.kept(docs, labels).count() == quality_rules.scored(docs, labels).filter("predicted = 1").count()


def test_op7_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe_trie.default_path())
    lib.no_truncation()
    lib.no_padding()
    draw = random.Random(8)
    texts = ["", "<|endoftext|>Hi<|startoftext|> <|endoftext|", "ΑΣΣ İ é é \u0085 　x", "it's 'RE don't 12345 ½²", "a" * 300, "!!!???", "日本語 😀👩‍👩‍👧"]
    texts += ["".join(draw.choice("abcdeinthlos ") for _ in range(200)) for _ in range(100)]
    df = spark.createDataFrame(rows_of(texts, 10**6), DOCS).union(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_trie.digests(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in df.collect():
        ids = lib.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


def test_op7_equals_the_library_on_characters_of_newer_tables():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe_trie.default_path())
    lib.no_truncation()
    lib.no_padding()
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0 or 0x1C80 <= c < 0x1C90 or 0xA7C0 <= c < 0xA800)]
    texts = [f"a{chr(c)}b1{chr(c)}" for c in codes]
    ours = bpe_trie.Vocabulary(bpe_trie.default_path()).encode(texts)
    theirs = lib.encode_batch(texts, add_special_tokens=False)
    assert not [hex(c) for c, a, b in zip(codes, ours, theirs) if a[0] != " ".join(map(str, b.ids))]


def test_op8_matches_brute_force(spark, monkeypatch):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        t = draw.choices(words, k=120)
        texts.append(" ".join(t))
        for _ in range(draw.randrange(4)):
            t[draw.randrange(len(t))] = draw.choice(words)
            texts.append(" ".join(t))
    df = spark.createDataFrame(rows_of([*texts, *texts[:10], "", None, "a b", "A\tb"]), DOCS)
    monkeypatch.setattr(near_dedup, "GROUP", 16)
    got = near_dedup.classes(df).collect()
    code = {r.doc_id: int(r.fingerprint, 16) for r in got}

    def brute(t):
        w = (t or "").lower().split()
        g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    assert all(code[r.doc_id] == brute(r.text) for r in df.collect())
    ids, root = sorted(code), {}
    for i in ids:
        root[i] = i
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (code[a] ^ code[b]).bit_count() <= 2 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert {r.doc_id: r.component_id for r in got} == root
    left = near_dedup.deduplicated(df)
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(root.values()))


@pytest.mark.parametrize("visitors", [16, 1])
def test_op8_links_of_many_groups(spark, monkeypatch, visitors):
    monkeypatch.setattr(near_dedup, "VISITORS", visitors)
    draw = random.Random(9)
    base = [draw.getrandbits(64) for _ in range(200)]
    codes = np.array(sorted({b ^ sum(1 << x for x in draw.sample(range(64), n)) for b in base for n in range(4)}), dtype=np.uint64)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long")
    want = np.arange(len(codes))
    for i, c in enumerate(codes):
        j = np.flatnonzero(np.bitwise_count(codes ^ c) <= 2)
        near_dedup.unite(want, np.full(len(j), i), j)
    found = {r.node: r.root for r in shared.components(near_dedup.near_links(df, 2, 32)).collect()}
    root = [found.get(int(c), int(c)) for c in codes.view(np.int64)]
    same = {}
    assert all(same.setdefault(a, b) == b for a, b in zip(want, root)) and len(set(same.values())) == len(same)


def test_op10_base_and_entropy(spark):
    texts = ["my PassWord: \"hunter22\" api-key apikey=abc12 api_key=ABCDEF", "AKIA" + "Z" * 15 + " AKIA" + "Q7" * 9, "ab" * 11 + " " + "0f" * 12 + "x", "😀 secret = 'αβγ' token:a.b-c/d+e", "key Zk3q9XvB7tLm2RwP8sYd4HnJ6c stays", "path/to/some/long/place/of/files and 123e4567-e89b-12d3-a456-426614174000", "aaaaaaaaaaaaaaaaaaaa1", None, ""]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows_of(texts), DOCS)).collect()}
    for i, t in enumerate(texts):
        found = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(secret_scan.KINDS.values()) for m in re.finditer(p, t or "", re.A) if len(m[g]) >= n]
        base = ",".join(f"{list(secret_scan.KINDS)[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(f[1] == k for f in found) for k in range(3))
    assert got[4].spans == "entropy:4:30" and got[5].spans == "" and got[6].spans == ""
    clean = secret_scan.redact(spark.createDataFrame(rows_of(texts[4:5]), DOCS)).first()
    assert clean.text == "key [secret] stays" and clean.n_chars == len(clean.text)


def test_op10_peak_entropy(spark):
    from pyspark.sql import functions as F

    draw = random.Random(1)
    values = ["".join(draw.choice("abcDEF0123") for _ in range(n)) for n in (1, 5, 20, 33, 70)]
    df = spark.createDataFrame([(v,) for v in values], "v string")

    def brute(v):
        parts = [v[i : i + 20] for i in range(max(1, len(v) - 19))]
        return max(-sum(n / len(p) * math.log2(n / len(p)) for n in Counter(p).values()) for p in parts)

    for r in df.select("v", secret_scan.peak_entropy(F.col("v")).alias("h")).collect():
        assert r.h == pytest.approx(brute(r.v))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (7, 9), (5, 5), (None, 4), (20, 19), (19, 18), (18, 17), (3, 17)]
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 17: 1, 18: 1, 19: 1, 20: 1, 7: 7, 8: 7, 9: 7}


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < 200 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
