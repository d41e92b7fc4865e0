"""What workers of the pipeline hold, and the files that its small tables take."""

import glob
import random

import corpus_pipeline
from nichegraph.llm import bpe_trie, near_dedup, shared


def test_pipeline_tokens_hold_few_words_and_equal_op7(spark, monkeypatch):
    made = []
    digests = bpe_trie.digests
    monkeypatch.setattr(bpe_trie, "digests", lambda docs, *a, **b: made.append(b) or digests(docs, *a, **b))
    draw = random.Random(3)
    texts = [" ".join(f"{draw.choice('abcdef')}{draw.randrange(10**5)}x" for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate([*texts, "", None])), "doc_id long, text string")
    got = corpus_pipeline.tokens(spark, df, "").orderBy("doc_id").collect()
    assert got == digests(df).orderBy("doc_id").collect() == digests(df, kept_chars=500, chars=300).orderBy("doc_id").collect()
    assert made[0]["kept_chars"] <= 10_000_000 and made[0]["chars"] <= 1_000_000
    small, large = bpe_trie.Vocabulary(bpe_trie.default_path(), 2000), bpe_trie.Vocabulary(bpe_trie.default_path())
    for t in texts:
        assert list(small.encode([t])) == list(large.encode([t]))
        assert small.held <= 2000 + 3 * 60 * 70
    assert len(small.known) < len(large.known) / 5


def test_pipeline_small_tables_take_few_files(spark, tmp_path, monkeypatch):
    folders = iter(range(1000))
    monkeypatch.setattr(shared, "fresh_dir", lambda spark, kind: f"file://{tmp_path}/{next(folders)}")
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = spark.range(3000).selectExpr("id AS a", "id + 1 AS b").filter("a % 10 <> 9")
        got = {r.node: r.root for r in shared.components(links).collect()}
        assert got == {i: i - i % 10 for i in range(3000)}
        files = [len(glob.glob(f"{d}/part-*.parquet")) for d in sorted(tmp_path.iterdir(), key=lambda d: int(d.name))]
        assert files[0] > 40 and len(files) > 2 and max(files[1:]) == 1
        done = len(files)
        base = " ".join(f"w{i}" for i in range(100))
        df = spark.createDataFrame([(i, f"{base} e{i}" if i < 30 else " ".join(f"u{i}_{k}" for k in range(9))) for i in range(90)], "doc_id long, text string").repartition(3)
        left = near_dedup.deduplicated(df, similarity=0.8)
        assert sorted(r.doc_id for r in left.collect()) == [0, *range(30, 90)]
        tables = [len(glob.glob(f"{d}/part-*.parquet")) for d in tmp_path.iterdir() if int(d.name) >= done]
        assert len(tables) > 10 and sum(n > 3 for n in tables) <= 4
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_pipeline_written_keeps_all_rows_whatever_the_hint(spark):
    rows = spark.range(1000).repartition(8)
    for hint in (None, 0, 1, 10, 10**9):
        back = shared.written(rows, rows=hint, rows_a_file=100)
        assert back.count() == 1000 and back.distinct().count() == 1000
