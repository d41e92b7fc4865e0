"""Archives of very long pages, beside columns whose names the operator uses itself."""

import hashlib

from nichegraph.llm import warc


def test_op2_long_pages_and_clashing_columns(spark):
    long = "<p>Ünïcode 😀 text</p>\n" * 200_000
    rows = [(1, "u1", long), (2, "u2", long), (3, "u3", long[:-1]), (4, "u4", None), (5, None, ""), (6, "u6", "x" * 999), (7, "u7", "x" * 999)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url AS digest", "page_id AS refers_to", "html AS payload", "url AS record_type", "page_id AS original")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        assert (got[page_id].payload_bytes, got[page_id].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), **{k: ("response", None) for k in range(2, 8)}}
