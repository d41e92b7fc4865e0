"""The corpus operators as registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_search, bpe_trie, decontamination, fingerprints, interpolated_lm, mixing, near_dedup, prefix_trie, quality_rules, secret_scan, spelling, toxicity, warc
from .shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": lambda s, d: fingerprints.fingerprints(table(s, d, "documents")),
    "op2_warc": lambda s, d: warc.round_trip(table(s, d, "pages")),
    "op3_interpolated_lm": lambda s, d: interpolated_lm.scored(table(s, d, "documents")),
    "op4_mixing": lambda s, d: mixing.calibrated(table(s, d, "documents")),
    "op5_toxicity": lambda s, d: toxicity.scored(table(s, d, "documents"), table(s, d, "labels")),
    "op6_quality_rules": lambda s, d: quality_rules.scored(table(s, d, "documents"), table(s, d, "labels")),
    "op7_bpe_trie": lambda s, d: bpe_trie.digests(table(s, d, "documents")),
    "op8_near_dedup": lambda s, d: near_dedup.classes(table(s, d, "documents")).drop("root"),
    "op9_ann_search": lambda s, d: ann_search.neighbours(table(s, d, "embeddings")),
    "op10_secret_scan": lambda s, d: secret_scan.scan(table(s, d, "documents")),
    "op11_prefix_trie": lambda s, d: prefix_trie.trie(table(s, d, "conversations")),
    "op12_spelling": lambda s, d: spelling.variants(table(s, d, "documents")),
    "op13_decontamination": lambda s, d: decontamination.contamination(table(s, d, "documents"), table(s, d, "benchmark")),
}

#: CRC-32 of a list of bytes, by the table of its 256 remainders; DuckDB has no such function.
_CRC_TABLE = "SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))"


def _crc(table: str, text: str) -> str:
    """CRC-32 of the text's UTF-8, by that table."""
    x = f"hex(encode({text}))"
    bytes_of = f"list_transform(range(length({x}) // 2), lambda i: CAST(concat('0x', substr({x}, 2 * i + 1, 2)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_of}), lambda c, b: xor({table}[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"

#: The others can't be said in SQL (64-bit XXH64, places of pattern matches, iterated fits, tokenizers, approximate
#: search); tests hold them against brute force, held-out labels or a library.
ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
             o AS (SELECT d, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN original END AS refers_to
        FROM p LEFT JOIN o USING (d)
    """,
    "op11_prefix_trie": f"""
        WITH tab AS ({_CRC_TABLE}), own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
             ids AS (SELECT c, {_crc('t', 'CAST(c AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT conv_id AS c FROM own), tab),
             heads AS (SELECT c, i, role, text FROM ids JOIN own ON conv_id = c - c % 20 WHERE i <= h), tails AS (SELECT c, i, role, text FROM ids JOIN own ON conv_id = c WHERE i > h),
             every AS (SELECT c, i, role, text, 0 AS part FROM heads UNION ALL SELECT c, i, role, text, 1 FROM tails),
             turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, md5(concat(length(role), ':', role, text)) AS m, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM every),
             prefixes AS (SELECT c, d, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS p, w FROM turns UNION ALL SELECT c, 0, '', 0 FROM ids),
             sizes AS (SELECT c, max(d) AS depth FROM prefixes GROUP BY c),
             nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = d), '')) AS ends_sha256 FROM prefixes JOIN sizes USING (c) GROUP BY p, d),
             kids AS (SELECT substr(p, 1, 32 * (d - 1)) AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
             up AS (SELECT nodes.p AS own, substr(nodes.p, 1, 32 * CAST(j AS BIGINT)) AS p, (n_convs - 1) * w AS saved, CAST(kids.n IS NULL AS INT) AS leaf FROM nodes LEFT JOIN kids ON kids.p = nodes.p CROSS JOIN LATERAL (SELECT unnest(range(d + 1)) AS j)),
             sums AS (SELECT p, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY p)
        SELECT nodes.conv_id, nodes.d AS depth, parent.conv_id AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, nodes.ends_sha256
        FROM nodes JOIN sums ON sums.p = nodes.p LEFT JOIN kids ON kids.p = nodes.p LEFT JOIN nodes parent ON nodes.d > 0 AND parent.p = substr(nodes.p, 1, 32 * (nodes.d - 1))
    """,
    "op12_spelling": f"""
        WITH RECURSIVE tab AS ({_CRC_TABLE}), runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
             seen AS (SELECT w, doc_id, count(*) AS n FROM runs GROUP BY ALL), hashed AS (SELECT w, n, {_crc('t', "concat(doc_id, ':', w)")} AS h FROM seen, tab),
             words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS word, n FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
             cuts AS (SELECT word, n, unnest(range(length(word))) AS i FROM words), wild AS (SELECT word, n, i, concat(substr(word, 1, i), substr(word, i + 2)) AS v FROM cuts),
             longer AS (SELECT DISTINCT wild.word AS a, words.word AS b, wild.n AS na, words.n AS nb FROM wild JOIN words ON words.word = v),
             near AS (SELECT a, b, nb FROM longer UNION ALL SELECT b, a, na FROM longer UNION ALL SELECT x.word, y.word, y.n FROM wild x JOIN wild y ON x.i = y.i AND x.v = y.v AND x.word <> y.word),
             best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-nb, b)) AS b, max(nb) AS nb FROM near GROUP BY a),
             formed AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN nb >= 10 * n THEN b END AS form, CASE WHEN nb >= 10 * n THEN nb END AS form_n FROM words LEFT JOIN best USING (word)),
             chain AS (SELECT word, form AS root FROM formed WHERE form IS NOT NULL UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NOT NULL),
             ends AS (SELECT chain.word, root FROM chain JOIN formed ON formed.word = root WHERE form IS NULL)
        SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends USING (word)
    """,
    "op13_decontamination": """
        WITH every AS (SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM benchmark),
             lists AS (SELECT kind, r, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM every),
             starts AS (SELECT r, id, w, least(10, len(w)) AS size, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM lists WHERE kind = 'i' AND len(w) > 0),
             asked AS (SELECT DISTINCT coalesce(CAST(id AS VARCHAR), '') AS item, size, array_to_string(w[i + 1:i + size], ' ') AS v FROM starts), sizes AS (SELECT DISTINCT size FROM asked),
             here AS (SELECT r, size, i, array_to_string(w[i + 1:i + size], ' ') AS v FROM (SELECT r, w, size, unnest(range(len(w) - size + 1)) AS i FROM lists, sizes WHERE kind = 'd' AND len(w) >= size)),
             hits AS (SELECT r, i, size, item FROM here JOIN asked USING (size, v)),
             words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r), items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
        SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM lists LEFT JOIN words USING (r) LEFT JOIN items USING (r) WHERE kind = 'd'
    """,
}
# a payload below 1000 bytes has no original, as equal digests have equal lengths
