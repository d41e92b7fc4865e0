"""Document fingerprints: weighted SimHash, and permuted block tables for search by Hamming radius. Native.

A text's terms are its maximal runs of letters and digits in lower case. Each occurrence votes with the
term's length as weight on 64 signed bits of the term's XXH64; a bit is set where the votes for it outweigh
those against. Two bits share a 64-bit counter, 32 bits each, which no text can overflow: the weights sum
to at most its length.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import combinations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

RADIUS, BLOCKS = 3, 5
#: Mean number of documents that are ordered together; stretches of ids, even in rows, that are cut to runs.
RUN, MOST_STRETCHES = 256, 10_000


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def term_votes(bodies: DataFrame, keys: list[str], body: str) -> DataFrame:
    """One row of keys and fingerprint (long) per combination of keys, over all terms of its bodies.

    Empty bodies have fingerprint 0; equal bodies have equal ones. The sums are partial before any shuffle.
    """
    terms = bodies.select(*keys, F.explode(F.split(F.lower(F.col(body)), r"[^\p{L}\p{N}]+")).alias("term"))
    hashed = terms.select(*keys, F.xxhash64("term").alias("h"), F.length("term").cast("long").alias("w"))
    pair = F.lit(0x100000001)
    votes = hashed.groupBy(*keys).agg(F.sum("w").alias("w"), *(F.sum(F.shiftrightunsigned("h", i).bitwiseAND(pair) * F.col("w")).alias(f"v{i}") for i in range(32)))
    total = F.col("w")
    bits = [F.when(F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > total, F.lit(1 << i)).otherwise(F.lit(0).cast("long")) for i in range(32)]
    bits += [F.when(F.shiftrightunsigned(f"v{i}", 32) * 2 > total, F.lit(_signed(1 << i + 32))).otherwise(F.lit(0).cast("long")) for i in range(32)]
    return votes.select(*keys, reduce(Column.bitwiseOR, bits).alias("fingerprint"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """A mask for each choice of blocks - radius of the blocks: codes within the radius agree under one of them."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("blocks must exceed radius")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [_signed(sum(c)) for c in combinations(parts, blocks - radius)]


def within_radius(queries: DataFrame, codes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (query, code, distance) of distinct fingerprints in column code of either side, within the radius.

    Each permuted table has the codes under its key, the blocks that it keeps; a query reads one key of each.
    A pair comes from the first table that has it only, so nothing is made distinct afterwards. Nulls take no
    part.
    """
    masks = block_masks(radius, blocks)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col("code").alias(name)).filter(F.col(name).isNotNull()).distinct()
        rows = F.array(*(F.struct(F.lit(i).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)))
        return one.select(name, F.inline(rows))

    q, c = keyed(queries, "query").alias("q"), keyed(codes, "found").alias("c")
    x = F.col("q.query").bitwiseXOR(F.col("c.found"))
    first = F.coalesce(*(F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)))
    on = (F.col("q.t") == F.col("c.t")) & (F.col("q.k") == F.col("c.k")) & (F.bit_count(x) <= radius) & (first == F.col("q.t"))
    return q.join(c, on).select("query", F.col("found").alias("code"), F.bit_count(x).alias("distance"))


def _next_run(runs: DataFrame) -> DataFrame:
    """(run, next): each run's successor in order, the first after the last. Two levels, so that no task orders all."""
    top = runs.select("run", F.floor(F.col("run") / 1024).alias("top"))
    firsts = top.groupBy("top").agg(F.min("run").alias("first"))
    w = Window.orderBy("top")
    firsts = firsts.select("top", F.lead("first").over(w).alias("after"), F.first("first").over(w).alias("start"))
    inner = top.select("*", F.lead("run").over(Window.partitionBy("top").orderBy("run")).alias("here"))
    return inner.join(firsts, "top").select("run", F.coalesce("here", "after", "start").alias("next"))


def run_of(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) with hash and run: numbers that ascend with (doc_id, hash), each of RUN rows in the mean.

    Quantiles of the ids cut them to stretches of as many rows each, whatever gaps and outliers the ids have; a
    stretch of more than a run is cut evenly between its ends. An id that fills stretches by itself, null among
    them, is cut by the hash of the text. Only rows equal in id and text can't be told apart.
    """
    rows = rows.withColumn("hash", F.xxhash64("text"))
    n, nulls, lowest, highest = rows.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id")).first()
    stretches = max(1, min(MOST_STRETCHES, n // RUN))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / stretches for i in range(stretches + 1)], 10 * max(1000, stretches))).first()[0] if n else []
    times = Counter([lowest, *cuts[1:-1], highest] if n else [])  # the ends of approximate quantiles may be off
    # ids from low up to but not including the next row's are cut to so many parts: by hash if they are one id, else evenly
    at, table, run = sorted(times), [], -(-nulls // RUN) if nulls else 0
    nulls_parts = max(1, run)
    for low, high in zip(at, [*at[1:], at[-1] + 1] if at else []):
        share = n / stretches / RUN
        parts = max(1, round((times[low] - 1) * share))
        table.append((float(low), run, parts, True, low, 1))
        run += parts
        if high > low + 1:
            parts = max(1, round(share))
            table.append((float(low + 1), run, parts, False, low + 1, high - low - 1))
            run += parts
    by_hash = lambda parts: F.least(F.floor((F.col("hash") / 2.0**64 + 0.5) * parts), parts - 1).cast("long")
    first = by_hash(F.lit(nulls_parts))
    if not table:
        return rows.withColumn("run", first)
    spark, bounds = rows.sparkSession, sorted({r[0] for r in table})
    last = {r[0]: r for r in table}  # ids beyond 2^53 may share a bound as a floating number: the later row has them
    rows = rows.withColumn("place", F.coalesce(F.col("doc_id").cast("double"), F.lit(bounds[0])))
    rows = Bucketizer(splits=[*bounds, float("inf")], inputCol="place", outputCol="of").transform(rows) if len(bounds) > 1 else rows.withColumn("of", F.lit(0.0))
    known = spark.createDataFrame([(float(i), *last[b][1:]) for i, b in enumerate(bounds)], "of double, first long, parts long, one boolean, low long, width long")
    rows = rows.join(F.broadcast(known), "of")  # twice MOST_STRETCHES rows at most
    evenly = F.greatest(F.least(F.floor((F.col("doc_id") - F.col("low")) / F.col("width") * F.col("parts")), F.col("parts") - 1), F.lit(0)).cast("long")
    run = F.col("first") + F.when(F.col("one"), by_hash(F.col("parts"))).otherwise(evenly)
    return rows.select("doc_id", "text", "hash", F.when(F.col("doc_id").isNull(), first).otherwise(run).alias("run"))


def with_next(docs: DataFrame) -> DataFrame:
    """(run, place, doc_id, text, next_text, last): each document with the text of the next in ascending doc_id.

    After the last comes the first; null ids come before all others; equal ids are ordered by the hash of the
    text. Documents are dealt by run_of(), and each run is ordered by itself. The first text of each run, one
    in RUN, goes to the run before.
    """
    order = Window.partitionBy("run").orderBy(F.col("doc_id").asc_nulls_first(), "hash", "text")
    rows = run_of(shared.texts(docs)).select("run", F.row_number().over(order).alias("place"), "doc_id", "text", F.lead("text").over(order).alias("follows"))
    heads = rows.filter("place = 1").select(F.col("run").alias("next"), F.col("text").alias("head"))
    heads = _next_run(rows.select("run").distinct()).join(heads, "next").select("run", "head")
    return rows.join(heads, "run", "left").select("run", "place", "doc_id", "text", F.coalesce("follows", "head").alias("next_text"), F.col("follows").isNull().alias("last"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, code, edited_code, next_code): one row per row of docs."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("next_text").substr(F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    bodies = [F.col("text"), F.col("edited"), F.when(F.col("last"), F.col("next_text")).otherwise("")]
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), b.alias("body")) for k, b in enumerate(bodies)))
    keys = ["run", "place", "doc_id", "n_chars", "edited_sha256"]
    codes = term_votes(rows.select(*keys, F.inline(kinds)), [*keys, "kind"], "body")
    one = codes.groupBy(*keys).agg(*(F.max(F.when(F.col("kind") == k, F.col("fingerprint"))).alias(c) for k, c in enumerate(["code", "edited_code", "head_code"])))
    order = Window.partitionBy("run").orderBy("place")
    return one.select("doc_id", "n_chars", "edited_sha256", "code", "edited_code", F.coalesce(F.lead("code").over(order), "head_code").alias("next_code"))


def fingerprints(docs: DataFrame, radius: int = RADIUS, every: int = 50) -> DataFrame:
    """The fingerprint of each document and of its edited text, and their likeness 1 - distance / 64.

    near_docs: for the query documents, whose id is divisible by `every`, how many other documents have a
    fingerprint within the radius; null for the rest.
    """
    rows = shared.written(edited_fingerprints(docs))
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    counts = rows.groupBy("code").agg(F.count("*").alias("n"))
    found = within_radius(rows.filter(asks).select("code"), counts.select("code"), radius)
    near = found.join(counts, "code").groupBy("query").agg(F.sum("n").alias("n"))
    near = near.select(F.lit(True).alias("asks"), F.col("query").alias("key"), "n")
    rows = rows.select("*", asks.alias("asks"), F.when(asks, F.col("code")).otherwise(F.col("doc_id")).alias("key"))
    likeness = lambda c: (1 - distance(F.col("code"), F.col(c)) / 64.0).cast("double")
    text = lambda c: F.lower(F.lpad(F.hex(F.col(c)), 16, "0"))
    return rows.join(near, ["asks", "key"], "left").select(
        "doc_id", "n_chars", "edited_sha256", text("code").alias("fingerprint"), text("edited_code").alias("edited_fingerprint"), likeness("edited_code").alias("near_edited"), likeness("next_code").alias("near_next"), (F.col("n") - 1).alias("near_docs")
    )
