"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: signs of a learned rotation of the centred vectors, BITS bits. A code's bytes are substrings, each with
an index of its own. Codes within a Hamming radius r of a query agree with it in some byte up to r // BYTES
bits, so probing those bytes finds every one of them. What lies within the radius is ranked by its true
distance. Mean and rotation are fitted on a bounded sample; all vectors are indexed. The radius comes from the
true neighbours, among all vectors, of a bounded sample of them, so it narrows as the table grows.

Equal vectors are one entry with their smallest ids, of which a result has no more than k. Indexes and probes
carry codes alone; vectors are joined to the pairs found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BITS, BYTES, WORDS = 256, 32, 4
#: Vectors that the codes are fitted on at most, and those that the radius is; share of the latter whose k neighbours all lie within it.
SAMPLE, PROBED, TAKES_IN, ROUNDS = 4000, 200, 0.95, 30
#: Entries of an index block or a tile, queries that meet one, and those that are compared at once.
BLOCK, QUERY_BLOCK, AT_ONCE = 20_000, 20_000, 16


@dataclass(frozen=True)
class Codes:
    mean: np.ndarray
    rotation: np.ndarray  # dimensions x BITS

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """A row of WORDS numbers for each vector."""
        bits = (vectors - self.mean) @ self.rotation > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(len(vectors), WORDS)


def fit(x: np.ndarray, seed: int = 5) -> Codes:
    """Codes by iterative quantisation: turns between the signs of the rotated sample and the rotation nearest to them.

    Fewer dimensions than BITS are first carried there by several random orthogonal turns, more are cut to those
    of largest variance.
    """
    draw, dims = np.random.default_rng(seed), x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(dims)
    c = x - mean
    if dims >= BITS:
        values, vectors = np.linalg.eigh(c.T @ c + 1e-12 * np.eye(dims))
        base = vectors[:, np.argsort(values)[::-1][:BITS]]
    else:
        base = np.hstack([np.linalg.qr(draw.normal(size=(dims, dims)))[0] for _ in range(-(-BITS // dims))])[:, :BITS]
    turn = np.linalg.qr(draw.normal(size=(BITS, BITS)))[0]
    v = c @ base
    for _ in range(ROUNDS if len(x) > 1 else 0):
        left, _, right = np.linalg.svd(v.T @ np.where(v @ turn > 0, 1.0, -1.0))
        turn = left @ right
    return Codes(mean, base @ turn)


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v) of rows whose vector has numbers only and isn't zero; v as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    return rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, 0))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(1))


def entries(rows: DataFrame, codes: Codes, k: int) -> DataFrame:
    """(k1, k2, v, code, ids): each distinct vector, its key of 128 bits and its k + 1 smallest ids, as a written table."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(code=[c.tobytes() for c in codes.of(_matrix(b["v"]))] if len(b) else [])

    rows = rows.select(F.xxhash64("v").alias("k1"), F.xxhash64("v", F.lit(1)).alias("k2"), "vec_id", "v")
    one = rows.groupBy("k1", "k2").agg(F.first("v").alias("v")).mapInPandas(encode, "k1 long, k2 long, v array<double>, code binary")
    rank = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    ids = rows.select("k1", "k2", "vec_id").distinct().withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    ids = ids.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return shared.written(one.join(ids, ["k1", "k2"]))


def fitted_radius(table: DataFrame, codes: Codes, chosen: np.ndarray, k: int, takes_in: float) -> int:
    """The Hamming distance within which the share takes_in of the chosen vectors has all of its k nearest of the table."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, best = codes.of(chosen), [np.zeros((0, 2))] * len(chosen)
        for b in batches:
            x, code = _matrix(b["v"]), np.frombuffer(b"".join(b["code"]), dtype="<u8").reshape(-1, WORDS)
            for i, q in enumerate(chosen):
                far = distances(x, q)
                some = np.argsort(far)[:k] if len(far) <= 4 * k else np.argpartition(far, k)[:k]
                some = np.vstack([best[i], np.stack([far[some], np.bitwise_count(code[some] ^ mine[i]).sum(1)], axis=1)])
                best[i] = some[np.argsort(some[:, 0], kind="stable")[:k]]
        rows = [(i, far, int(apart)) for i, found in enumerate(best) for far, apart in found]
        yield pd.DataFrame(rows, columns=["i", "far", "apart"])

    rows = table.select("v", "code").mapInPandas(nearest, "i int, far double, apart int")
    rank = F.row_number().over(Window.partitionBy("i").orderBy("far", "apart"))
    found = rows.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("i").agg(F.max("apart").alias("apart")).collect()
    return int(np.quantile([r["apart"] for r in found], takes_in, method="higher")) if found else BITS


def pairs_within(table: DataFrame, asks: DataFrame, radius: int) -> DataFrame:
    """(q1, q2, k1, k2): each key of asks with the keys of the table whose code lies within the radius, each pair once."""
    reach, fields = radius // BYTES, ["k1", "k2", "code"]
    flips = np.array([sum(1 << b for b in c) for n in range(reach + 1) for c in combinations(range(8), n)], dtype=np.uint8)
    parts = -(-asks.count() // QUERY_BLOCK)

    def numbers(b: pd.DataFrame) -> np.ndarray:
        """A row of k1, k2 and the words of the code for each row."""
        keys = b[["k1", "k2"]].to_numpy(np.int64).view(np.uint64)
        return np.hstack([keys, np.frombuffer(b"".join(b["code"]), dtype="<u8").reshape(-1, WORDS)])

    def slots(x: np.ndarray) -> np.ndarray:
        """A row of BYTES slots, one for each byte and its value."""
        return np.ascontiguousarray(x[:, 2:]).view(np.uint8).astype(np.int32) + np.arange(BYTES, dtype=np.int32) * 256

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(BYTES * 256, dtype=np.int64)
        for b in batches:
            sums += np.bincount(slots(numbers(b)).ravel(), minlength=len(sums))
        yield pd.DataFrame({"slot": np.arange(len(sums)), "n": sums})

    sums = table.select(*fields).mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # BYTES x 256 rows
    blocks = {r["slot"]: -(-r["n"] // BLOCK) for r in sums}

    def dealt(slot: np.ndarray, x: np.ndarray, own: bool) -> list[tuple]:
        """Rows of slots packed by slot, block of the index and part of the queries: an entry has one block, a query one part."""
        order = np.argsort(slot, kind="stable")
        ids, starts = np.unique(slot[order], return_index=True)
        out = []
        for s, rows in zip(ids.tolist(), np.split(x[order], starts[1:])):
            for block in range(blocks.get(s, 0)):
                for part in range(parts):
                    n, at = (blocks[s], block) if own else (parts, part)
                    some = rows if n == 1 else rows[rows[:, 0] % np.uint64(n) == at]
                    if len(some):
                        out.append((s, block, part, own, some.tobytes()))
        return out

    def route(own: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = numbers(b)
                slot, rows = slots(x), []
                for p in range(BYTES if len(x) else 0):
                    if own:
                        rows += dealt(slot[:, p], x, True)
                    else:
                        near = (slot[:, p, None] - p * 256 ^ flips) + p * 256
                        rows += dealt(near.ravel(), np.repeat(x, len(flips), axis=0), False)
                yield pd.DataFrame(rows, columns=["slot", "block", "part", "own", "data"])

        return run

    def compared(at: int, index: np.ndarray, ask: np.ndarray) -> Iterator[np.ndarray]:
        for start in range(0, len(ask) if len(index) else 0, AT_ONCE):
            some = ask[start : start + AT_ONCE]
            apart = np.bitwise_count(some[:, None, 2:] ^ index[None, :, 2:]).sum(2, dtype=np.uint16)
            q, i = np.nonzero(apart <= radius)
            if at and len(q):  # a pair is that of the first byte that finds it
                per_byte = np.bitwise_count(np.ascontiguousarray(some[q, 2:] ^ index[i, 2:]).view(np.uint8))
                first = (per_byte[:, :at] > reach).all(1)
                q, i = q[first], i[first]
            yield np.hstack([some[q, :2], index[i, :2]])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each slot, block and part the index comes first; what asks for it is compared as it comes."""
        now, pieces, index, empty = None, [], None, np.zeros((0, 4), dtype=np.uint64)
        for b in batches:
            found = [empty]
            for *key, own, data in b.itertuples(index=False):
                x = np.frombuffer(data, dtype=np.uint64).reshape(-1, 2 + WORDS)
                if key != now:
                    now, pieces, index = key, [], None
                if own:
                    pieces.append(x)
                    continue
                if index is None:
                    index, pieces = np.vstack([x[:0], *pieces]), []
                found += compared(key[0] // 256, index, x)
            yield pd.DataFrame(np.vstack(found).view(np.int64), columns=["q1", "q2", "k1", "k2"])

    schema = "slot int, block int, part int, own boolean, data binary"
    routed = table.select(*fields).mapInPandas(route(True), schema).union(asks.select(*fields).mapInPandas(route(False), schema))
    dealt_out = routed.repartition("slot", "block", "part").sortWithinPartitions("slot", "block", "part", F.desc("own"))
    return dealt_out.mapInPandas(search, "q1 long, q2 long, k1 long, k2 long")


def scanned(table: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(q1, q2, k1, k2): for each of asks the nearest of the whole table, tile by tile, until they have more than k ids."""
    tiles, parts = (F.sequence(F.lit(0), F.lit(max(0, -(-df.count() // n) - 1))) for df, n in ((table, BLOCK), (asks, QUERY_BLOCK)))
    of = lambda n: F.pmod(F.col("k1"), F.size(n)).cast("int")
    all_rows = table.select("k1", "k2", "v", "ids", of(tiles).alias("tile"), F.explode(parts).alias("part"))
    dealt = asks.select("k1", "k2", "v", of(parts).alias("part"), F.explode(tiles).alias("tile"))

    def nearest(index: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out, x = [], _matrix(index["v"])
        for q1, q2, q in zip(ask["k1"], ask["k2"], ask["v"]) if len(x) else []:
            seen: set[int] = set()
            for i in np.argsort(distances(x, np.asarray(q, dtype=np.float64)), kind="stable"):
                out.append((q1, q2, index["k1"].iat[i], index["k2"].iat[i]))
                seen.update(index["ids"].iat[i])
                if len(seen) > k:
                    break
        return pd.DataFrame(out, columns=["q1", "q2", "k1", "k2"])

    return all_rows.groupBy("tile", "part").cogroup(dealt.groupBy("tile", "part")).applyInPandas(nearest, "q1 long, q2 long, k1 long, k2 long")


def _distance(v: str, q: str) -> Column:
    @F.pandas_udf("double")
    def run(v: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series(distances(_matrix(v), _matrix(q)) if len(v) else np.zeros(0))

    return run(v, q)


def neighbours(table: DataFrame, k: int = 10, every: int = 100, takes_in: float = TAKES_IN) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query, a row whose vec_id is divisible by `every`, the k nearest found.

    score: the Euclidean distance in double precision; ties go to the smaller vec_id; rows of the query's own
    vec_id aren't its candidates, and one vec_id comes once, with its nearest vector. Queries with fewer than k
    within the radius, too few to fill their list, are searched against all rows, block by block. Vectors of
    another length than most of the sample take no part, as they have no distance from the others.
    """
    rows = usable(table)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    if not len(chosen):
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = int(chosen["v"].map(len).mode().iat[0])
    sample = _matrix(chosen["v"][chosen["v"].map(len) == dims])
    codes = fit(sample)
    rows = shared.written(rows.filter(F.size("v") == dims))
    vectors = entries(rows, codes, k)
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("k1"), F.xxhash64("v", F.lit(1)).alias("k2")).distinct()
    asked = shared.written(asked.select("query_id", F.struct("k1", "k2").alias("q")))
    asks = vectors.join(asked.select("q.k1", "q.k2").distinct(), ["k1", "k2"])
    asks = shared.written(asks)
    lists = shared.written(_lists(pairs_within(vectors, asks, fitted_radius(vectors, codes, sample[:PROBED], k, takes_in)), vectors, asks, k))
    short = shared.written(asks.join(lists.filter(F.size("found") > k).select("q.k1", "q.k2"), ["k1", "k2"], "left_anti"))
    if not short.isEmpty():
        more = _lists(scanned(vectors, short, k), vectors, short, k)
        lists = lists.filter(F.size("found") > k).union(more)
    counts = asked.groupBy("q").agg(F.count("*").alias("n"))
    out = shared.with_class(asked, lists.join(counts, "q"), "q")
    own = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    out = out.groupBy("query_id").agg(_merged(F.flatten(F.collect_list(own)), k).alias("found"))  # an id has one vector, or as many as rows repeat it
    return out.select("query_id", F.posexplode("found")).select("query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", "col.score")


def _merged(found: Column, k: int) -> Column:
    """The k first of an array of (score, vec_id), each vec_id with its smallest score."""
    ordered = F.array_sort(found)
    seen = lambda acc, x: F.exists(acc, lambda y: y["vec_id"] == x["vec_id"])
    none = F.array().cast("array<struct<score:double,vec_id:bigint>>")
    return F.aggregate(ordered, none, lambda acc, x: F.when((F.size(acc) >= k) | seen(acc, x), acc).otherwise(F.concat(acc, F.array(x))))


def _lists(pairs: DataFrame, vectors: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(q, found): for each key of asks that pairs have, its k + 1 nearest ids as an array of (score, vec_id)."""
    q = asks.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("v").alias("w"))
    near = pairs.join(vectors.select("k1", "k2", "v", "ids"), ["k1", "k2"]).join(q, ["q1", "q2"])
    near = near.select(F.struct(F.col("q1").alias("k1"), F.col("q2").alias("k2")).alias("q"), _distance("v", "w").alias("score"), "ids")
    near = near.select("q", "score", F.explode("ids").alias("vec_id")).groupBy("q", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    near = near.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    return near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
