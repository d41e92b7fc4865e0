"""SimHash near-duplicates through a Gray-order hierarchical index over distinct fingerprints.

Fingerprints in Gray order share long runs of bits with their neighbours. A node of the index covers
neighbours and keeps the bits that all of them share; a bit is kept at the highest node that shares it. A
search descends from the top, adds up the differences of each node's own bits, and leaves a node with all
below it once the sum exceeds the radius. Every group of neighbours is a task's index; the table of the
groups' shared bits, one row per group, is the upper part of the same index and says which groups a
fingerprint has to visit. A task joins what it finds into local classes and returns one link per
fingerprint and group at most, so dense groups give no quadratic output; links then form components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Near copies of whole texts: Jaccard similarity of sets of runs of words; bands of minimum hashes and hashes in each, which find 0.8 in 99.9 % of cases.
SIMILARITY, LONG_SHINGLE, BANDS, ROWS = 0.8, 5, 28, 7
#: What an estimate from minima may fall short of the similarity by: four standard deviations at 0.8 of 196 minima.
SLACK = 0.115
#: Texts of a band, and bytes of a group's texts, of a part: a task compares two parts. Rows and bytes of tasks put together.
BAND_PART, TEXT_PART, BUCKET_ROWS = 4096, 8 << 20, 20_000
#: Rows with their signatures, some 600 bytes each, that are worth a file.
SIGNED_A_FILE = 5000
#: Bits of the filter that texts pass on their way to the groups: 8 MB, whatever the size of the corpus.
FILTER_BITS = 1 << 26
#: Fingerprints of a group (the groups are few for small inputs and at most MOST_GROUPS), children of a node, queries descended at once.
GROUP, MOST_GROUPS, FANOUT, AT_ONCE = 8192, 65_536, 16, 1024
#: Visitors of a group in one task, as a multiple of GROUP.
VISITORS = 16


def simhash(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The text's fingerprint, unsigned: a bit is set where it is set in over half the shingles' XXH64, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """A hierarchy over items in Gray order; all codes of item i have the bits of ands[i] set and none outside ors[i]."""

    def __init__(self, ands: np.ndarray, ors: np.ndarray, fanout: int = FANOUT):
        self.fanout, levels = fanout, [(ands, ors)]
        while len(levels[-1][0]) > fanout:
            starts = np.arange(0, len(levels[-1][0]), fanout)
            levels.append((np.bitwise_and.reduceat(levels[-1][0], starts), np.bitwise_or.reduceat(levels[-1][1], starts)))
        above = np.zeros(0, dtype=np.uint64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the top: shared bits, and which of them no node above has
        for a, o in reversed(levels):
            common = ~(a ^ o)
            up = above[np.arange(len(a)) // fanout] if len(above) else np.zeros(len(a), dtype=np.uint64)
            self.levels.append((a, common & ~up))
            above = common

    def search(self, queries: np.ndarray, radius: int, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries and of the items that may have a code within the radius; for single codes, have."""
        for start in range(0, len(queries), at_once):
            part = queries[start : start + at_once]
            top = len(self.levels[0][0])
            q, node = np.repeat(np.arange(len(part)), top), np.tile(np.arange(top), len(part))
            off = np.zeros(len(q), dtype=np.uint8)
            for k, (bits, own) in enumerate(self.levels):
                if k:
                    size = len(bits)
                    q, off = np.repeat(q, self.fanout), np.repeat(off, self.fanout)
                    node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                    if size % self.fanout:
                        there = node < size
                        q, node, off = q[there], node[there], off[there]
                off = off + np.bitwise_count((part[q] ^ bits[node]) & own[node])
                near = off <= radius
                q, node, off = q[near], node[near], off[near]
            yield q + start, node


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i]; root holds the smallest member of each member's class."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, code) per document; code as a signed long. Null texts are empty, with code 0."""

    return shared.texts(docs).select("doc_id", code_of(F.col("text")).alias("code"))


def code_of(text: Column) -> Column:
    @F.pandas_udf("long")
    def codes(t: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(x) for x in t], dtype=np.uint64).view(np.int64))

    return codes(text)


def _rank(code: Column) -> Column:
    """gray_rank as a signed long in the same order."""
    for s in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, s))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def near_links(codes: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of column code's distinct values within the radius.

    The groups' bounds are approximate quantiles of the Gray ranks: they only decide how even the groups are.
    """
    n = codes.count()
    groups = max(1, min(MOST_GROUPS, -(-n // group)))
    cuts: list[int] = []
    if groups > 1:
        cuts = codes.agg(F.percentile_approx(_rank(F.col("code")), [i / groups for i in range(1, groups)], max(10_000, 4 * groups))).first()[0]
    bounds = np.array(sorted(set(cuts)), dtype=np.int64)

    def home(code: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, (gray_rank(code) ^ np.uint64(1 << 63)).view(np.int64), side="right")

    def shared_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            code = b["code"].to_numpy(np.int64).view(np.uint64)
            at = home(code)
            order = np.argsort(at, kind="stable")
            ids, starts = np.unique(at[order], return_index=True)
            if len(ids):
                yield pd.DataFrame({"gid": ids, "a": np.bitwise_and.reduceat(code[order], starts).view(np.int64), "o": np.bitwise_or.reduceat(code[order], starts).view(np.int64)})

    table = codes.select("code").mapInPandas(shared_bits, "gid long, a long, o long").groupBy("gid").agg(F.bit_and("a"), F.bit_or("o")).orderBy("gid").collect()
    if not table:
        return codes.select(F.col("code").alias("a"), F.col("code").alias("b"))
    gids = np.array([r[0] for r in table], dtype=np.int64)
    ands, ors = (np.array([r[k] for r in table], dtype=np.int64).view(np.uint64) for k in (1, 2))

    def visits(code: np.ndarray, upper: GrayIndex) -> tuple[np.ndarray, np.ndarray]:
        """A fingerprint goes to its group, and to each group before it that may have some within the radius: (group, code)."""
        at, found = home(code), [(q, gids[g]) for q, g in upper.search(code, radius)]
        q, g = (np.concatenate([f[i] for f in found]) for i in (0, 1)) if found else (np.zeros(0, int), np.zeros(0, int))
        before = g < at[q]
        return g[before], code[q[before]]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = GrayIndex(ands, ors)
        for b in batches:
            ids, n = np.unique(visits(b["code"].to_numpy(np.int64).view(np.uint64), upper)[0], return_counts=True)
            yield pd.DataFrame({"gid": ids, "n": n})

    # a group with many visitors, as where few bits are shared, has them dealt to several tasks with a copy of the group each
    many = codes.select("code").mapInPandas(count, "gid long, n long").groupBy("gid").agg(F.sum("n").alias("n")).filter(F.col("n") > VISITORS * group).collect()
    parts = {r["gid"]: -(-r["n"] // (VISITORS * group)) for r in many}

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = GrayIndex(ands, ors)
        for b in batches:
            code = b["code"].to_numpy(np.int64).view(np.uint64)
            rows = []
            for own, to, what in ((True, home(code), code), (False, *visits(code, upper))):
                order = np.argsort(to, kind="stable")
                ids, starts = np.unique(to[order], return_index=True)
                for i, some in zip(ids.tolist(), np.split(what[order], starts[1:]) if len(ids) else []):
                    n = parts.get(i, 1)
                    if own or n == 1:
                        rows += [(i, p, own, some.tobytes()) for p in range(n)]
                    else:
                        rows += [(i, p, own, part.tobytes()) for p in range(n) if len(part := some[some % np.uint64(n) == p])]
            yield pd.DataFrame(rows, columns=["gid", "part", "own", "codes"])

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own, others = (np.frombuffer(b"".join(rows["codes"][rows["own"] == o]), dtype=np.uint64) for o in (True, False))
        own = own[np.argsort(gray_rank(own), kind="stable")]
        index, every = GrayIndex(own, own), np.concatenate([own, others])
        root, first = np.arange(len(every)), len(own) if key[1] else 0  # the group's own links are the first part's
        for q, c in index.search(every[first:], radius):
            unite(root, q + first, c)
        linked = np.flatnonzero(root != np.arange(len(every)))
        return pd.DataFrame({"a": every[linked].view(np.int64), "b": every[root[linked]].view(np.int64)})

    routed = codes.select("code").mapInPandas(route, "gid long, part int, own boolean, codes binary")
    return routed.groupBy("gid", "part").applyInPandas(link, "a long, b long")


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document, repeated rows included.

    component_id: the smallest id that is reached over links of fingerprints within the radius, equal ones
    included; null ids are passed over, and a component of null ids alone has a null one.
    """
    rows = shared.written(fingerprints(docs))
    codes = shared.written(rows.groupBy("code").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = shared.components(near_links(codes, radius))
    linked = codes.join(found.withColumnRenamed("node", "code"), "code")
    roots = linked.groupBy("root").agg(F.min("least").alias("smallest"))
    linked = linked.join(roots, "root").select("code", F.col("root").alias("linked_root"), "smallest")
    one = codes.join(linked, "code", "left").select("code", "n", F.coalesce("linked_root", "code").alias("root"), F.when(F.col("linked_root").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id"))
    text = F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint")
    return shared.with_class(rows, one, "code").select("doc_id", text, "component_id", "root")


def signatures(text: Column, shingle: int, coded: bool = False, bands: int = BANDS, rows: int = ROWS) -> Column:
    """(bands: a 64-bit hash of each band's minima of the shingles' hashes; sketch: a byte of every minimum; code: the fingerprint, if asked for).

    Texts without words have no bands.
    """

    @F.pandas_udf("struct<bands:array<long>,sketch:binary,code:long>")
    def run(t: pd.Series) -> pd.DataFrame:
        draw = np.random.default_rng(SEED)
        by, plus = (draw.integers(0, 1 << 63, (bands * rows, 1), dtype=np.uint64) for _ in range(2))
        by, out = by * np.uint64(2) + np.uint64(1), []
        for x in t:
            h, code = shingles(x, shingle), simhash(x) if coded else None
            code = code if code is None or code < 1 << 63 else code - (1 << 64)
            if not len(h):
                out.append(([], b"", code))
                continue
            least = np.full(bands * rows, (1 << 32) - 1, dtype=np.uint64)
            for i in range(0, len(h), 4096):
                least = np.minimum(least, ((h[i : i + 4096] * by + plus) >> np.uint64(32)).min(1))
            least = least.astype("<u4")
            out.append(([xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(least.reshape(bands, rows))], (least & 255).astype(np.uint8).tobytes(), code))
        return pd.DataFrame(out, columns=["bands", "sketch", "code"]).astype({"code": "Int64"})

    return run(text)


def shingles(text: str, shingle: int) -> np.ndarray:
    """XXH64 of the distinct runs of so many lower-case words, sorted; of all words where there are fewer."""
    words = text.encode("utf-8", "replace").lower().split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)] if words else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype=np.uint64))


def linked(n: int, near) -> Iterator[tuple[int, int]]:
    """Links (member, first) of the components of n items; near(i, others) says which of the others are linked to i.

    Every item is compared with all that no component has reached yet, so a component costs its members times
    what lies outside of it, and none of its links to the outside is passed over.
    """
    left = np.arange(n)
    while len(left) > 1:
        first, left = left[0], left[1:]
        todo = [first]
        while todo and len(left):
            i = todo.pop()
            hit = near(i, left)
            yield from ((int(j), int(first)) for j in left[hit])
            todo += left[hit].tolist()
            left = left[~hit]


def near_sketches(sketches: np.ndarray, least: float):
    """near() for linked(): rows of bytes of minima with at least this estimate of the similarity."""
    n = sketches.shape[1]

    def near(i: int, others: np.ndarray) -> np.ndarray:
        same = np.concatenate([(sketches[others[k : k + 4096]] == sketches[i]).sum(1) for k in range(0, len(others), 4096)])
        return (same / n - 1 / 256) / (1 - 1 / 256) >= least

    return near


def near_sets(sets: list[np.ndarray], similarity: float):
    """near() for linked(): sorted sets with at least this Jaccard similarity."""
    size = np.array([len(x) for x in sets])
    start = np.concatenate([[0], np.cumsum(size)])
    every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        out, mine = np.zeros(len(others), dtype=bool), sets[i]
        may = np.flatnonzero((size[others] >= similarity * size[i]) & (similarity * size[others] <= size[i]) & (size[others] > 0))
        for k in range(0, len(may), 1024):
            some = others[may[k : k + 1024]]
            ends = np.cumsum(size[some])
            at = np.arange(ends[-1]) + np.repeat(start[some] - np.concatenate([[0], ends[:-1]]), size[some])
            theirs = every[at]
            found = np.searchsorted(mine, theirs)
            hit = mine[np.minimum(found, len(mine) - 1)] == theirs
            both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], ends[:-1]]))
            out[may[k : k + 1024]] = both >= similarity * (size[i] + size[some] - both)
        return out

    return near


def _tasks(rows: DataFrame, group: str, buckets: int) -> DataFrame:
    """rows (group, part, parts, ...) with the pairs of parts p and q that they are compared in, and the bucket of each pair."""
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("parts = 1 or other <> part")
    rows = rows.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")}).drop("part", "parts", "other")
    return rows.withColumn("bucket", F.pmod(F.xxhash64(group, "p", "q"), F.lit(buckets)))


def _groups(rows: pd.DataFrame, group: str) -> Iterator[np.ndarray]:
    """Places of the rows of each pair of parts in a bucket."""
    yield from (v for v in rows.groupby([group, "p", "q"], sort=False).indices.values() if len(v) > 1)


def candidates(signed: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of keys whose components hold all pairs that agree in a band and whose minima say that they may be similar.

    signed: (key, bands, sketch). Bands of one key are left out before sketches are joined; those with many are
    dealt to pairs of parts.
    """
    left = shared.written(signed.select("key", F.explode("bands").alias("band")))
    sizes = left.groupBy("band").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BAND_PART).cast("int").alias("parts")).filter("n > 1")
    there = shared.with_class(left, sizes, "band", few_files=True).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    there = shared.written(_tasks(there, "band", max(1, left.count() // BUCKET_ROWS)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, out = rows["key"].to_numpy(), []
        sketches = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(len(rows), -1)
        groups = list(_groups(rows, "band"))
        pairs = np.array([g for g in groups if len(g) == 2]).reshape(-1, 2)
        for k in range(0, len(pairs), 4096):
            a, b = pairs[k : k + 4096].T
            same = ((sketches[a] == sketches[b]).mean(1) - 1 / 256) / (1 - 1 / 256) >= similarity - SLACK
            out += zip(keys[a[same]], keys[b[same]])
        for g in groups:
            if len(g) > 2:
                out += [(keys[g[i]], keys[g[j]]) for i, j in linked(len(g), near_sketches(sketches[g], similarity - SLACK))]
        return pd.DataFrame(list(dict.fromkeys(out)), columns=["a", "b"])

    return there.join(signed.select("key", "sketch"), "key").groupBy("bucket").applyInPandas(run, "a string, b string").distinct()


def among(rows: DataFrame, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """rows whose key is in keys, and some whose key isn't: those that share one of `bits` hashes with one that is.

    The filter is a table of bitmaps of a fixed size, sent to where the rows are, so that few rows need be shuffled to the
    join that decides.
    """
    number = F.pmod(F.xxhash64("key"), F.lit(bits)) + 1
    filled = keys.select(number.alias("number")).groupBy(F.bitmap_bucket_number("number").alias("filter")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("filter", F.bitmap_bucket_number(number)).join(F.broadcast(filled), "filter").filter(F.getbit(byte, (at % 8).cast("int")) == 1).drop("filter", "bits")


def similar_links(signed: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links (a, b) of keys whose components are those of all candidate pairs with at least this Jaccard similarity, exactly computed.

    signed: (key, bands, sketch, size); texts: (key, text), keys may repeat. Candidates' components are groups; only their texts
    are read, once each. A group of many bytes is dealt to pairs of parts, small groups share tasks. The number of
    steps doesn't depend on the data, but for the rounds in which components join.
    """
    n = signed.count()
    groups = shared.written(shared.components(candidates(signed, similarity)).withColumnRenamed("node", "key"), rows=n)
    groups = groups.join(signed.select("key", "size"), "key")
    mass = groups.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / TEXT_PART).cast("int").alias("parts"))
    groups = shared.with_class(groups, mass, "root", few_files=True).withColumn("part", F.pmod(F.xxhash64("key", "root"), F.col("parts")).cast("int"))
    groups = shared.written(groups, rows=n)
    bytes_all = groups.agg(F.sum(F.col("size") * F.greatest(F.col("parts") - 1, F.lit(1)))).first()[0]
    if bytes_all is None:
        return signed.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    some = among(texts, groups.select("key")).dropDuplicates(["key"])
    rows = _tasks(groups.select("key", "root", "part", "parts"), "root", max(1, bytes_all // TEXT_PART)).join(some, "key")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys, out = rows["key"].to_numpy(), []
        for g in _groups(rows, "root"):
            sets = [shingles(x, shingle) for x in rows["text"].iloc[g]]
            out += [(keys[g[i]], keys[g[j]]) for i, j in linked(len(g), near_sets(sets, similarity))]
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.groupBy("bucket").applyInPandas(run, "a string, b string")


def similar_classes(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = LONG_SHINGLE, radius: int | None = None) -> DataFrame:
    """(doc_id, key, component_id, root) per document, as classes(): components of texts with at least this similarity.

    key: the text's MD5. Candidates agree in one of BANDS bands of minimum hashes and may be similar by all minima;
    they are confirmed exactly. With a radius, texts whose fingerprints are within it are linked too, by the index,
    whatever their similarity.
    """
    rows = shared.written(shared.texts(docs).select("doc_id", F.md5("text").alias("key"), F.octet_length("text").cast("long").alias("size"), signatures(F.col("text"), shingle, radius is not None).alias("signature")))
    keys = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("signature").alias("signature"))
    keys = shared.written(keys.select("key", "least", "n", "size", "signature.*"), rows=rows.count(), rows_a_file=SIGNED_A_FILE)
    n = keys.count()
    links = similar_links(keys, shared.texts(docs).select(F.md5("text").alias("key"), "text"), similarity, shingle)
    if radius is not None:
        links = links.union(fingerprint_links(keys.select("key", "code"), radius))
    found = shared.components(links).withColumnRenamed("node", "key")
    one = shared.written(keys.join(found, "key", "left").select("key", "n", "least", F.coalesce("root", "key").alias("root")), rows=n)
    smallest = one.groupBy("root").agg(F.min("least").alias("component_id"))
    return shared.with_class(rows.select("doc_id", "key"), one.join(smallest, "root").select("key", "n", "root", "component_id"), "key", few_files=True).select("doc_id", "key", "component_id", "root")


def fingerprint_links(keys: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of keys, unique in (key, code), whose components are those of codes within the radius, equal ones included."""
    codes = shared.written(keys.groupBy("code").agg(F.min("key").alias("first")), rows=keys.count())
    equal = keys.join(codes, "code").filter("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    one, two = (codes.select(F.col("code").alias(k), F.col("first").alias(f"first_{k}")) for k in "ab")
    near = near_links(codes, radius).filter("a <> b").join(one, "a").join(two, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return equal.union(near)


def deduplicated(docs: DataFrame, radius: int = RADIUS, similarity: float | None = None, shingle: int = LONG_SHINGLE) -> DataFrame:
    """The rows of docs without near-duplicates: of each class the row with the smallest id stays.

    Null, empty and blank texts are one class, of which one row stays.
    Classes are of fingerprints within the radius; with a similarity, texts with such sets of shingles are linked as well.
    """
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    if similarity is None:
        key, found = code_of(text), classes(docs, radius).withColumn("key", F.conv("fingerprint", 16, -10).cast("long"))
    else:
        key, found = F.md5(text), similar_classes(docs, similarity, shingle, radius)
    stays = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("_stay"))
    stays = shared.written(stays.select(F.col("_stay.doc_id").alias("_id"), F.col("_stay.key").alias("_key")))
    rows = docs.select(F.struct("*").alias("_row")).withColumn("_code", key)
    kept = rows.join(stays, (F.col("_code") == F.col("_key")) & F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")))
    if kept.select("_code").count() > stays.count():
        kept = kept.dropDuplicates(["_code"])
    return kept.select("_row.*")
