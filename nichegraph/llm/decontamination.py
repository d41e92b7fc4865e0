"""Benchmark passages in training texts by a distributed positional inverted index.

The index is a table: a row per block of documents and term, with the term's places in the block, and a row per
block that says which documents it holds and where each begins. Blocks hold whole documents of some bounded size,
so an index of any corpus is a table of small rows. A search takes a block's postings of the test terms. Windows
of test words start from the rarest of their terms: its places, moved by its offset, are where the window may
begin, and the other terms' lists, moved by theirs, are intersected one after the other, rare ones first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW = 10
#: Words of a block, its last document aside; empty places between documents, so that nothing runs over their ends.
BLOCK_WORDS, GAP = 1_000_000, 64
#: Words of test items that are sent to all executors at once; more are searched in so many turns.
ITEM_WORDS = 4_000_000
#: Bytes of signs that end words are blanks, A-Z small letters; all of UTF-8 beyond ASCII is kept.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "block string, term string, n long, places binary, ids binary, starts binary, sizes binary"


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8: runs of 0-9, A-Z (as a-z), a-z and signs beyond ASCII. A null text has none."""
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


def block_of(name: str, ids: list[str | None], sizes: list[int], words: list[bytes]) -> pa.RecordBatch:
    """A block's rows of the index: one per term, put together from whole buffers, and one for its documents."""
    of: dict[bytes, int] = {}
    terms = np.fromiter((of.setdefault(w, len(of)) for w in words), dtype=np.int32, count=len(words))
    size = np.array(sizes, dtype="<i8")
    starts = np.concatenate([[0], np.cumsum(size[:-1] + GAP)]).astype("<i8")
    place = (np.arange(len(words)) + np.repeat(np.arange(len(sizes)) * GAP, size)).astype("<u4")
    n = np.bincount(terms, minlength=len(of)).astype(np.int64)
    known = np.array([x is not None for x in ids])
    every = np.array([int(x) if x is not None else 0 for x in ids], dtype="<i8")
    rows = len(of) + 1
    ends = lambda lengths: pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype("<i4"))
    there = pa.py_buffer(np.packbits(np.arange(rows) < len(of), bitorder="little"))
    term = pa.StringArray.from_buffers(rows, ends([*map(len, of), 0]), pa.py_buffer(b"".join(of)), there)
    places = pa.BinaryArray.from_buffers(pa.binary(), rows, [None, ends([*(n * 4), len(known)]), pa.py_buffer(place[np.argsort(terms, kind="stable")].tobytes() + known.tobytes())])
    last = lambda x: pa.concat_arrays([pa.nulls(rows - 1, pa.binary()), pa.array([x.tobytes()])])
    return pa.RecordBatch.from_arrays([pa.repeat(name, rows), term, pa.array([*n, len(sizes)], pa.int64()), places, last(every), last(starts), last(size)], names=[c.split()[0] for c in INDEX.split(", ")])


def index(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The positional index (INDEX's columns) of whole texts, written to the shared folder; it serves any test set.

    term is null in a block's row of documents: their rows of docs, by id and, as ids may be null or repeat, place.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_blocks, ids, sizes, words = TaskContext.get().partitionId(), 0, [], [], []
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                own = (text or b"").translate(WORD_BYTES).split()
                ids.append(doc_id)
                sizes.append(len(own))
                words += own
                if len(words) + GAP * len(ids) >= block_words:
                    yield block_of(f"{part}-{n_blocks}", ids, sizes, words)
                    n_blocks, ids, sizes, words = n_blocks + 1, [], [], []
        if ids:
            yield block_of(f"{part}-{n_blocks}", ids, sizes, words)

    return shared.written(docs.mapInArrow(build, INDEX), "zstd")


class Windows:
    """Distinct windows of test items, each with its terms in order of rarity; items may share windows."""

    def __init__(self, items: list[tuple[str, list[str]]], frequency: dict[str, int], window: int = WINDOW):
        at: dict[tuple[str, ...], int] = {}
        pairs = []
        self.terms = {t: k for k, t in enumerate(sorted(frequency))}
        for item, words in items:
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                w = tuple(words[i : i + size])
                if all(t in frequency for t in w):  # else it is in no document
                    pairs.append((at.setdefault(w, len(at)), item))
        pairs = sorted(set(pairs))
        self.items = np.array([p[1] for p in pairs], dtype=object)
        self.first = np.searchsorted([p[0] for p in pairs], np.arange(len(at) + 1))
        self.size = np.array([len(w) for w in at], dtype=np.int64)
        self.term, self.offset = np.full((len(at), window), -1, dtype=np.int64), np.zeros((len(at), window), dtype=np.int64)
        for k, w in enumerate(at):
            order = sorted(range(len(w)), key=lambda i: (frequency[w[i]], i))
            self.term[k, : len(w)], self.offset[k, : len(w)] = [self.terms[w[i]] for i in order], order

    def found(self, places: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Windows and where they begin, by a block's postings of terms."""
        which, begin = [], []
        lead = self.term[:, 0] if len(self.term) else np.zeros(0, np.int64)
        order = np.argsort(lead, kind="stable")
        terms, starts = np.unique(lead[order], return_index=True)
        keys = np.concatenate([p.astype(np.int64) + (t << 32) for t, p in sorted(places.items())]) if places else np.zeros(0, np.int64)
        for t, some in zip(terms.tolist(), np.split(order, starts[1:]) if len(terms) else []):
            if t not in places:
                continue
            at = places[t].astype(np.int64)
            for chunk in np.array_split(some, max(1, len(some) * len(at) // 2_000_000)):  # bounds the candidates at once
                w = np.repeat(chunk, len(at))
                s = np.tile(at, len(chunk)) - self.offset[w, 0]
                for k in range(1, self.term.shape[1]):
                    if not len(w):
                        break
                    ask = self.term[w, k]
                    key = (ask << 32) + s + self.offset[w, k]
                    hit = np.searchsorted(keys, key)
                    ok = (ask < 0) | ((hit < len(keys)) & (keys[np.minimum(hit, len(keys) - 1)] == key))
                    w, s = w[ok], s[ok]
                which.append(w)
                begin.append(s)
        none = np.zeros(0, np.int64)
        return (np.concatenate(which), np.concatenate(begin)) if which else (none, none)

    def together(self, places: dict[int, np.ndarray], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose terms, repeats included, are in any order within `span` places: (window, first place, last place).

        From each place of the rarest term: the other terms' nearest places on both sides, then the shortest run of
        places around it that has them all.
        """
        out = []
        for w in range(len(self.size)):
            terms, need = np.unique(self.term[w, : self.size[w]], return_counts=True)
            if any(t not in places for t in terms.tolist()):
                continue
            rare = places[int(self.term[w, 0])].astype(np.int64)
            for t, n in zip(terms.tolist(), need.tolist()):  # enough of each term within reach of the place
                p = places[t].astype(np.int64)
                rare = rare[np.searchsorted(p, rare + span - 1, side="right") - np.searchsorted(p, rare - span + 1) >= n]
            for c in rare.tolist():
                marks = sorted((int(x), t) for t in terms.tolist() for x in places[t][slice(*np.searchsorted(places[t], (max(0, c - span + 1), c + span)))])
                left, lack, have = 0, int(need.sum()), dict.fromkeys(terms.tolist(), 0)
                of = dict(zip(terms.tolist(), need.tolist()))
                for x, t in marks:
                    lack -= have[t] < of[t]
                    have[t] += 1
                    while not lack:
                        first, term = marks[left]
                        if first <= c <= x and x - first < span:
                            out.append((w, first, x))
                        have[term] -= 1
                        lack += have[term] < of[term]
                        left += 1
        return tuple(np.array([r[k] for r in sorted(set(out))], dtype=np.int64) for k in range(3))


def _search_of(windows, span: int | None):
    """A task's work on a block: its runs of words that are windows, by broadcast windows."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        w, here = windows.value, rows[rows["term"].notna()]
        starts = np.frombuffer(rows["starts"][rows["term"].isna()].iloc[0], dtype="<i8")
        places = {w.terms[t]: np.frombuffer(p, dtype="<u4") for t, p in zip(here["term"], here["places"])}
        which, begin = w.found(places)
        end = begin + w.size[which]
        if span is not None:
            more = w.together(places, span)
            which, begin, end = (np.concatenate(x) for x in zip((which, begin, end), (more[0], more[1], more[2] + 1)))
        # a row per item of the window, then one per run of overlapping windows of an item
        n = w.first[which + 1] - w.first[which]
        item = w.items[np.repeat(w.first[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if len(n) else np.zeros(0, object)
        found = pd.DataFrame({"item_id": item, "begin": np.repeat(begin, n), "end": np.repeat(end, n)}).sort_values(["item_id", "begin"], kind="stable")
        found["doc"] = np.searchsorted(starts, found["begin"], side="right") - 1
        far = found.groupby(["doc", "item_id"])["end"].cummax()
        same = (found["doc"] == found["doc"].shift()) & (found["item_id"] == found["item_id"].shift()) & (found["begin"] <= far.shift())
        found["run"] = (~same).cumsum()
        runs = found.groupby("run").agg(doc=("doc", "first"), item_id=("item_id", "first"), begin=("begin", "min"), end=("end", "max"))
        runs[["begin", "end"]] -= starts[runs["doc"].to_numpy()][:, None]
        return runs.assign(block=rows["block"].iloc[0])[["block", "doc", "item_id", "begin", "end"]]

    return search


def matches(indexed: DataFrame, items: DataFrame, window: int = WINDOW, span: int | None = None, item_words: int = ITEM_WORDS) -> DataFrame:
    """(block, doc, item_id, begin, end): runs of a document's words, end exclusive, that are windows of the item.

    Windows that overlap or touch are one run. An item of fewer words than a window is a window itself; one without words
    is in no document. span: also windows whose words are in any order within so many places, at most GAP; a
    run is then the places that hold them. Items are sent to the executors in turns of a bounded number of words.
    """
    if span is not None and span > GAP:
        raise ValueError(f"a span has at most {GAP} places")
    spark = indexed.sparkSession

    @F.pandas_udf("array<string>")
    def split(t: pd.Series) -> pd.Series:
        return t.map(lambda x: [w.decode() for w in words_of(x)])

    test = shared.written(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), split("text").alias("words")))
    terms = test.select(F.explode("words").alias("term")).distinct()
    # a term's occurrences in all documents, for test terms that there are
    rarity = shared.written(indexed.select("term", "n").join(terms, "term").groupBy("term").agg(F.sum("n").alias("n")))
    turns = max(1, -(-(test.agg(F.sum(F.size("words"))).first()[0] or 0) // item_words))
    test = test.withColumn("turn", F.pmod(F.xxhash64("item_id", "words"), F.lit(turns)))
    out = None
    for k in range(turns):
        some = test.filter(F.col("turn") == k).drop("turn")
        used = some.select(F.explode("words").alias("term")).distinct().join(rarity, "term")
        rows = [(r.item_id, r.words) for r in some.toLocalIterator()]  # bounded by item_words
        windows = spark.sparkContext.broadcast(Windows(rows, {r.term: r.n for r in used.toLocalIterator()}, window))
        asked = F.broadcast(used.select("term", F.lit(True).alias("asked")))  # bounded by item_words
        here = indexed.select("block", "term", "places", "starts").join(asked, "term", "left").filter("asked or term is null").drop("asked")
        found = here.groupBy("block").applyInPandas(_search_of(windows, span), "block string, doc long, item_id string, begin long, end long")
        out = found if out is None else out.unionByName(found)
    return out


def documents_of(indexed: DataFrame) -> DataFrame:
    """(block, doc, doc_id, n_words) of every indexed row, from the blocks' rows of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, known, ids, sizes in zip(b["block"], b["places"], b["ids"], b["sizes"]):
                ids = pd.array(np.frombuffer(ids, dtype="<i8").copy(), dtype="Int64")
                ids[~np.frombuffer(known, dtype=bool)] = pd.NA
                yield pd.DataFrame({"block": block, "doc": np.arange(len(ids)), "doc_id": ids, "n_words": np.frombuffer(sizes, dtype="<i8")})

    return indexed.filter("term is null").select("block", "places", "ids", "sizes").mapInPandas(run, "block string, doc long, doc_id long, n_words long")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of docs, repeated rows included.

    n_hit: words inside windows of any item; items_sha256: of the sorted ids of items with windows here, null
    ids as empty text. Null and empty texts have no words. Without items nothing is contaminated.
    """
    indexed = index(docs)
    found = shared.written(matches(indexed, items, window))
    ids = F.array_sort(F.collect_set("item_id"))
    # runs in order of their beginnings; what an earlier one covers counts once
    runs = F.array_sort(F.collect_list(F.struct("begin", "end")))
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("to"))
    union = F.aggregate(runs, zero, lambda s, r: F.struct((s["hit"] + F.greatest(r["end"] - F.greatest(r["begin"], s["to"]), F.lit(0))).alias("hit"), F.greatest(s["to"], r["end"]).alias("to")))
    per = found.groupBy("block", "doc").agg(union["hit"].alias("n_hit"), F.size(F.collect_set("item_id")).cast("long").alias("n_items"), F.array_join(ids, ",").alias("items"))
    rows = documents_of(indexed).join(per, ["block", "doc"], "left")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))
