"""Spelling variants of words by blocked Gram matrices of letter counts.

One edit changes the counts of letters by a squared distance of 1 (a letter more or less) or 2 (one letter for
another). Words are dealt to blocks by length and by the number of their letters in each of some groups; an edit
leads to the same block or to a known neighbour of it. Blocks are cut to parts of bounded size, and a task takes the
NumPy product of two parts' letter counts, keeps pairs at the right squared distance, and verifies the edit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Runs of letters in UTF-8 after lower-casing A-Z: a-z, and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LETTERS = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
#: One in so many occurrences loses a code point; words have so many code points and occurrences at least; a form is so many times as frequent.
DAMAGED, LEAST_LENGTH, LEAST_N, RATIO = 31, 7, 2, 10
#: Groups of letters that cut blocks by their counts: a word's letters of each group. Any groups are right; these are about equally frequent.
GROUPS = ("ae", "io", "nt", "rsh")
#: Words of a part of a block; distinct words that a task counts before it passes them on.
PART, AT_ONCE = 2048, 200_000


def occurrences(text: str | None, doc_id: int | None, damaged: int = DAMAGED) -> list[bytes]:
    """The text's runs in UTF-8, those whose hash with the id is divisible by `damaged` without one code point."""
    seed = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    out = RUN.findall((text or "").encode("utf-8", "replace").translate(LOWER))
    for i, w in enumerate(out):
        h = zlib.crc32(w, seed)
        if not h % damaged:
            s = w.decode()
            at = h % len(s)
            out[i] = (s[:at] + s[at + 1 :]).encode()
    return out


def counted(docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N) -> DataFrame:
    """(word, n) of words with enough code points and occurrences. Null texts have none; a null id is hashed as no text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[bytes] = Counter()

        def rows() -> pd.DataFrame:
            words = [(w.decode(), n) for w, n in found.items()]
            return pd.DataFrame([x for x in words if len(x[0]) >= least_length], columns=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                found.update(occurrences(text, doc_id))
                if len(found) > AT_ONCE:
                    yield rows()
                    found.clear()
        yield rows()

    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return docs.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def _codes(joined: str, n: int) -> np.ndarray:
    """Places in LETTERS, a row per word, of n words of one length put together."""
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").reshape(n, -1).astype(np.int64)
    return np.where(points < 0xC0, points - ord("a"), points - 0xC0 + 26)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Rows of counts by letter, in numbers in which squared distances are exact."""
    flat = np.bincount((codes + np.arange(len(codes))[:, None] * len(LETTERS)).ravel(), minlength=len(codes) * len(LETTERS))
    return flat.reshape(len(codes), len(LETTERS)).astype(np.float32 if codes.shape[1] < 2048 else np.float64)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a and b, of equal length or b's longer by one, differ by exactly one code point."""
    size = a.shape[1]
    if b.shape[1] == size:
        return (a != b).sum(1) == 1
    same, shifted = a == b[:, :size], a == b[:, 1:]
    head, tail = np.logical_and.accumulate(same, axis=1).sum(1), np.logical_and.accumulate(shifted[:, ::-1], axis=1).sum(1)
    return head + tail >= size


def near(ca: np.ndarray, cb: np.ndarray, same_part: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of words that are one edit apart; of a part with itself, each pair once."""
    va, vb = letter_counts(ca), letter_counts(cb)
    squared = (va * va).sum(1)[:, None] + (vb * vb).sum(1)[None, :] - 2 * (va @ vb.T)
    i, j = np.nonzero(squared == (2 if ca.shape[1] == cb.shape[1] else 1))
    if same_part:
        i, j = i[i < j], j[i < j]
    keep = one_edit(ca[i], cb[j])
    return i[keep], j[keep]


def near_pairs(words: DataFrame, part: int = PART) -> DataFrame:
    """(a, b, n_a, n_b) of distinct words (word, n) that one edit leads to each other, each pair once.

    A row is a part of a block, so that what is joined are parts. A block's parts come from its number of words:
    no block is too large for a task, and no pair is left out.
    """
    sums = [sum((F.length("word") - F.length(F.replace(F.col("word"), F.lit(c), F.lit("")))) for c in g).cast("int") for g in GROUPS]
    keyed = shared.written(words.select("word", "n", F.array(F.length("word").cast("int"), *sums).alias("block")))
    blocks = keyed.groupBy("block").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    cut = keyed.join(blocks, "block").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    packed = shared.written(cut.groupBy("block", "parts", "part").agg(F.array_join(F.collect_list("word"), "").alias("words"), F.collect_list("n").alias("ns")))
    # blocks that an edit leads to, each pair of blocks once: a letter more, or one letter for another of a later block
    g, steps = len(GROUPS), []
    unit = lambda i, by: [by if k == i else 0 for k in range(g)]
    steps += [[1, *unit(i, 1)] for i in range(-1, g)]
    swaps = [[x + y for x, y in zip(unit(i, 1), unit(j, -1))] for i in range(-1, g) for j in range(-1, g) if i != j]
    steps += [[0] * (g + 1), *([0, *s] for s in swaps if next(x for x in s if x) > 0)]
    to = F.explode(F.array(*(F.array(*map(F.lit, s)) for s in steps))).alias("step")
    one = packed.select(F.col("block").alias("own"), F.col("part").alias("part_a"), F.col("words").alias("a"), F.col("ns").alias("na"), to)
    one = one.withColumn("block", F.zip_with("own", "step", lambda x, y: x + y))
    two = packed.select("block", F.col("part").alias("part_b"), F.col("words").alias("b"), F.col("ns").alias("nb"))
    same = F.col("own") == F.col("block")
    tasks = one.join(two, "block").filter(~same | (F.col("part_a") <= F.col("part_b"))).select("a", "na", "b", "nb", (same & (F.col("part_a") == F.col("part_b"))).alias("same"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            found: list[tuple] = []
            for a, na, b, nb, same in zip(t["a"], t["na"], t["b"], t["nb"], t["same"]):
                ca, cb = _codes(a, len(na)), _codes(b, len(nb))
                i, j = near(ca, cb, same)
                x, y = ca.shape[1], cb.shape[1]
                found += [(a[k * x : k * x + x], b[m * y : m * y + y], na[k], nb[m]) for k, m in zip(i.tolist(), j.tolist())]
            yield pd.DataFrame(found, columns=["a", "b", "n_a", "n_b"])

    return tasks.mapInPandas(run, "a string, b string, n_a long, n_b long")


def variants(docs: DataFrame, ratio: int = RATIO, part: int = PART) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts.

    form: the near word of largest n, ties by code points, if it is `ratio` times as frequent at least. root:
    where the forms of forms end; every step multiplies n, so they do. Empty tables give no rows.
    """
    words = shared.written(counted(docs))
    pairs = shared.written(near_pairs(words, part))
    both = pairs.union(pairs.select("b", "a", "n_b", "n_a"))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("near"))).alias("best"))
    rows = words.join(best, "word", "left")
    takes = -F.col("best.less") >= ratio * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"))
    rows = shared.written(rows)
    # each round doubles the steps to the root
    up = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = shared.written(up)
        next_up = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = up.join(next_up, "root", "left")
        if joined.filter("further is not null").isEmpty():
            break
        up = joined.select("word", F.coalesce("further", "root").alias("root"))
    return rows.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
