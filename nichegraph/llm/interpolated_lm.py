"""Language-model scoring by deleted interpolation of word n-grams.

A token's probability mixes the maximum-likelihood estimates of its bigram and unigram with a uniform one.
The weights depend on the bucket of the context's frequency and are learned by expectation-maximisation on
counts that leave out the occurrence they predict.

Documents are dealt to batches. A batch asks for the counts of its distinct n-grams only, once each, however
often it has them; the counts are added up by ranges of the n-grams' hashes, and each batch gets its answers
back. So a frequent n-gram costs one row per batch, no table of counts has to fit in one place, and no token
is shuffled by itself. A batch has a row for each range that it has n-grams of, so never more rows than n-grams.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bytes of text in a batch and per range of n-gram hashes, in the mean.
BATCH_BYTES, RANGE_BYTES = 8 << 20, 12 << 20
#: Buckets of context frequency, by powers of two; rounds of expectation-maximisation, from equal weights.
BUCKETS, ROUNDS = 32, 10
#: Tokens whose probabilities are worked out at once.
AT_ONCE = 1 << 18
END, START = np.uint64(1), np.uint64(2)


class Hashes(dict):
    """64-bit hashes of words, as many as it may hold."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def packed(ascending: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte of their rank, which compresses to the bytes that vary."""
    return np.diff(ascending, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def planes(numbers: np.ndarray) -> bytes:
    """Small counts as 32-bit numbers, byte by byte of their rank; a count beyond that as 64-bit ones."""
    wide = numbers.astype("<u8" if len(numbers) and numbers.max() >= 1 << 32 else "<u4")
    return wide.view(np.uint8).reshape(len(wide), wide.itemsize).T.tobytes()


def from_planes(data: bytes, n: int) -> np.ndarray:
    size = len(data) // n if n else 4
    return np.frombuffer(data, np.uint8).reshape(size, n).T.copy().view(f"<u{size}").ravel().astype(np.int64)


class Batch:
    """The tokens of some texts as hashes, with their distinct n-grams of two orders."""

    def __init__(self, texts: list[str], times: np.ndarray, train: np.ndarray, hashes: Hashes, ranges: int):
        parts = []
        for t in texts:
            words = t.encode("utf-8", "replace").lower().split()
            parts.append(np.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), END))
        self.sizes = np.array([len(p) for p in parts])
        self.tokens = np.concatenate(parts)
        self.starts = np.cumsum(self.sizes) - self.sizes
        before = np.concatenate([[START], self.tokens[:-1]])
        before[self.starts] = START
        self.train, self.times = np.repeat(train, self.sizes), np.repeat(times, self.sizes)
        with np.errstate(over="ignore"):
            pair = before * np.uint64(0x9E3779B97F4A7C15) ^ (self.tokens + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
            pair ^= pair >> np.uint64(32)
            pair *= np.uint64(0xD6E8FEB86659FD93)
            pair ^= pair >> np.uint64(29)
        del before, parts
        self.orders, self.cuts = [], []
        for keys in (self.tokens, pair):
            distinct, at = np.unique(keys, return_inverse=True)
            self.orders.append((distinct, at.astype(np.int32)))
            there, starts = np.unique((distinct >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), return_index=True)  # ranges that it has n-grams of
            self.cuts.append((there.tolist(), [*starts.tolist(), len(distinct)]))

    def asks(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(range, order, keys, counts in training texts) of each range of hashes that has some."""
        for order, ((keys, at), (there, cuts)) in enumerate(zip(self.orders, self.cuts)):
            counts = np.bincount(at[self.train], self.times[self.train], len(keys)).astype(np.int64)
            for r, a, b in zip(there, cuts, cuts[1:]):
                yield r, order, packed(keys[a:b]), planes(counts[a:b])

    def counts(self, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
        """Counts in all training texts of each token's bigram and of the token itself, and of texts, which are the starts."""
        known = []
        for order, (keys, _) in enumerate(self.orders):
            some = answers[answers["gram"] == order].sort_values("range")
            sizes = np.diff(self.cuts[order][1])
            known.append(np.concatenate([from_planes(c, n) for c, n in zip(some["counts"], sizes, strict=True)]))
            if len(known[-1]) != len(keys):
                raise ValueError("a batch's answers don't fit its n-grams")
        (words, at), (_, pair_at) = self.orders
        return known[1][pair_at], known[0][at], int(known[0][np.searchsorted(words, END)])  # as many starts as ends


def contexts(one: np.ndarray, starts: np.ndarray, texts: int) -> np.ndarray:
    """The count of what stands before each token: the token before, or at places `starts` the start of a text."""
    out = np.concatenate([[0], one[:-1]])
    out[starts] = texts
    return out


def narrow(numbers: np.ndarray) -> bytes:
    """Counts as numbers of 2, 4 or 8 bytes."""
    top = int(numbers.max()) if len(numbers) else 0
    return numbers.astype("<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def parts(rows: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of a table of counted(), some at a time: their rows, where each starts, and the counts of bigrams, contexts and tokens."""
    sizes = rows["n_tokens"].to_numpy(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < len(rows):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + AT_ONCE, side="right")))
        some, n = slice(first, last), sizes[first:last]
        pair, one = (np.concatenate([np.frombuffer(x, f"<u{len(x) // k}").astype(np.int64) for x, k in zip(rows[c].iloc[some], n)]) for c in ("pair", "one"))
        starts = np.cumsum(n) - n
        yield some, starts, pair, contexts(one, starts, int(rows["texts"].iat[0])), one
        first = last


def estimates(pair: np.ndarray, context: np.ndarray, one: np.ndarray, total: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The context's bucket, and the probabilities of bigram, unigram and any word, a column each."""
    bucket = np.minimum(np.log2(context + 1.0).astype(np.int64), BUCKETS - 1)
    return bucket, np.stack([pair / np.maximum(context, 1), one / max(1, total), np.full(len(pair), 1 / (words + 1))], axis=1)


def counted(docs: DataFrame, divisor: int = 7, remainder: int = 2) -> DataFrame:
    """A written table with, of kind "text", the counts of each document's bigrams and tokens in order; of kind
    "total", the numbers of tokens and of distinct ones in training texts."""
    rows = shared.texts(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches, ranges = max(1, -(-size // BATCH_BYTES)), max(1, -(-size // RANGE_BYTES))
    rows = shared.distinct_rows(rows)
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch"), F.col("doc_id").cast("string").alias("doc_id"), "text", "times", (~shared.held_out(F.col("doc_id"), divisor, remainder)).alias("train"))

    def batch(rows: pd.DataFrame) -> Batch:
        return Batch(rows["text"].tolist(), rows["times"].to_numpy(np.int64), rows["train"].to_numpy(bool), Hashes(), ranges)

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(list(batch(rows).asks()), columns=["range", "gram", "keys", "counts"])
        return out.assign(batch=int(rows["batch"].iat[0]))[["range", "gram", "batch", "keys", "counts"]]

    def answer(asked: pd.DataFrame) -> pd.DataFrame:
        out, totals = [], [0, 0]
        for order, some in asked.groupby("gram"):
            keys = [unpacked(k) for k in some["keys"]]
            ends = np.cumsum([len(k) for k in keys])
            counts = np.concatenate([from_planes(c, len(k)) for c, k in zip(some["counts"], keys)])
            keys = np.concatenate(keys)
            every, at = np.unique(keys, return_inverse=True)
            del keys
            sums = np.bincount(at, counts, len(every)).astype(np.int64)
            del every, counts
            if not order:
                totals = [int(sums.sum()), int((sums > 0).sum())]
            out += [(b, order, planes(c)) for b, c in zip(some["batch"], np.split(sums[at], ends[:-1]))]
        out = pd.DataFrame(out, columns=["batch", "gram", "counts"]).assign(range=int(asked["range"].iat[0]))
        end = pd.DataFrame({"batch": [-1], "gram": [-1], "counts": [json.dumps(totals).encode()], "range": [int(asked["range"].iat[0])]})
        return pd.concat([out, end])[["batch", "gram", "range", "counts"]]

    schema = "kind string, doc_id string, times long, train boolean, n_tokens long, n_known long, texts long, base double, pair binary, one binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def code(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            totals = np.sum([json.loads(c) for c in answers["counts"]], axis=0)
            return pd.DataFrame([("total", None, None, None, int(totals[0]), int(totals[1]), None, None, None, None)], columns=names)
        b, ids = batch(rows), rows[["doc_id", "times", "train"]].copy()
        del rows  # what is no longer needed goes at once: a worker's memory is what bounds the size of a batch
        pair, one, texts = b.counts(answers)
        del answers, b.orders, b.tokens
        out = []
        for doc_id, times, train, start, n in zip(ids["doc_id"], ids["times"], ids["train"], b.starts, b.sizes):
            part = one[start : start + n]
            out.append(("text", doc_id, int(times), bool(train), int(n), int((part > 0).sum()), texts, float(np.log10(part + 1.0).sum()), narrow(pair[start : start + n]), narrow(part)))
        return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("times", "n_tokens", "n_known", "texts")})

    asked = rows.groupBy("batch").applyInPandas(ask, "range int, gram int, batch int, keys binary, counts binary")
    answered = asked.groupBy("range").applyInPandas(answer, "batch int, gram int, range int, counts binary")
    answered = answered.toDF("to", "gram", "range", "counts")
    return shared.written(rows.groupBy("batch").cogroup(answered.groupBy("to")).applyInPandas(code, schema), "zstd")


def trained(table: DataFrame, rounds: int = ROUNDS) -> tuple[int, int, np.ndarray]:
    """Training tokens, distinct ones, and BUCKETS x 3 mixture weights; of a bucket without counts, those of lower orders only.

    A round of expectation-maximisation reads the counts of all training texts where they are, each less the
    occurrence itself; BUCKETS x 3 sums reach the driver.
    """
    total = table.filter("kind = 'total'").agg(F.sum("n_tokens"), F.sum("n_known")).first()
    total, words = int(total[0] or 0), int(total[1] or 0)
    learn = table.filter("kind = 'text' and train").select("times", "n_tokens", "texts", "pair", "one")
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds if total else 0):

        def expected(batches: Iterator[pd.DataFrame], weights: np.ndarray = weights) -> Iterator[pd.DataFrame]:
            sums = np.zeros((3, BUCKETS))
            for b in batches:
                times, sizes = b["times"].to_numpy(np.int64), b["n_tokens"].to_numpy(np.int64)
                for some, _, pair, context, one in parts(b):
                    bucket, p = estimates(pair - 1, context - 1, one - 1, total, words)
                    share = weights[bucket] * p
                    share *= (np.repeat(times[some], sizes[some]) / share.sum(1))[:, None]
                    sums += [np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)]
            yield pd.DataFrame({"bucket": np.arange(BUCKETS), "two": sums[0], "one": sums[1], "any": sums[2]})

        sums = learn.mapInPandas(expected, "bucket int, two double, one double, any double").groupBy("bucket").agg(F.sum("two"), F.sum("one"), F.sum("any")).orderBy("bucket").collect()
        sums = np.array([list(r)[1:] for r in sums]) + [1e-9, 1e-6, 1e-6]
        weights = sums / sums.sum(1, keepdims=True)
    return total, words, weights if total else np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))


def scored(docs: DataFrame, divisor: int = 7, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per document.

    Null texts are empty and have the end token alone. Without training texts every token has the
    probability 1 of the only word there is. Repeated rows are counted and scored as often as they come.
    """
    table = counted(docs, divisor, remainder)
    total, words, weights = trained(table)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [np.zeros(0)]
            for _, starts, pair, context, one in parts(b):
                bucket, p = estimates(pair, context, one, total, words)
                out.append(np.add.reduceat(np.log10((weights[bucket] * p).sum(1)), starts))
            yield b[["doc_id", "times", "n_tokens", "n_known", "base"]].assign(score=np.concatenate(out))

    rows = table.filter("kind = 'text'").select("doc_id", "times", "n_tokens", "n_known", "texts", "base", "pair", "one").mapInPandas(score, "doc_id string, times long, n_tokens long, n_known long, base double, score double")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    base = F.col("base") - F.col("n_tokens") * float(np.log10(total + words + 1))
    rows = rows.select("doc_id", "times", shared.held_out(F.col("doc_id"), divisor, remainder).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
    return rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy")).drop("times", "copy")
