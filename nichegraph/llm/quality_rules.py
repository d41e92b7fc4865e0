"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are boosted on the statistics of labelled documents; the path to each of their nodes is a rule,
a conjunction of comparisons. A logistic regression with an L1 penalty weighs the rules and leaves most at
zero. What remains is a Spark column expression over the statistics.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled, shared

STATISTICS = ["size", "words", "upper", "digits", "spaces", "breaks", "periods", "bars", "signs", "high_bytes", "word_size", "longest_word", "distinct", "top_word", "same_as_before", "short_words", "odd_words", "repeated_lines", "line_size", "repeated_pairs"]
ROUNDS, DEPTH, BINS, RATE, LEAST_ROWS, PENALTY = 40, 3, 32, 0.3, 10, 2e-3


def statistics_of(text: str) -> list[float]:
    """The STATISTICS of a text; shares are of its bytes, words, lines or pairs of words, and 0 where it has none."""
    raw = text.encode("utf-8", "replace")
    n, of = max(1, len(raw)), np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    m, counts = max(1, len(words)), Counter(words)
    upper, lower, digits = of[65:91].sum(), of[97:123].sum(), of[48:58].sum()
    bars = of[124] + of[9]
    signs = of[33:127].sum() - upper - lower - digits - of[44] - of[46] - of[124]
    pairs = set(zip(words, words[1:]))
    sizes = [len(w) for w in words]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), upper / max(1, upper + lower), digits / n, of[32] / n, of[10] / n, of[46] / n, bars / n, signs / n, of[128:].sum() / n,
        sum(sizes) / m, max(sizes, default=0), len(counts) / m, max(counts.values(), default=0) / m, sum(map(bytes.__eq__, words, words[1:])) / m,
        sum(s <= 2 for s in sizes) / m, sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / m, 1 - len(set(lines)) / max(1, len(lines)), len(raw) / max(1, len(lines)), 1 - len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 0.0,
    ]


def statistics(text: Column) -> Column:
    """A struct of doubles named as STATISTICS; a null text counts as empty. Only the text goes to Python."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = np.array([statistics_of(t) for t in b], dtype=np.float64).reshape(len(b), len(STATISTICS))
            yield pd.DataFrame(values, columns=STATISTICS)

    return run(F.coalesce(text, F.lit("")))


@dataclass(frozen=True)
class Rules:
    """rules: conjunctions of (statistic's index, above, threshold), true where value > threshold equals above."""

    intercept: float
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]]

    def log_odds(self, values: Column) -> Column:
        """The rules as one expression over a struct of statistics."""
        out = F.lit(float(self.intercept))
        for parts, weight in self.rules:
            holds = F.lit(True)
            for k, above, t in parts:
                c = values[STATISTICS[k]]
                holds = holds & ((c > t) if above else (c <= t))
            out = out + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return out

    def score(self, values: Column) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(values)))


def best_cut(flat: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, int] | None:
    """The statistic and the place of the cut that gains most; None where no cut leaves LEAST_ROWS on both sides and gains."""
    if len(flat) < 2 * LEAST_ROWS:
        return None
    ids, shape = flat.ravel(), (len(cuts), BINS + 1)
    sums = [np.bincount(ids, np.repeat(v, shape[0]), shape[0] * shape[1]).reshape(shape).cumsum(1) for v in (g, h, np.ones(len(g)))]
    left, total = [s[:, :-1] for s in sums], [s[:, -1:] for s in sums]
    right = [t - s for s, t in zip(left, total)]
    gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - total[0] ** 2 / (total[1] + 1)
    gain[(left[2] < LEAST_ROWS) | (right[2] < LEAST_ROWS)] = -1
    for k, c in enumerate(cuts):
        gain[k, len(c) :] = -1
    k, i = np.unravel_index(np.argmax(gain), gain.shape)
    return (int(k), int(i)) if gain[k, i] > 1e-6 else None


def tree_rules(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> list[tuple[tuple[int, bool, float], ...]]:
    """The distinct rules of boosted trees' nodes, in the order in which they arise."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)  # bin <= i exactly if value <= cut i
    flat = bins + np.arange(x.shape[1]) * (BINS + 1)
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict[tuple, None] = {}
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p) + 1e-6
        level, leaves = [(np.arange(len(y)), ())], []
        for _ in range(depth):
            deeper = []
            for rows, path in level:
                cut = best_cut(flat[rows], g[rows], h[rows], cuts)
                if cut is None:
                    leaves.append(rows)
                    continue
                k, i = cut
                above = bins[rows, k] > i
                for side in (False, True):
                    way = (*path, (k, side, float(cuts[k][i])))
                    found[tuple(sorted(way))] = None
                    deeper.append((rows[above == side], way))
            level = deeper
        for rows in [*leaves, *(r for r, _ in level)]:
            margin[rows] += RATE * g[rows].sum() / (h[rows].sum() + 1)
    return list(found)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> Rules:
    """Rules fitted to statistics x and labels y; with a label missing, the constant log odds of a smoothed share."""
    if len(y) < 4 * LEAST_ROWS or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Rules(float(np.log(share / (1 - share))), [])
    rules = tree_rules(x, y)
    holds = np.ones((len(y), len(rules)), dtype=np.float32)
    for j, parts in enumerate(rules):
        for k, above, t in parts:
            holds[:, j] *= (x[:, k] > t) == above
    holds, y = np.hstack([np.ones((len(y), 1), dtype=np.float32), holds]), y.astype(np.float32)
    v = np.ones(holds.shape[1], dtype=np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = holds.T @ (holds @ v)
        top = np.linalg.norm(v)
        v /= top
    rate = 4 * len(y) / top
    w = z = np.zeros(holds.shape[1], dtype=np.float32)
    t = 1.0
    for _ in range(steps):
        gradient = holds.T @ (1 / (1 + np.exp(-(holds @ z))) - y) / len(y)
        new = z - rate * gradient
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (before - 1) / t * (new - w), new
    return Rules(float(w[0]), [(r, float(c)) for r, c in zip(rules, w[1:]) if abs(c) > 1e-4])


def trained(docs: DataFrame, labels: DataFrame, divisor: int = 3, remainder: int = 1) -> Rules:
    """Rules from the labels of documents that aren't held out; only their statistics, MOST_ROWS rows, reach the driver."""
    rows = labelled.training_rows(docs, labels, "quality", divisor, remainder)
    data = rows.select("doc_id", "label", statistics(F.col("text")).alias("s")).select("doc_id", "label", "s.*").toPandas()
    data = data.sort_values(["doc_id", "label", *STATISTICS], kind="stable")
    return fit(data[STATISTICS].to_numpy(), data["label"].to_numpy(np.float64))


def scored(docs: DataFrame, labels: DataFrame, divisor: int = 3, remainder: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document; null texts are scored as empty ones."""
    rules = trained(docs, labels, divisor, remainder)
    rows = shared.texts(docs).select("doc_id", statistics(F.col("text")).alias("s"))
    rows = rows.select("doc_id", shared.held_out(F.col("doc_id"), divisor, remainder).alias("held_out"), rules.score(F.col("s")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text's score is at least 0.5, with the columns of docs; null texts are scored as empty ones and stay null."""
    rules = trained(docs, labels)
    rows = docs.select(F.struct("*").alias("_row"), statistics(F.col("text")).alias("_s"))
    return rows.filter(rules.score(F.col("_s")) >= 0.5).select("_row.*")
