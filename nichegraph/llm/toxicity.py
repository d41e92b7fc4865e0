"""Toxicity: a factorization machine over hashed terms.

A text's features are its distinct words and the beginnings of longer ones, which inflected forms share, all
hashed. Beside a weight, each feature has a short vector, and each pair of features in a text adds the product
of their vectors: what an additive model misses.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled, shared

BITS, FACTORS = 18, 4
#: Letters of the beginnings that count as features of longer words.
BEGINNINGS = (4, 6)
#: Features that are learned: those in as many texts at least, whose share differs between the labels by so many standard errors,
LEAST_TEXTS, LEAST_Z = 5, 4.0
#: and pairs of the MOST_PAIRED most frequent features, in as many texts at least, of which each changes the share of label 1 within
#: the texts of the other by so many standard errors. Pairs are counted in PAIR_ROWS texts at most.
MOST_PAIRED, LEAST_TOGETHER, PAIR_Z, PAIR_ROWS = 1536, 20, 9.0, 20_000
EPOCHS, BATCH, RATE, DECAY = 20, 64, 0.2, 1e-4
#: Labelled rows that the machine is fitted on at most.
MOST_ROWS = 40_000
TERM = re.compile(r"[^\W\d_]+")


class Terms(dict):
    """Words and their features, as many as it may hold."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        terms = [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]
        self[word] = out = tuple(zlib.crc32(t.encode("utf-8", "replace")) & ((1 << BITS) - 1) for t in terms)
        return out


def features(text: str, terms: Terms) -> np.ndarray:
    """The distinct features of a text, ascending."""
    return np.unique(np.fromiter(chain.from_iterable(terms[w] for w in set(TERM.findall(text.lower()))), dtype=np.int32))


class Machine:
    """score: 1 / (1 + exp(-(bias + sum of w + sum over pairs of products of v))). Arrays have a row per feature."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def score(self, ids: np.ndarray) -> float:
        v = self.v[ids]
        s = v.sum(0)
        x = self.bias + self.w[ids].sum(dtype=np.float64) + 0.5 * float((s * s).sum() - (v * v).sum())
        return 1 / (1 + float(np.exp(-np.clip(x, -30, 30))))


def paired_features(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Features of pairs that tell about the label together, whether or not they do by themselves."""
    counts = np.bincount(np.concatenate(texts), minlength=1 << BITS)
    top = np.argsort(-counts, kind="stable")[:MOST_PAIRED]
    top = np.sort(top[counts[top] >= LEAST_TOGETHER])
    place = np.full(len(counts), -1)
    place[top] = np.arange(len(top))
    every, toxic = (np.zeros((len(top), len(top)), dtype=np.float32) for _ in range(2))
    for start in range(0, min(len(y), PAIR_ROWS), 2000):
        part, label = texts[start : start + 2000], y[start : start + 2000]
        at, of = place[np.concatenate(part)], np.repeat(np.arange(len(part)), [len(t) for t in part])
        has = np.zeros((len(part), len(top)), dtype=np.float32)
        has[of[at >= 0], at[at >= 0]] = 1
        every += has.T @ has
        toxic += has[label > 0].T @ has[label > 0]
    n, t = np.diag(every)[:, None], np.diag(toxic)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):  # row i, column j: within the texts of i, those with j against those without
        p = t / n
        z = np.abs(toxic / every - (t - toxic) / (n - every)) / np.sqrt((p * (1 - p) + 1e-9) * (1 / every + 1 / (n - every)))
    z[(every < LEAST_TOGETHER) | (n - every < LEAST_TOGETHER)] = 0
    return top[(np.minimum(z, z.T) >= PAIR_Z).any(1)]


def fit(texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """A machine fitted by adaptive gradient steps; features that tell nothing by themselves or in a pair stay at zero.

    With a label missing, the constant score of a smoothed share.
    """
    n = 1 << BITS
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    w, v = np.zeros(n, dtype=np.float32), np.zeros((n, FACTORS), dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return Machine(bias, w, v)
    toxic, rest = (np.bincount(np.concatenate([t for t, label in zip(texts, y) if label == k]), minlength=n) for k in (1, 0))
    p, some, others = (toxic + rest) / len(y), y.sum(), len(y) - y.sum()
    z = np.abs(toxic / some - rest / others) / np.sqrt((p * (1 - p) + 1e-9) * (1 / some + 1 / others))
    known = (toxic + rest >= LEAST_TEXTS) & (z >= LEAST_Z)
    known[paired_features(texts, y)] = True
    draw = np.random.default_rng(seed)
    v[known] = draw.normal(0, 0.01, (int(known.sum()), FACTORS))
    texts = [t[known[t]] for t in texts]
    gw, gv, gb = np.full(n, 1e-6, dtype=np.float32), np.full((n, FACTORS), 1e-6, dtype=np.float32), 1e-6
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for start in range(0, len(y), BATCH):
            rows = order[start : start + BATCH]
            ids = np.concatenate([texts[r] for r in rows])
            of = np.repeat(np.arange(len(rows)), [len(texts[r]) for r in rows])
            vx = v[ids]
            s = np.stack([np.bincount(of, vx[:, f], len(rows)) for f in range(FACTORS)], axis=1)
            squares = np.bincount(of, (vx * vx).sum(1), len(rows))
            x = bias + np.bincount(of, w[ids], len(rows)) + 0.5 * ((s * s).sum(1) - squares)
            e = 1 / (1 + np.exp(-np.clip(x, -30, 30))) - y[rows]
            gb += float(e.sum()) ** 2
            bias -= RATE * float(e.sum()) / np.sqrt(gb)
            some, at = np.unique(ids, return_inverse=True)
            dw = np.bincount(at, e[of], len(some)) + DECAY * w[some]
            gw[some] += dw * dw
            w[some] -= RATE * dw / np.sqrt(gw[some])
            dx = e[of, None] * (s[of] - vx)
            dv = np.stack([np.bincount(at, dx[:, f], len(some)) for f in range(FACTORS)], axis=1) + DECAY * v[some]
            gv[some] += dv * dv
            v[some] -= 0.1 * RATE * dv / np.sqrt(gv[some])
    return Machine(bias, w, v)


def trained(docs: DataFrame, labels: DataFrame, divisor: int = 5, remainder: int = 0) -> Machine:
    """A machine from the labels of documents that aren't held out; the features of at most MOST_ROWS rows reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "ids": [features(t, terms).tobytes() for t in b["text"]]})

    rows = labelled.training_rows(docs, labels, "toxic", divisor, remainder, MOST_ROWS)
    data = rows.mapInPandas(run, "doc_id long, label int, ids binary").toPandas().sort_values(["doc_id", "label"], kind="stable")
    return fit([np.frombuffer(b, dtype=np.int32) for b in data["ids"]], data["label"].to_numpy(np.float64))


def scored(docs: DataFrame, labels: DataFrame, divisor: int = 5, remainder: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document; null texts are scored as empty ones."""
    machine = trained(docs, labels, divisor, remainder)
    model = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))  # of fixed size: FACTORS + 1 numbers per feature

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, m = Terms(), Machine(*model.value)
        for b in batches:
            yield pd.Series([m.score(features(t, terms)) for t in b], dtype=np.float64)

    rows = shared.texts(docs).select("doc_id", score("text").alias("score"))
    return rows.select("doc_id", shared.held_out(F.col("doc_id"), divisor, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
