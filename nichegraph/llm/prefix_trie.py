"""The prefix trie of conversations by truncation peeling.

Conversations become paths of turn digests, equal paths one row. Sorted paths are dealt to ranges, and each task
peels its own from maximum depth: conversations that end at the depth join the surviving nodes, what shares a
prefix is one node and is summed up at once, and the last turn is stripped. Only nodes on a range's first and last
path can go on in other ranges: a range hands on these two paths, with what hangs off each depth, and so two rows
whatever it held. Those rows are peeled the same way in a next round, until one range is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: A conversation takes its opening from the first of so many ids, and at most so many turns less one.
FAMILY, OPENINGS = 20, 4
#: Turns of a range, about; ids of one stretch of an end's list, about, and stretches at most.
RANGE_TURNS, STRETCH, MOST_STRETCHES = 200_000, 4096, 10_000
DIGEST = 16
STATE = "path binary, words array<long>, ns array<long>, least array<long>, kids array<long>, leaves array<long>, saved array<long>, ends array<binary>"
NODE = "conv_id long, depth long, parent_conv_id long, parent_key binary, key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, sha binary"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: list of (digest, words)) in order of turn, null first; equal turns in order of their digests.

    Null roles and texts are empty. Rows without conv_id belong to no conversation. Digests are of role and
    text, so that no text is shuffled; a conversation's digests are one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(shared.WORD)).cast("long")
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), words.alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(convs: DataFrame, family: int = FAMILY, openings: int = OPENINGS) -> DataFrame:
    """Conversations whose first h turns are those of their family's first id (none if it is absent), h by crc32 of the id.

    The first id is conv_id less its remainder, which for ids below 0 is not above 0, as in SQL.
    """
    first = F.col("conv_id") - F.col("conv_id") % family
    heads = convs.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("of"), F.slice("turns", 1, openings - 1).alias("head"))
    rows = convs.join(heads, first == F.col("of"), "left").withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % openings).cast("int"))
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def ended(convs: DataFrame) -> DataFrame:
    """A state per distinct path: its conversations, the smallest of them, and the SHA-256 of their ids in order.

    Ids of a path are put together by stretches of ids, which several tasks share, and hashed stretch by stretch.
    """
    digests = F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")
    rows = shared.written(convs.select("conv_id", F.unhex(digests).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")))
    n = rows.count()
    k = min(MOST_STRETCHES, n // STRETCH)
    rows = rows.withColumn("stretch", F.lit(0.0))
    if k > 1:
        ids = rows.select(F.col("conv_id").cast("double").alias("id"))
        cuts = sorted(set(ids.approxQuantile("id", [i / k for i in range(1, k)], 1 / (4 * k))))
        rows = rows.withColumn("id", F.col("conv_id").cast("double"))
        rows = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="id", outputCol="stretch").transform(rows.drop("stretch"))
    key = F.unhex(F.md5("path")).alias("key")
    parts = rows.groupBy(key, "stretch").agg(F.first("path").alias("path"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None

        def state() -> dict:
            path, words, n, least, sha = now
            return {"path": path, "words": words, "ns": [n], "least": [least], "kids": [0], "leaves": [0], "saved": [0], "ends": [sha.digest()]}

        for b in batches:
            out = []
            for path, words, n, least, ids in zip(b["path"], b["words"], b["n"], b["least"], b["ids"]):
                if now is not None and now[0] == path:
                    now[4].update(b"," + ids.encode())
                    now[2], now[3] = now[2] + n, min(now[3], least)
                    continue
                if now is not None:
                    out.append(state())
                now = [path, words, n, least, hashlib.sha256(ids.encode())]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])
        if now is not None:
            yield pd.DataFrame([state()])

    return parts.repartition("key").sortWithinPartitions("key", "stretch").drop("key").mapInPandas(hashed, STATE)


class Range:
    """Sorted distinct paths of one task with what is known at their depths."""

    def __init__(self, rows: pd.DataFrame):
        self.paths, self.words = list(rows["path"]), [np.asarray(w, dtype=np.int64) for w in rows["words"]]
        self.size = np.array([len(p) // DIGEST for p in self.paths], dtype=np.int64)
        self.lcp = np.full(len(self.paths), -1, dtype=np.int64)  # with the row before; the first row shares nothing
        self.lcp[1:] = [self._common(a, b) for a, b in zip(self.paths, self.paths[1:])]
        lengths = np.array([len(x) for x in rows["ns"]])
        row = np.repeat(np.arange(len(rows)), lengths)
        ends = np.cumsum(lengths)
        depth = self.size[row] - (ends[row] - 1 - np.arange(len(row)))
        order = np.argsort(-depth, kind="stable")
        self.at, self.row = depth[order], row[order]
        self.sums = {c: np.concatenate([np.asarray(x, dtype=np.int64) for x in rows[c]])[order] for c in ("ns", "least", "kids", "leaves", "saved")}
        self.ends = [x for e in rows["ends"] for x in e]
        self.ends = [self.ends[i] for i in order]

    @staticmethod
    def _common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b)) // DIGEST
        x, y = (np.frombuffer(p[: n * DIGEST], dtype="<u8").reshape(n, 2) for p in (a, b))
        apart = (x != y).any(1)
        return int(apart.argmax()) if apart.any() else n

    def key(self, row: int, depth: int) -> bytes:
        return hashlib.md5(self.paths[row][: depth * DIGEST]).digest()

    def peel(self, last: bool, keyed: bool) -> tuple[list[dict], list[dict]]:
        """Nodes as columns, a dict per depth, and the states handed on: none in the last round.

        keyed: nodes get keys, as nodes of earlier rounds name them as their parents.
        """
        n_rows, top = len(self.paths), int(self.size.max())
        common = self._common(self.paths[0], self.paths[-1])
        spine = {0: [], n_rows - 1: []}  # from the deepest: what hangs off each depth
        act, lcp, by_size, taken = np.zeros(0, np.int64), np.zeros(0, np.int64), np.argsort(-self.size, kind="stable"), 0
        none = np.zeros(0, np.int64)
        nodes = {c: none for c in ("row", "ns", "least", "leaves", "saved")}  # of the depth below, closed ones
        event, out, waiting = 0, [], None
        for d in range(top, -1, -1):
            new = taken
            while taken < n_rows and self.size[by_size[taken]] >= d:
                taken += 1
            if taken > new:
                act = np.sort(by_size[:taken])
                first = np.concatenate([[0], act[:-1] + 1])
                lcp = np.minimum.reduceat(self.lcp[: act[-1] + 1], first)
            starts = act[np.flatnonzero(lcp < d)]
            stop = event + int(np.searchsorted(-self.at[event:], -d, side="right"))
            now = slice(event, stop)
            rows = np.concatenate([nodes["row"], self.row[now]])
            group = np.searchsorted(starts, rows, side="right") - 1
            is_node = np.arange(len(rows)) < len(nodes["row"])
            got = {c: np.concatenate([nodes[c], self.sums[c][now]]) for c in ("ns", "leaves", "saved", "least")}
            kids = np.bincount(group, weights=np.concatenate([np.ones(len(nodes["row"])), self.sums["kids"][now]]), minlength=len(starts)).astype(np.int64)
            total = {c: np.zeros(len(starts), np.int64) for c in ("ns", "leaves", "saved")}
            for c, x in total.items():
                np.add.at(x, group, got[c])
            least = np.full(len(starts), np.iinfo(np.int64).max)
            np.minimum.at(least, group, got["least"])
            ends: dict[int, bytes] = {int(g): self.ends[e] for g, e in zip(group[len(nodes["row"]):], range(event, stop)) if self.ends[e] is not None}
            open_at: dict[int, int] = {}
            if not last:
                for r in spine:
                    if self.size[r] >= d and (r == 0 or d > common):
                        g = int(np.searchsorted(starts, r, side="right") - 1)
                        open_at[g] = r
                        spine[r].append((total["ns"][g], least[g], kids[g], total["leaves"][g], total["saved"][g], ends.get(g)))
            if waiting is not None:  # the depth below learns its parents
                parents = group[is_node]
                far = np.isin(parents, list(open_at))
                waiting["parent_conv_id"] = pd.array([None if f else int(least[p]) for f, p in zip(far, parents)], dtype="Int64")
                waiting["parent_key"] = [self.key(int(starts[p]), d) if f else None for f, p in zip(far, parents)]
                out.append(waiting)
            closed = np.array([g not in open_at for g in range(len(starts))], dtype=bool) if open_at else np.ones(len(starts), bool)
            words = np.array([self.words[r][d - 1] if d else 0 for r in starts], dtype=np.int64)
            leaves = np.where(kids == 0, 1, total["leaves"])
            saved = total["saved"] + (total["ns"] - 1) * words
            nodes = {"row": starts[closed], "ns": total["ns"][closed], "least": least[closed], "leaves": leaves[closed], "saved": saved[closed]}
            at = np.flatnonzero(closed)
            waiting = {
                "conv_id": nodes["least"], "depth": np.full(len(at), d), "key": [self.key(int(starts[g]), d) if keyed else None for g in at], "n_convs": nodes["ns"],
                "n_children": kids[closed], "n_leaves": nodes["leaves"], "saved_tokens": nodes["saved"], "sha": [ends.get(int(g)) for g in at],
            }
            event = stop
        waiting["parent_conv_id"], waiting["parent_key"] = pd.array([None] * len(waiting["conv_id"]), dtype="Int64"), [None] * len(waiting["conv_id"])
        states = []
        for r, found in ({} if last else spine).items():
            if found:
                columns = [list(x) for x in zip(*reversed(found))]
                states.append({"path": self.paths[r], "words": self.words[r], **dict(zip(("ns", "least", "kids", "leaves", "saved", "ends"), columns))})
        return [*out, waiting], states


def peeled(states: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """Nodes (NODE's columns) of all states; those whose parent was closed in a later round name it by parent_key."""
    names = [c.split()[0] for c in STATE.split(", ")]
    node_names = [c.split()[0] for c in NODE.split(", ")]
    both = f"{STATE}, {NODE}"
    states, found, keyed = shared.written(states), None, False
    while True:
        n, turns = states.agg(F.count("*"), F.sum(F.size("words"))).first()
        if not n:
            break
        parts = min(-(-(turns + n) // range_turns), -(-n // 4))  # ranges of few rows would hand on as many
        last = parts <= 1

        def run(batches: Iterator[pd.DataFrame], last: bool = last, keyed: bool = keyed) -> Iterator[pd.DataFrame]:
            every = [b for b in batches if len(b)]
            if not every:
                return
            nodes, handed = Range(pd.concat(every, ignore_index=True)).peel(last, keyed)
            for x in [*(pd.DataFrame(x) for x in nodes), pd.DataFrame(handed)]:
                if len(x):
                    yield x.assign(**{c: pd.Series([None] * len(x), dtype=object) for c in names + node_names if c not in x})

        dealt = states.coalesce(1) if last else states.repartitionByRange(parts, "path")
        out = shared.written(dealt.sortWithinPartitions("path").mapInPandas(run, both))
        nodes = out.filter("depth is not null").select(*node_names)
        found = nodes if found is None else found.unionByName(nodes)
        if last:
            break
        states, keyed = out.filter("depth is null").select(*names), True
    return states.sparkSession.createDataFrame([], NODE) if found is None else found


def trie(turns: DataFrame, family: int = FAMILY, openings: int = OPENINGS, range_turns: int = RANGE_TURNS) -> DataFrame:
    """A row per distinct prefix of the rebuilt conversations, the textless root included.

    (conv_id: smallest member, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.)
    No conversations, no rows. Repeated rows are turns of their own; turnless conversations end at the root.
    """
    nodes = peeled(ended(rebuilt(conversations(turns), family, openings)), range_turns)
    near = nodes.filter("parent_key is null")
    keys = nodes.filter("key is not null").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"), F.col("n_children").alias("n"))
    far = shared.with_class(nodes.filter("parent_key is not null"), keys, "parent_key").withColumn("parent_conv_id", F.col("found")).drop("found")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return near.unionByName(far.select(*near.columns)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce(F.lower(F.hex("sha")), none).alias("ends_sha256"))
