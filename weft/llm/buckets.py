"""Links inside buckets: all members of a bucket are compared, no pair leaves the task.

A bucket over ``block`` members is cut into blocks and each pair of blocks is a group of
its own, so the largest task meets block x block members whatever a bucket holds, and
every pair is still met. Small buckets share a group. A group answers with one row per
member: how many links it has there, and the smallest member that its links reach."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
STEP = 256


def _met(left: dict, right: dict | None, near: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, links, label of the members; links across if ``right`` is given, else within ``left``."""
    n, first = len(left["node"]), 0 if right is None else len(left["node"])
    node = left["node"] if right is None else np.concatenate([left["node"], right["node"]])
    label, links = np.arange(len(node)), np.zeros(len(node), np.int64)
    for lo in range(0, n, STEP):
        start = lo if right is None else 0
        part = {k: v[lo:lo + STEP] for k, v in left.items()}
        other = {k: v[start:] for k, v in left.items()} if right is None else right
        adjacent, counted = near(part, other)
        if right is None:
            later = np.arange(start, n)[None, :] > np.arange(lo, lo + len(part["node"]))[:, None]
            adjacent, counted = adjacent & later, counted & later
        links[lo:lo + len(part["node"])] += counted @ other["weight"]
        links[first + start:] += part["weight"] @ counted
        for r in np.flatnonzero(adjacent.any(axis=1)):
            ends = np.unique(label[np.append(first + start + np.flatnonzero(adjacent[r]), lo + r)])
            if len(ends) > 1:
                label[np.isin(label, ends)] = ends[0]
    return node, links, label


def _dealt(rows: DataFrame, members: DataFrame | None, compare: Callable, schema: str, block: int, group: int) -> DataFrame:
    """compare(frame, across) per group of buckets; across: two blocks of one bucket, by _side.
    What ``members`` knows of a node is joined to the keys of its buckets with two or more only."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    groups = max(64, total // group)
    blocks = F.ceil(F.col("_n") / block).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("_m").cast("bigint")).cast("int")
    met = (rows.join(sizes, "key").withColumn("_m", blocks).withColumn("_c", mine)
           .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))))
    met = met.withColumns({
        "_g": F.when(F.col("_m") == 1, F.pmod(F.xxhash64("key"), F.lit(groups))).otherwise(F.col("key")),
        "_i": F.least("_c", "_o"), "_j": F.greatest("_c", "_o"), "_side": (F.col("_c") > F.col("_o")).cast("int")}).drop("_n", "_c", "_o")
    if members is not None:
        met = met.join(members, "node")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "_side", "node"], kind="stable")
        return compare(frame, frame["_i"].iloc[0] != frame["_j"].iloc[0])
    return met.groupBy("_g", "_m", "_i", "_j").applyInPandas(run, schema)


def _segments(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = frame["key"].to_numpy()
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return cuts, np.append(cuts[1:], len(frame))


def linked(rows: DataFrame, members: DataFrame | None, prepare: Callable, near: Callable, block: int = BLOCK, group: int = 8192) -> DataFrame:
    """node, links, root for the members of buckets with two or more.

    rows: key (bucket), node, distinct; members: node and what else ``prepare`` needs, if anything.
    prepare(frame) makes a dict of arrays with ``node`` and ``weight`` among them, one item
    per member; near(a, b) takes two of them (or slices) and returns two boolean matrices:
    which pairs link, and which of them count."""
    def compare(frame: pd.DataFrame, across: bool) -> pd.DataFrame:
        sides = frame["_side"].to_numpy()
        ready, out = prepare(frame), []
        for lo, hi in zip(*_segments(frame)):
            turn = lo + int((sides[lo:hi] == 0).sum()) if across else hi
            node, links, label = _met({k: v[lo:turn] for k, v in ready.items()},
                                      {k: v[turn:hi] for k, v in ready.items()} if across else None, near)
            named = np.full(len(label), np.iinfo(np.int64).max)
            np.minimum.at(named, label, node)
            out.append((node, links, named[label]))
        node, links, root = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"node": node, "links": links, "root": root})
    return _dealt(rows, members, compare, "node bigint, links bigint, root bigint", block, group)


def _best_forest(weight: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest with the largest weights, over weights of ``least`` or more."""
    n = len(weight)
    best, source, todo, out = np.full(n, -np.inf), np.zeros(n, np.int64), np.ones(n, bool), []
    for _ in range(n):
        at = int(np.where(todo, best, -np.inf).argmax())
        if best[at] < least or not todo[at]:
            at = int(todo.argmax())
        else:
            out.append((int(source[at]), at))
        todo[at] = False
        nearer = todo & (weight[at] > best)
        best[nearer], source[nearer] = weight[at][nearer], at
    return out


def likeliest(rows: DataFrame, members: DataFrame, prepare: Callable, weigh: Callable, least: float, best: int = 0,
              block: int = 1024, group: int = 8192) -> DataFrame:
    """a, b (a > b), distinct: for each bucket a spanning forest of the pairs with the largest
    weights, among those of ``least`` or more, and the ``best`` partners of each member: at most
    1 + ``best`` pairs per member and bucket.
    weigh(a, b, pairwise) gives the weights of equally long a and b, or of all pairs."""
    def compare(frame: pd.DataFrame, across: bool) -> pd.DataFrame:
        sides = frame["_side"].to_numpy()
        ready = prepare(frame)
        node, (lo, hi) = ready["node"], _segments(frame)
        two = lo[(hi - lo == 2)] if not across else lo[:0]
        keep = two[weigh({k: v[two] for k, v in ready.items()}, {k: v[two + 1] for k, v in ready.items()}, True) >= least] if len(two) else two
        left, right = [node[keep]], [node[keep + 1]]
        for a, b in zip(lo, hi):
            if b - a > 2 or across:
                own = {k: v[a:b] for k, v in ready.items()}
                weight = weigh(own, own, False)
                if across:
                    weight = np.where(sides[a:b][:, None] != sides[a:b][None, :], weight, -1.0)
                pairs = np.array(_best_forest(weight, least), np.int64).reshape(-1, 2)
                if best:
                    top = np.argsort(-weight, axis=1, kind="stable")[:, :best]
                    i = np.repeat(np.arange(b - a), top.shape[1])
                    good = weight[i, top.ravel()] >= least
                    pairs = np.vstack([pairs, np.column_stack([i, top.ravel()])[good]])
                left.append(own["node"][pairs[:, 0]])
                right.append(own["node"][pairs[:, 1]])
        x, y = np.concatenate(left), np.concatenate(right)
        return pd.DataFrame({"a": np.maximum(x, y), "b": np.minimum(x, y)}).drop_duplicates()
    return _dealt(rows, members, compare, "a bigint, b bigint", block, group).distinct()
