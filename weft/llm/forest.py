"""Near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import linked
from .common import components, stored

#: The trees are fitted on this many vectors at most (fewer if their numbers pass SAMPLE_BYTES).
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
TREES, LEAF = 6, 2000
#: A node keeps this many sampled vectors at least; below it leaves are halved by rule, see Leaf.
LEAST = 16
#: Half the width of the band whose vectors go to both sides, in standard deviations of the
#: projected difference of two vectors at the threshold.
SPILL = 0.5
EXTRA = 40


@dataclass
class Split:
    direction: np.ndarray
    at: float
    left: object
    right: object


@dataclass
class Leaf:
    """Vectors that the sample cannot split further are halved ``levels`` times by directions that
    all leaves of a tree share, near the middle of the leaf's sample."""
    number: int
    middle: np.ndarray
    levels: int


def fit(sample: np.ndarray, total: int, threshold: float, seed: int = 11, trees: int = TREES, leaf: int = LEAF) -> list:
    """Trees of recursive random splits of unit vectors: (root, directions of the halvings)."""
    width = sample.shape[1] if sample.ndim == 2 and len(sample) else 1
    band = SPILL * math.sqrt(2 - 2 * threshold) / math.sqrt(width)
    scale = total / max(1, len(sample))
    forest = []
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        count = 0

        def grow(rows):
            nonlocal count
            full = len(rows) * scale
            best = None
            if full > leaf and len(rows) >= 2 * LEAST:
                for _ in range(4):
                    r = rng.standard_normal(width)
                    r /= np.linalg.norm(r)
                    p = sample[rows] @ r
                    at = np.quantile(p, rng.uniform(0.35, 0.65))
                    left, right = rows[p < at + band], rows[p > at - band]
                    if best is None or max(len(left), len(right)) < max(len(best[2]), len(best[3])):
                        best = r, at, left, right
                if max(len(best[2]), len(best[3])) > 0.85 * len(rows):
                    best = None
            if best is None:
                count += 1
                dense = full > leaf and len(rows) >= 2 * LEAST
                return Leaf(count - 1, sample[rows].mean(axis=0) if len(rows) else np.zeros(width),
                            0 if dense or full <= leaf else min(EXTRA, math.ceil(math.log2(full / leaf))))
            return Split(best[0], best[1], grow(best[2]), grow(best[3]))
        root = grow(np.arange(len(sample)))
        more = rng.standard_normal((EXTRA, width))
        forest.append((root, more / np.linalg.norm(more, axis=1, keepdims=True), rng.uniform(-0.5, 0.5, EXTRA) / math.sqrt(width), band))
    return forest


def cells(vectors: np.ndarray, forest: list) -> list[list[tuple[int, int, int]]]:
    """For each unit vector its leaves as (tree, leaf, side bits), in that order."""
    out: list[list] = [[] for _ in range(len(vectors))]
    for t, (root, more, shift, band) in enumerate(forest):
        todo = [(root, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if isinstance(node, Split):
                p = vectors[rows] @ node.direction
                todo += [(node.left, rows[p < node.at + band]), (node.right, rows[p > node.at - band])]
                continue
            parts = [(0, rows)]
            for level in range(node.levels):
                at = node.middle @ more[level] + shift[level]
                halves = []
                for bits, some in parts:
                    p = vectors[some] @ more[level]
                    halves += [(2 * bits, some[p < at + band]), (2 * bits + 1, some[p > at - band])]
                parts = [x for x in halves if len(x[1])]
            for bits, some in parts:
                for i in some:
                    out[i].append((t, node.number, bits))
    return [sorted(x) for x in out]


def _unit(rows: np.ndarray) -> np.ndarray:
    peak = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / peak
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def valid(vector: Column) -> Column:
    """True for vectors that can have a cosine: finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _cell_column(classes: DataFrame, forest: list) -> DataFrame:
    handle = classes.sparkSession.sparkContext.broadcast(forest)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("unit").to_pylist()
            by_width: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_width.setdefault(len(v), []).append(i)
            found: list = [None] * len(vectors)
            for width, rows in by_width.items():
                if width in handle.value:
                    for i, c in zip(rows, cells(np.array([vectors[i] for i in rows], float), handle.value[width])):
                        found[i] = [f"{width}:{t}:{leaf}:{bits}" for t, leaf, bits in c]
                else:
                    for i in rows:
                        found[i] = [f"{width}"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "cells"])
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(assign, f"{kind}, cells array<string>")


def _ready(frame: pd.DataFrame) -> dict:
    """The members' arrays; ``earlier`` holds the keys before the one they meet under."""
    earlier = np.zeros((len(frame), max(1, int(frame["place"].max()))), np.int64)
    known = np.zeros(earlier.shape, bool)
    for i, (keys, place) in enumerate(zip(frame["keys"], frame["place"])):
        earlier[i, :place], known[i, :place] = keys[:place], True
    width = frame["unit"].map(len).to_numpy()
    units = np.zeros((len(frame), width.max()))
    for w in np.unique(width):
        units[width == w, :w] = np.stack(frame["unit"][width == w].to_list())
    return {"node": frame["node"].to_numpy(), "weight": frame["copies"].to_numpy(), "label": frame["label"].to_numpy(),
            "width": width, "unit": units, "earlier": earlier, "known": known}


def near_by_cosine(threshold: float):
    def near(left: dict, right: dict):
        adjacent = ((left["unit"] @ right["unit"].T >= threshold) & (left["label"][:, None] == right["label"][None, :])
                    & (left["width"][:, None] == right["width"][None, :]))
        rows, columns = np.nonzero(adjacent)
        for i in range(left["earlier"].shape[1]):
            for j in range(right["earlier"].shape[1]):
                if len(rows):
                    met = (left["known"][rows, i] & right["known"][columns, j]
                           & (left["earlier"][rows, i] == right["earlier"][columns, j]))
                    rows, columns = rows[~met], columns[~met]
        counted = np.zeros_like(adjacent)
        counted[rows, columns] = True
        return adjacent, counted
    return near


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, seed: int = 11, trees: int = TREES,
                    leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label with a cosine of ``threshold`` or more (double precision) link if
    some tree puts them into one leaf; no pair below it links. Equal vectors of a label are
    one class, counted with its copies, and always link. The trees are fitted on about
    ``sample`` classes drawn by hash; every class goes through every tree and into both sides near a
    cut. A pair counts in the first leaf that it shares, so no list of pairs is needed.
    Leaves of any size are compared whole, large ones by blocks.

    A null label, or a vector that is null, empty, zero or holds null or non-finite numbers,
    links with nothing: 0 links, a component of its own. Vectors of different lengths do not
    link. Rows with one vec_id are vectors of their own with that id; null ids are never the
    smallest. An empty table gives no rows; other columns are not read."""
    rows = stored(vectors.select(F.col("vec_id").alias("vec_id"), F.col("label").alias("label"),
                                 F.col("embedding").cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("row_id")))
    usable = valid(F.col("v")) & F.col("label").isNotNull()
    folded = rows.filter(usable).groupBy("label", F.transform("v", lambda x: x + 0.0).alias("v")).agg(
        F.min("row_id").alias("node"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))

    @F.pandas_udf("array<double>")
    def unit(vs: pd.Series) -> pd.Series:
        return pd.Series([_unit(np.array([v], float))[0] for v in vs])
    classes = stored(folded.withColumn("unit", unit("v")))
    total = classes.count()
    part = F.pmod(F.xxhash64("node"), F.lit(1 << 31)) < math.ceil(min(1.0, sample / max(1, total)) * (1 << 31))
    picked = classes.filter(part).select("unit").toPandas()["unit"]
    forest = {}
    for width in sorted({len(u) for u in picked}):
        some = [u for u in picked if len(u) == width][:max(LEAST, SAMPLE_BYTES // (8 * width))]
        forest[width] = fit(np.array(some, float), max(1, total * len(some) // len(picked)), threshold, seed, trees, leaf)
    keyed = stored(_cell_column(classes.select("node", "label", "unit", "copies"), forest).withColumn(
        "keys", F.transform("cells", lambda c: F.xxhash64("label", c))).drop("cells"))
    places = keyed.select("node", F.posexplode("keys").alias("place", "key"))
    met = stored(linked(places, keyed, _ready, near_by_cosine(threshold), group=2048).groupBy("node", "root").agg(F.sum("links").alias("links")))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = (classes.select("label", "v", "node", "least", "copies").join(roots, "node", "left").join(links, "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    best = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(best, "root").select(
        F.col("label").alias("l"), F.col("v").alias("w"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    key = F.when(usable, F.transform("v", lambda x: x + 0.0))
    out = rows.withColumn("k", key).join(known, (F.col("label") == F.col("l")) & (F.col("k") == F.col("w")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
