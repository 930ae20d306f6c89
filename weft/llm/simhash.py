"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import random
from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import likeliest, linked
from .common import components, filled, released, removed, stored, stored_at

BITS = 64
#: Shingles whose bits are held at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """64 bits: each is 1 if set in over half of the hashes of the word shingles (A-Z in lower
    case, repeats included). Fewer words than a shingle: one shingle. No word: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    n, ones = len(words) - size + 1, np.zeros(BITS, np.int64)
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(
            starts[lo:hi].tolist(), ends[lo + size - 1:hi + size - 1].tolist())], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def masks(radius: int = 3, seed: int = 5) -> list[int]:
    """2^(radius+1) - 1 masks so that any two fingerprints with ``radius`` or fewer differing bits
    agree under one of them.

    Each bit position has a vector of radius + 1 bits; mask v keeps the positions whose vector
    has an odd product with v. The vectors of ``radius`` positions never span the space, so some
    v has an even product with all of them, and its mask leaves out every differing bit."""
    top = 1 << (radius + 1)
    vectors = [i % (top - 1) + 1 for i in range(BITS)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ready(frame: pd.DataFrame) -> dict:
    node = np.ascontiguousarray(frame["node"].to_numpy(np.int64))
    return {"node": node, "bits": node.view(np.uint64), "weight": np.ones(len(node), np.int64)}


def near_within(radius: int):
    def near(left: dict, right: dict):
        close = np.bitwise_count(left["bits"][:, None] ^ right["bits"][None, :]) <= radius
        return close, close
    return near


def grouped(prints: DataFrame, radius: int = 3) -> DataFrame:
    """print, root, component_id for a table (doc_id, print): the smallest doc_id that chains
    of fingerprints with ``radius`` or fewer differing bits reach; root names the group.

    Equal fingerprints are one class. The classes go into one table per mask, and only
    buckets with two classes or more are compared, exactly. What leaves a bucket is a
    spanning forest, not its pairs."""
    classes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("print").bitwiseAND(F.lit(signed(m)))) for t, m in enumerate(masks(radius))])
    tables = classes.select(F.col("print").alias("node"), F.explode(keys).alias("key"))
    edges = linked(tables, None, _ready, near_within(radius)).filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(edges).withColumnRenamed("node", "print")
    placed = classes.join(roots, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    best = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(best, "root").select("print", "root", "component_id")


def print_of(text: Column, size: int = 3) -> Column:
    """The fingerprint of a text as a signed long."""
    @F.pandas_udf("bigint")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64))
    return prints(text)


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, print, component_id for every row of ``docs``.

    A null or empty text, or one of white space, has fingerprint 0 and links like any other.
    Rows with one doc_id are documents of their own with that id; null ids are never the
    smallest, and a group of null ids only has a null component. An empty table gives no
    rows. Other columns are not read."""
    prints = stored(docs.select(F.col("doc_id").alias("doc_id"), print_of(F.col("text"), size).alias("print")))
    return prints.join(grouped(prints, radius), "print").select("doc_id", "print", "component_id")


#: From the second meeting on a node names this many partners in each bucket.
AGAIN = 16
#: The documents' own dedup: word shingles, least Jaccard similarity, bits that fingerprints may differ in and how
#: many fingerprints (with hashes of their own) a document has, values of a sketch, and how far below ``LEAST`` a
#: sketch may say and a pair is still measured.
SHINGLE, LEAST, RADIUS, PRINTS, SKETCH, SLACK = 5, 0.8, 3, 6, 128, 0.14


def _shingles(words: list[bytes], size: int) -> np.ndarray:
    """The distinct hashes of the word shingles."""
    size = min(size, len(words))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + size]), 42) for i in range(len(words) - size + 1)], np.uint64))


@cache
def _factors() -> np.ndarray:
    return np.random.default_rng(9).integers(1, 1 << 63, (2, SKETCH), np.uint64) * np.uint64(2) + np.uint64(1)


def profile(text: str) -> tuple[str, list[int], bytes]:
    """Of a text: a hash of its words, PRINTS SimHashes of its words (each distinct word weighs the root of
    its count), and a sketch: the least of SKETCH hashes of its word shingles, one byte of each."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return "", [0] * PRINTS, bytes(SKETCH)
    counts = Counter(words)
    names = sorted(counts)
    hashes = np.hstack([np.frombuffer(b"".join([xxhash.xxh3_128_digest(w, seed) for w in names]), np.uint64).reshape(-1, 2)
                        for seed in range(PRINTS // 2)])
    weights, ones = np.sqrt(np.array([counts[w] for w in names], float)), np.zeros(BITS * PRINTS)
    for lo in range(0, len(names), CHUNK):
        bits = np.unpackbits(np.ascontiguousarray(hashes[lo:lo + CHUNK]).view(np.uint8).reshape(-1, 8 * PRINTS), axis=1, bitorder="little")
        ones += weights[lo:lo + CHUNK] @ bits
    first, least = _factors(), np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    own = _shingles(words, SHINGLE)
    for lo in range(0, len(own), 4096):
        mixed = (own[lo:lo + 4096, None] ^ first[0]) * first[1]
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(31))).min(axis=0))
    return (xxhash.xxh3_128_hexdigest(b" ".join(words)), np.packbits(2 * ones > weights.sum(), bitorder="little").view(np.int64).tolist(),
            (least * first[1] >> np.uint64(56)).astype(np.uint8).tobytes())


def _sketched(frame: pd.DataFrame) -> dict:
    refused = np.empty(len(frame), object)
    refused[:] = list(frame["refused"])
    return {"node": frame["node"].to_numpy(np.int64), "group": frame["group"].to_numpy(np.int64), "refused": refused,
            "sketch": np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(-1, SKETCH)}


def _likeness(same: np.ndarray) -> np.ndarray:
    """Similarity by the share of equal sketch values, without those equal by chance."""
    return (same - 1 / 256) / (1 - 1 / 256)


def _estimates(left: dict, right: dict, pairwise: bool) -> np.ndarray:
    """Similarity by sketches; -1 for pairs of one group and refused pairs."""
    if pairwise:
        same = (left["sketch"] == right["sketch"]).mean(axis=1)
        off = (left["group"] == right["group"]) | np.array([a in r for a, r in zip(left["node"], right["refused"])], bool)
    else:
        off = left["group"][:, None] == right["group"][None, :]
        same = np.zeros(off.shape)
        for i, row in enumerate(left["sketch"]):
            if not off[i].all():
                same[i] = (row == right["sketch"]).mean(axis=1)
        for i, r in enumerate(left["refused"]):
            if len(r):
                off[i] |= np.isin(right["node"], r)
        off |= off.T
    return np.where(off, -1.0, _likeness(same))


@F.pandas_udf(T.StructType().add("same", T.StringType()).add("prints", T.ArrayType(T.LongType())).add("sketch", T.BinaryType()))
def _profiled(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([profile(t) for t in texts], columns=["same", "prints", "sketch"])


@F.pandas_udf(T.DoubleType())
def _sketch_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, SKETCH) for s in (a, b))
    return pd.Series(_likeness((x == y).mean(axis=1)))


@F.pandas_udf(T.DoubleType())
def _measured(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        p, q = (_shingles(t.encode("utf-8", "surrogatepass").lower().split(), SHINGLE) for t in (x, y))
        met = len(np.intersect1d(p, q, assume_unique=True))
        out.append(met / (len(p) + len(q) - met))
    return pd.Series(out)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose group has a smaller doc_id: one row per group.

    Two documents are linked if they meet under a covering mask and the Jaccard similarity of
    their sets of 5-word shingles (A-Z in lower case) is 0.8 or more; groups are chains of links.
    A document has PRINTS fingerprints of its words, and masks that bring together all
    fingerprints within RADIUS bits. Documents of equal words are one node.

    The tables of each fingerprint are made by themselves, and only their shared buckets are kept. Nodes meet by key alone. First each node of a bucket is compared, by
    sketches, with the smallest one there, and its two most similar such partners are measured on the texts: that
    folds a large group of near copies with two measurements a copy. Buckets whose nodes are of one group
    by then are done. Of each other bucket a spanning forest of the most similar pairs (by
    sketches, across groups) is measured. Where a pair is refused, the rest of its bucket may still link, so
    the affected nodes meet again without what is settled (each naming its AGAIN most similar
    partners, for fewer meetings), until no new pair turns up. Sketches are joined to the rows of the
    buckets that are still open; tables of a round are deleted after it.

    Null and empty texts are one group. Rows of one doc_id and text are one document. Null ids
    come last. An empty table gives no rows; extra columns are kept."""
    spark = docs.sparkSession
    key = [F.col("doc_id").alias("id"), F.xxhash64(filled("text")).alias("text_key")]
    seen = stored(docs.select(*key, _profiled(filled("text")).alias("p")).select("id", "text_key", "p.*").withColumn(
        "row_id", F.monotonically_increasing_id()))
    nodes = stored(seen.groupBy("same").agg(F.min("row_id").alias("node"), F.any_value("prints").alias("prints"), F.any_value("sketch").alias("sketch")))
    tables = []
    for i in range(PRINTS):
        keys = F.array(*[F.xxhash64(F.lit(t), F.get("prints", i).bitwiseAND(F.lit(signed(m)))) for t, m in enumerate(masks(RADIUS), 1000 * i)])
        rows = nodes.select("node", F.explode(keys).alias("key"))
        shared, shared_at = stored_at(rows.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").drop("last"))
        tables.append(stored_at(rows.join(shared, "key")))
        removed(spark, shared_at)
    released(spark)
    members = nodes.select("node", "sketch")
    live = tables[0][0]
    for table, _ in tables[1:]:
        live = live.unionByName(table)
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")).alias("i"),
                        F.xxhash64(filled("text")).alias("k"), filled("text").alias("t"), F.struct("*").alias("row"))
    ends = live.select("node").distinct().join(seen.select(F.col("row_id").alias("node"), "id", "text_key"), "node").select(
        "node", F.struct(F.col("id").isNull().alias("none"), "id").alias("i"), F.col("text_key").alias("k"))
    texts, texts_at = stored_at(named.select("i", "k", "t").join(ends, ["i", "k"]).select("node", "t").dropDuplicates(["node"]))

    def measured(pairs: DataFrame) -> DataFrame:
        """a, b, ok of pairs a > b."""
        return stored(pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("x")), "a").join(
            texts.select(F.col("node").alias("b"), F.col("t").alias("y")), "b").select("a", "b", (_measured("x", "y") >= LEAST).alias("ok")))

    def linked_by(pairs: DataFrame) -> DataFrame:
        return components(pairs.filter("ok").select("a", "b")).withColumnRenamed("root", "group")
    star = live.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    star = star.join(members.toDF("a", "x"), "a").join(members.toDF("b", "y"), "b").select("a", "b", _sketch_likeness("x", "y").alias("like"))
    # a node has at most one partner here per table
    best = star.filter(F.col("like") >= LEAST - SLACK).groupBy("a").agg(F.array_sort(F.collect_set(F.struct("like", "b"))).alias("s")).select(
        "a", F.explode(F.slice(F.reverse("s"), 1, 2)).alias("s")).select("a", "s.b")
    settled = measured(best)
    released(spark)
    groups = linked_by(settled)
    chosen, again = None, False
    while True:
        refused = settled.filter("not ok").groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("refused"))
        placed = live.select("key", "node").join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
        placed = placed if chosen is None else placed.join(chosen, "node", "left_semi")
        mixed = placed.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("key")
        met, met_at = stored_at(placed.join(mixed, "key"))
        open_, open_at = stored_at(met.select("node", "group").distinct().join(members, "node").join(refused, "node", "left").withColumn(
            "refused", F.coalesce("refused", F.array().cast("array<bigint>"))))
        new = measured(likeliest(met.select("key", "node"), open_, _sketched, _estimates, LEAST - SLACK, AGAIN if again else 0))
        removed(spark, open_at)
        removed(spark, met_at)
        settled = settled.unionByName(new)
        if not new.filter("ok").isEmpty():
            groups = linked_by(settled)
        released(spark)
        bad = new.filter("not ok").select(F.col("a").alias("node"))
        if bad.isEmpty():
            break
        chains = components(settled.select("a", "b"))
        touched = chains.join(bad.join(chains, "node").select("root").distinct(), "root", "left_semi")
        chosen, again = touched.select("node"), True
    for _, table_at in tables:
        removed(spark, table_at)
    removed(spark, texts_at)
    roots = components(settled.filter("ok").select("a", "b"))
    groups = nodes.join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("group"))
    first = seen.join(groups, "same").groupBy("group").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_id", "text_key")).alias("first"))
    stay = first.select(F.struct(F.col("first.none").alias("none"), F.col("first.id").alias("id")).alias("i"), F.col("first.text_key").alias("k"))
    return named.join(stay, ["i", "k"], "left_semi").dropDuplicates(["i", "k"]).select("row.*")
