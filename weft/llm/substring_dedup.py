"""Substring dedup: documents parsed into factors that earlier documents hold (relative Lempel-Ziv)."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, salted_join, stored

#: Words of a window, and of the anchors that choose the blocks.
WINDOW, ANCHOR = 50, 25
#: Characters of text that are hashed at once (a longer text goes by itself).
PART = 1 << 21
_P = 0x9E3779B97F4A7C55
_INVERSE = pow(_P, -1, 1 << 64)
_BLOCKS = "id bigint, text_key bigint, anchor bigint, hash bigint, first int, last int"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Rolling hashes over the words of some texts, one after the other."""

    def __init__(self, texts: list[str]):
        parts = [t.encode().split() for t in texts]
        self.counts = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        n = int(self.counts.sum())
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64, n)
        own = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, number)), np.uint64).reshape(-1, 2)
        one, zero = np.ones(1, np.uint64), np.zeros(1, np.uint64)
        up, self.down = (np.cumprod(np.concatenate([one, np.full(n, x, np.uint64)])) for x in (_P, _INVERSE))
        self.sums = [np.concatenate([zero, np.cumsum(own[ids, lane] * up[:-1])]) for lane in (0, 1)]

    def hashes(self, lane: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the words start to end - 1; two lanes are independent."""
        return _mix((self.sums[lane][end] - self.sums[lane][start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Text number and start of all windows of ``size`` words within one text."""
        n = np.maximum(self.counts - size + 1, 0)
        return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.starts, n)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the first place of the least of values[i:i + width]."""
    place, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = place[:-step], place[step:]
        place = np.where(values[b] < values[a], b, a)
        reach += step
    return place


def blocks_of(texts: list[str], window: int = WINDOW, anchor: int = ANCHOR):
    """text number, anchor hash, block hash, first, last for all blocks of some texts.

    Each window has an anchor: of the runs of ``anchor`` words in it the first one with the least
    hash, so equal windows have the same. The windows of a text that share one anchor are
    neighbours; all words of theirs are a block, first and last being the starts of its first
    and last window."""
    words = Words(texts)
    text, at = words.windows(window)
    if not len(at):
        return [np.zeros(0, np.int64)] * 5
    grams = np.arange(len(words.sums[0]) - anchor)
    hashes = words.hashes(0, grams, grams + anchor)
    anchors = _least(hashes, window - anchor + 1)[at]
    first = np.flatnonzero(np.append(True, (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])))
    last = np.append(first[1:], len(at)) - 1
    base = words.starts[text[first]]
    return (text[first], hashes[anchors[first]].view(np.int64), words.hashes(1, at[first], at[last] + window).view(np.int64),
            at[first] - base, at[last] - base)


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum([len(x) + 1 for x in batch.column(column).to_pylist()])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + PART, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"),
                       F.xxhash64(filled("text")).alias("text_key"), filled("text").alias("text"))


def blocks(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """id, text_key, anchor, hash, first, last: the blocks of all documents, one for every
    window - anchor + 2 / 2 words or so."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "text"):
                text, key, own, first, last = blocks_of(part.column("text").to_pylist(), window, anchor)
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(at), part.column("text_key").take(at), pa.array(key), pa.array(own),
                     pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["id", "text_key", "anchor", "hash", "first", "last"])
    return _keyed(docs).select("id", "text_key", "text").mapInArrow(run, _BLOCKS)


def _windows(docs: DataFrame, open_: DataFrame, window: int) -> DataFrame:
    """id, text_key, anchor, hash, at: all windows of the blocks in ``open_``, one by one."""
    runs = open_.groupBy("id", "text_key").agg(F.collect_set(F.struct("anchor", "first", "last")).alias("runs"))
    texts = _keyed(docs).select("id", "text_key", "text").join(runs, ["id", "text_key"]).select(
        "id", "text_key", "text", F.col("runs.anchor").alias("anchors"), F.col("runs.first").alias("firsts"), F.col("runs.last").alias("lasts"))

    def flat(column):
        return column.flatten().to_numpy(zero_copy_only=False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "text"):
                words = Words(part.column("text").to_pylist())
                text = np.repeat(np.arange(part.num_rows), part.column("anchors").value_lengths().to_numpy(zero_copy_only=False))
                key, first, last = (flat(part.column(c)) for c in ("anchors", "firsts", "lasts"))
                n = last.astype(np.int64) - first + 1
                of = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
                start = at + words.starts[text[of]]
                take = pa.array(text[of])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(take), part.column("text_key").take(take), pa.array(key[of]),
                     pa.array(words.hashes(1, start, start + window).view(np.int64)), pa.array(at.astype(np.int32))],
                    ["id", "text_key", "anchor", "hash", "at"])
    return texts.mapInArrow(run, "id bigint, text_key bigint, anchor bigint, hash bigint, at int")


def factors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """id, text_key, first, last: starts of windows whose words also start in a document with a
    smaller doc_id, as ranges, some of them overlapping.

    The reference of the parse is every earlier document, as an index of its blocks: the smallest
    id that holds a block. A factor grows over all blocks of a document, from left to right, that
    the index has from an earlier one; so the middle of a repeated passage costs one lookup a block,
    whatever its length. A factor ends in a block that also holds words from beyond the passage.
    There, if an earlier document has the same anchor, the windows of the block and of the other
    blocks with that anchor (first of their kind too) are hashed and looked up one by one.
    Equal windows have equal anchors, so none is lost; and the first holder of a window never
    has it inside a factor, so it is among those hashed.

    Blocks are looked up by 128 bits (64 of the anchor, 64 of all words), windows likewise. Hot
    anchors, blocks and windows are summed before they move and dealt over salts on the way
    back; no pairs of documents are made."""
    own = stored(blocks(docs, window, anchor))
    index = stored(own.groupBy("anchor", "hash").agg(F.min("id").alias("block_first"), F.max("id").alias("block_last")))
    anchors = index.groupBy("anchor").agg(F.min("block_first").alias("anchor_first"), F.max("block_last").alias("anchor_last")).filter(
        "anchor_first < anchor_last").select("anchor", "anchor_first")
    shared = salted_join(index.drop("block_last"), stored(anchors), ["anchor"])
    mine = stored(salted_join(own, stored(shared), ["anchor", "hash"]))
    known = F.col("block_first") < F.col("id")
    asked = mine.filter(~known & (F.col("anchor_first") < F.col("id"))).select("anchor").distinct()
    open_ = stored(mine.filter(~known).select("id", "text_key", "anchor", "first", "last"))
    single = stored(_windows(docs, salted_join(open_, stored(asked), ["anchor"]), window))
    firsts = single.groupBy("anchor", "hash").agg(F.min("id").alias("window_first"), F.max("id").alias("window_last")).filter(
        "window_first < window_last").drop("window_last")
    ends = salted_join(single, stored(firsts), ["anchor", "hash"]).filter(F.col("window_first") < F.col("id"))
    return mine.filter(known).select("id", "text_key", "first", "last").unionByName(
        ends.select("id", "text_key", F.col("at").alias("first"), F.col("at").alias("last")))


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, n_factors, kept_sha256 for every row; with ``texts`` also ``text``,
    the kept words joined by one blank.

    Every word in a window of ``window`` words whose words also start in a document with a smaller
    doc_id goes. Windows are those of the input, not of what is left. n_factors counts the
    stretches of words that go.

    A null or empty text has no words. A null doc_id comes after all others; documents of equal
    ids are never earlier than each other, and rows of equal id and text get the same result. A
    text of fewer words than a window loses none, and one of exactly so many goes whole or not
    at all. An empty table gives no rows; other columns are not read."""
    spans = factors(docs, window, anchor).groupBy("id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    rows = _keyed(docs).join(spans, ["id", "text_key"], "left").select(
        "doc_id", "text", F.col("spans.first").alias("firsts"), F.col("spans.last").alias("lasts"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, n_factors, digests, kept = [], [], [], [], []
            for text, first, last in zip(batch.column("text").to_pylist(), batch.column("firsts"), batch.column("lasts")):
                words = text.encode().split()
                n_words.append(len(words))
                gone = np.zeros(len(words), bool)
                if first.is_valid:
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, first.values.to_numpy(), 1)
                    np.add.at(edges, last.values.to_numpy() + window, -1)
                    gone = np.cumsum(edges[:-1]) > 0
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                n_removed.append(int(gone.sum()))
                n_factors.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                left = b" ".join(words)
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode() if texts else None)
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_factors, pa.int64()),
                       pa.array(digests, pa.string()), *([pa.array(kept, pa.string())] if texts else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "n_factors", "kept_sha256", "text"][:len(columns)])
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, n_factors bigint, kept_sha256 string" + (", text string" if texts else ""))
