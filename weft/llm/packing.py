"""Packing token sequences: large pieces matched in pairs, small ones best-fit into the gaps."""

from __future__ import annotations

import base64
import functools
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, ranked, stored

CAPACITY = 2048
#: The same pieces as the vocabulary's own pattern, with runs that never give back characters.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Texts of these characters only are encoded by the rank file of the same vocabulary, which gives
#: the same ids in a fraction of the time; any other character, or a special token's name, sends the text to the full tokenizer.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ſ]*")


@functools.cache
def _encoders(model: str):
    """The vocabulary named by ``model`` (a file of public_tokenizers) as (quick, full) encoders."""
    import os

    import public_tokenizers
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    full = Tokenizer.from_file(public_tokenizers.path(model))
    quick = None
    if model == "byte_bpe_50k.json":
        import tiktoken
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        quick = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return quick, full


def _ids(text: str, quick, full) -> np.ndarray:
    if quick and PLAIN.fullmatch(text) and "<|endoftext|>" not in text:
        return np.frombuffer(quick._core_bpe.encode_to_tiktoken_buffer(text, _NONE), np.uint32)
    return np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)


_NONE: set[str] = set()


def token_ids(text: str, model: str = "byte_bpe_50k.json") -> list[int]:
    return _ids(text, *_encoders(model)).tolist()


def pieces(docs: DataFrame, capacity: int = CAPACITY, model: str = "byte_bpe_50k.json", end: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the token ids of each text and ``end``, cut from
    the back into pieces of ``capacity``, so that only the first may be shorter.

    Ids stay in buffers; Python sees one number per piece."""
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        encoders = _encoders(model)
        for batch in batches:
            owner, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = _ids(text, *encoders)
                n, raw = len(found) + 1, memoryview(found).cast("B")
                first = (n - 1) % capacity + 1
                for k, hi in enumerate(range(first, n + 1, capacity)):
                    lo = hi - capacity if k else 0
                    sum_ = zlib.crc32(raw[4 * lo:4 * min(hi, n - 1)])
                    owner.append(row)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(last, sum_) if hi == n else sum_)
                    if ids:
                        kept.append(np.append(found[lo:hi], np.uint32(end)) if hi == n else found[lo:hi])
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if ids:
                columns.append(pa.array(kept, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", filled("text").alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<bigint>" if ids else ""))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, rank from, first sequence, per sequence, offset): where the pieces of each
    length go by their rank. ``counts`` has one entry per length, so neither the work nor the
    plan grows with the pieces.

    Pieces over a third of the capacity: the longest takes the longest partner that fits, two
    to a sequence at most. The others, longest first, go into the smallest gap that holds
    them; a gap that took one is the smallest again, so a whole run of sequences is filled in
    one step."""
    left, taken, rows = dict(counts), dict.fromkeys(counts, 0), []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    number = 0

    def free(gap, first, n):
        if gap > 0 and n:
            if gap not in gaps:
                insort(order, gap)
            gaps.setdefault(gap, []).append((first, n))

    def put(length, n, first, per, offset):
        rows.append((length, taken[length], first, per, offset))
        taken[length] += n
        left[length] -= n

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        if at >= 0 and large[at] == a and left[a] < 2:
            at -= 1
        if at < 0:
            n = left[a]
            put(a, n, number, 1, 0)
            free(capacity - a, number, n)
        else:
            b = large[at]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, number, 1, 0)
            put(b, n, number, 1, a)
            free(capacity - a - b, number, n)
        number += n
        large = [x for x in large if left[x]]
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(order, length)
            gap = order[at] if at < len(order) else capacity
            per = gap // length
            if at < len(order):
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                first, n = number, -(-left[length] // per)
                number += n
            whole = min(n, left[length] // per)
            if whole:
                put(length, whole * per, first, per, capacity - gap)
                free(gap - per * length, first, whole)
            rest = left[length] if whole < n and left[length] < per else 0
            if rest:
                put(length, rest, first + whole, per, capacity - gap)
                free(gap - rest * length, first + whole, 1)
            free(gap, first + whole + bool(rest), n - whole - bool(rest))
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(docs: DataFrame, capacity: int = CAPACITY, model: str = "byte_bpe_50k.json", end: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece; with ``ids`` also
    the token ids. The pieces of a sequence fill it from 0 without gaps, up to ``capacity``.

    The texts are read once; what moves after that is one short row per piece (with ``ids``
    also the ids). The driver sees how many pieces each length has (``capacity`` numbers) and
    sends back a plan by length and rank; ranks come from ranges of (length, hash), so a
    length with a third of all pieces is spread.

    A null text is empty: one piece, the end token. Repeated rows are packed one by one; a null
    doc_id is packed like any other. An empty table gives no rows; extra columns are not read."""
    rows = stored(pieces(docs, capacity, model, end, ids))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    first, total = {}, 0
    for length in sorted(counts):
        first[length], total = total, total + counts[length]
    where = plan(counts, capacity)
    lengths, starts = np.array(sorted(counts), np.int64), np.array([first[x] for x in sorted(counts)], np.int64)
    base = np.array([first[x] for x in where[:, 0].tolist()], np.int64) + where[:, 1]

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, at: pd.Series) -> pd.DataFrame:
        length, at = length.to_numpy(), at.to_numpy()
        row = where[np.searchsorted(base, at, side="right") - 1]
        rank = at - starts[np.searchsorted(lengths, length)] - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + rank // row[:, 3], "offset": row[:, 4] + rank % row[:, 3] * length})
    order = [F.col("length"), F.xxhash64("doc_id", "piece", "ids_crc32")]
    return ranked(rows, order, "_at").withColumn("_to", place("length", "_at")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "_to.sequence_id", "_to.offset", *(["ids"] if ids else []))
