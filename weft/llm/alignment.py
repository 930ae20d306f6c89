"""Alignment of two tokenizers over the same bytes, with corpus counts of the id pairs they link."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .packing import PATTERN, PLAIN

A_MODEL, B_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text that are aligned at once (a longer text goes by itself), and links expanded at once.
PART, LINKS = 1 << 20, 1 << 20
#: Pairs in more than 1 / HOT of all (document, pair) rows: fewer than HOT by arithmetic, whatever the corpus.
HOT = 1 << 18


def _byte_level() -> dict[str, int]:
    """The characters that byte-level vocabularies write for the 256 bytes: a printable byte is its own
    Latin-1 character, the others are U+0100, U+0101, ... in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """The two vocabularies: encoders, bytes of each id, and the id of B with the bytes of an id of A."""

    def __init__(self, a_model: str, b_model: str):
        import base64
        import os

        import public_tokenizers
        import sentencepiece
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.full = Tokenizer.from_file(public_tokenizers.path(a_model))
        self.full.encode_special_tokens = True
        self.quick = None
        if a_model == "byte_bpe_50k.json":
            import tiktoken
            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b_model))
        code = _byte_level()
        names = sorted(self.full.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.a_bytes = [b""] * (names[-1][1] + 1)
        for name, i in names:
            self.a_bytes[i] = bytes(code[c] for c in name) if all(c in code for c in name) else name.encode()
        self.b_bytes = []
        for i in range(self.pieces.get_piece_size()):
            name = self.pieces.id_to_piece(i)
            byte = re.fullmatch(r"<0x([0-9A-F]{2})>", name)
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else name.replace("▁", " ").encode())
        of_bytes = {}
        for i, x in enumerate(self.b_bytes):
            if not (self.pieces.is_byte(i) and x in of_bytes):
                of_bytes[x] = i
        #: The identity map: per id of A the id of B with the same bytes, -1 without one.
        self.same = np.array([of_bytes.get(x, -1) for x in self.a_bytes], np.int64)
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        #: Decimal ids with what follows them: inside a group, and at its end.
        self.names = [b"%d%s" % (i, end) for i in range(len(self.a_bytes)) for end in (b",", b"|")] + [
            b"%d%s" % (i, end) for i in range(len(self.b_bytes)) for end in (b",", b";")]

    def encoded(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of A and B of a text; none where the bytes of either are not those of blank + text."""
        whole = " " + text
        a = self.quick.encode_ordinary(whole) if self.quick and PLAIN.fullmatch(text) else self.full.encode(
            whole, add_special_tokens=False).ids
        b = self.pieces.encode(text, num_threads=1)
        raw = whole.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return [], []
        return a, b


@functools.cache
def tokens(a_model: str = A_MODEL, b_model: str = B_MODEL) -> Tokens:
    return Tokens(a_model, b_model)


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.append(np.zeros(1, np.int64), ends)[:len(ends)]


def _expanded(owner, a, b, a_from, b_from, n_a, n_b, scale: int) -> np.ndarray:
    """owner * scale^2 + a * scale + b for all links of some groups."""
    n = n_a * n_b
    group = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    return (owner[group] * scale + a[a_from[group] + at // n_b[group]]) * scale + b[b_from[group] + at % n_b[group]]


def _folded(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0]
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def _links(owner, a, b, a_from, b_from, n_a, n_b, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (owner, a, b) of all links and how many links each has. At most about
    LINKS links are expanded at once; a group with more goes by its distinct ids."""
    n, keys, counts = n_a * n_b, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g in np.flatnonzero(n > LINKS):
        x, c = np.unique(a[a_from[g]:a_from[g] + n_a[g]], return_counts=True)
        y, d = np.unique(b[b_from[g]:b_from[g] + n_b[g]], return_counts=True)
        keys.append((((owner[g] * scale + x) * scale)[:, None] + y[None, :]).ravel())
        counts.append((c[:, None] * d[None, :]).ravel())
    at = np.flatnonzero(n <= LINKS)
    turn = np.cumsum(n[at]) // LINKS
    cuts = np.append(np.flatnonzero(np.append(True, turn[1:] != turn[:-1])), len(at)) if len(at) else np.zeros(1, int)
    for lo, hi in zip(cuts, cuts[1:]):
        g = at[lo:hi]
        key, count = np.unique(_expanded(owner[g], a, b, a_from[g], b_from[g], n_a[g], n_b[g], scale), return_counts=True)
        keys.append(key)
        counts.append(count)
    keys, counts = (keys[1:], counts[1:]) if len(keys) > 1 else (keys, counts)
    return _folded(keys, counts)


def _of_texts(texts: list[str | None], t: Tokens) -> dict[str, list]:
    """The columns of ``aligned`` for some texts, all in one go: document ends are ends of groups."""
    n = len(texts)
    ids = [t.encoded(x) if x else ([], []) for x in texts]
    a_ends, b_ends = (np.cumsum([len(x[k]) for x in ids]) for k in (0, 1))
    a, b = (np.fromiter((i for x in ids for i in x[k]), np.int64, ends[-1]) for k, ends in ((0, a_ends), (1, b_ends)))
    del ids
    a_at, b_at = np.cumsum(t.a_length[a]), np.cumsum(t.b_length[b])
    total = int(a_at[-1]) if len(a_at) else 0
    ends = np.zeros((2, total + 1), bool)
    ends[0, a_at] = ends[1, b_at] = True
    a_closes, b_closes = ends[1, a_at], ends[0, b_at]
    a_last, b_last = np.flatnonzero(a_closes), np.flatnonzero(b_closes)
    a_from, b_from = _starts(a_last + 1), _starts(b_last + 1)
    n_a, n_b = a_last + 1 - a_from, b_last + 1 - b_from
    group_ends = np.searchsorted(a_last + 1, a_ends, side="right")
    owner = np.repeat(np.arange(n), np.diff(group_ends, prepend=0))
    links_before = np.append(0, np.cumsum(n_a * n_b))

    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + np.repeat(b_from, n_a)] = 2 * a + a_closes
    order[np.arange(len(b)) + np.repeat(a_last + 1, n_b)] = 2 * (len(t.a_bytes) + b) + b_closes
    digests, lo = [], 0
    for hi in (a_ends + b_ends).tolist():
        listed = b"".join(map(t.names.__getitem__, order[lo:hi].tolist()))
        digests.append(hashlib.sha256(listed[:-1]).hexdigest() if listed else "")
        lo = hi

    scale = max(len(t.a_bytes), len(t.b_bytes))
    single = (n_a == 1) & (n_b == 1)
    single &= t.same[a[a_from]] == b[b_from]
    plain = (owner[single] * scale + a[a_from[single]]) * scale + b[b_from[single]]
    odd = ~single
    key, count = _folded(*map(list, zip(np.unique(plain, return_counts=True), _links(
        owner[odd], a, b, a_from[odd], b_from[odd], n_a[odd], n_b[odd], scale))))
    pair = key % (scale * scale)
    is_same = t.same[pair // scale] == pair % scale
    of = key // (scale * scale)

    def lists(chosen, values, kind):
        edges = np.append(0, np.cumsum(np.bincount(of[chosen], minlength=n)))
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values[chosen], kind))
    return {"n_a": pa.array(np.diff(a_ends, prepend=0)), "n_b": pa.array(np.diff(b_ends, prepend=0)),
            "n_groups": pa.array(np.diff(group_ends, prepend=0)), "n_links": pa.array(np.diff(links_before[group_ends], prepend=0)),
            "groups_sha256": pa.array(digests, pa.string()), "same_a": lists(is_same, pair // scale, pa.int32()),
            "same_links": lists(is_same, count, pa.int64()), "pair_a": lists(~is_same, pair // scale, pa.int32()),
            "pair_b": lists(~is_same, pair % scale, pa.int32()), "pair_links": lists(~is_same, count, pa.int64())}


_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def aligned(docs: DataFrame, a_model: str = A_MODEL, b_model: str = B_MODEL) -> DataFrame:
    """doc_id, counts and digest of the groups, and the distinct id pairs that they link, per row.

    The tokens of blank + text under A and B are cut into groups where both end at the same
    byte; the A and B tokens of a group are linked, each with each. ``same_a`` lists the ids
    of A linked to the id of B with the same bytes (``same_links``: how often), ``pair_a`` and
    ``pair_b`` the other pairs (``pair_links``).

    A null or empty text, or one whose tokens do not spell it, has no tokens."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(a_model, b_model)
        for batch in batches:
            lengths = np.cumsum(np.array([len(x or "") for x in batch.column(1).to_pylist()], np.int64))
            lo = 0
            while lo < batch.num_rows:
                base = lengths[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(lengths, base + PART, side="right")))
                part = batch.slice(lo, hi - lo)
                columns = _of_texts(part.column(1).to_pylist(), t)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns.values()], ["doc_id", *columns])
                lo = hi
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = ", ".join(f"{x} array<{k}>" for x, k in (("same_a", "int"), ("same_links", "bigint"), ("pair_a", "int"),
                                                    ("pair_b", "int"), ("pair_links", "bigint")))
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_COUNTS}, {lists}")


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def pair_counts(rows: DataFrame, scale: int) -> tuple[DataFrame, DataFrame]:
    """In how many rows of ``aligned`` each pair is linked: (a, n) for pairs of equal bytes, counted
    in a vector over A's vocabulary per task, and (pair, n) for the others."""
    def vectors(batches):
        total = np.zeros(scale, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0)), minlength=scale)
        a = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(total[a])], ["a", "n"])

    def pairs(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                pair, n = np.unique(_flat(part.column(0)).astype(np.int64) * scale + _flat(part.column(1)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])
    same = rows.select("same_a").mapInArrow(vectors, "a int, n bigint").groupBy("a").agg(F.sum("n").alias("n"))
    odd = rows.select("pair_a", "pair_b").mapInArrow(pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return same, odd


def alignment(docs: DataFrame, a_model: str = A_MODEL, b_model: str = B_MODEL, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    The count of an id pair is the number of rows of ``docs`` that hold it linked. n_best: links
    whose count is the highest of all pairs of their A id, ties included; count_sum: the counts
    of all links, summed.

    Pairs of ids with equal bytes, the bulk, never move: they are known from the identity map
    and counted in a vector over the vocabulary per task. Only other pairs are shuffled, summed
    per task before. What the driver sees and sends back is bounded: a count and a maximum per
    id of A, and the counts of pairs in over 1 / ``hot`` of the (row, pair) rows, of which there
    are fewer than ``hot`` in any corpus. All rarer pairs get their counts by a join, in which no
    key has more than that share of the rows.

    A null or empty text, or one whose tokens do not spell it, has zeros and an empty digest.
    Repeated rows are documents of their own and count one by one; a null doc_id is kept. An
    empty table gives no rows; other columns are not read."""
    t = tokens(a_model, b_model)
    scale = max(len(t.a_bytes), len(t.b_bytes))
    rows = stored(aligned(docs, a_model, b_model).withColumn("row_id", F.monotonically_increasing_id()))
    same, odd = pair_counts(rows, scale)
    same, odd = stored(same), stored(odd)
    total = odd.agg(F.sum("n")).first()[0] or 0
    best = stored(same.unionByName(odd.select((F.col("pair") / scale).cast("int").alias("a"), "n")).groupBy("a").agg(F.max("n").alias("best")))
    count, most = np.zeros(scale, np.int64), np.zeros(scale, np.int64)
    for r in same.collect():
        count[r["a"]] = r["n"]
    for r in best.collect():
        most[r["a"]] = r["best"]
    often = odd.filter(F.col("n") * hot > total).orderBy("pair").toPandas()
    hot_pair, hot_n = often["pair"].to_numpy(np.int64), often["n"].to_numpy(np.int64)
    known = docs.sparkSession.sparkContext.broadcast((count, most, hot_pair, hot_n))
    shown = ["row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def summed(batches):
        count, most, hot_pair, hot_n = known.value

        def per_row(edges, values):
            return np.diff(np.append(0, np.cumsum(values))[edges])
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = {k: part.column(k) for k in part.schema.names}
                edges = {k: np.append(0, np.cumsum(x[k].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))) for k in ("same_a", "pair_a")}
                a, links = _flat(x["same_a"]), _flat(x["same_links"])
                sums = per_row(edges["same_a"], count[a] * links)
                bests = per_row(edges["same_a"], np.where(count[a] == most[a], links, 0))
                a, links = _flat(x["pair_a"]).astype(np.int64), _flat(x["pair_links"])
                pair = a * scale + _flat(x["pair_b"])
                at = np.minimum(np.searchsorted(hot_pair, pair), max(len(hot_pair) - 1, 0))
                is_hot = hot_pair[at] == pair if len(hot_pair) else np.zeros(len(pair), bool)
                n = np.where(is_hot, hot_n[at], 0) if len(hot_pair) else np.zeros(len(pair), np.int64)
                sums += per_row(edges["pair_a"], n * links)
                bests += per_row(edges["pair_a"], np.where(is_hot & (n == most[a]), links, 0))
                cold = pa.array(per_row(edges["pair_a"], ~is_hot).cumsum(), pa.int32())
                cold = pa.concat_arrays([pa.array([0], pa.int32()), cold])
                yield pa.RecordBatch.from_arrays(
                    [*[x[k] for k in shown], pa.array(sums), pa.array(bests), pa.ListArray.from_arrays(cold, pa.array(pair[~is_hot])),
                     pa.ListArray.from_arrays(cold, pa.array(links[~is_hot]))], [*shown, "sums", "bests", "cold", "cold_links"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = stored(rows.mapInArrow(summed, f"row_id bigint, doc_id {kind}, {_COUNTS}, sums bigint, bests bigint, cold array<bigint>, cold_links array<bigint>"))
    rare = odd.filter(F.col("n") * hot <= total).withColumn("a", (F.col("pair") / scale).cast("int")).join(
        F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    cold = first.select("row_id", F.explode(F.arrays_zip("cold", "cold_links")).alias("c")).select(
        "row_id", F.col("c.cold").alias("pair"), F.col("c.cold_links").alias("links"))
    more = cold.join(rare, "pair").groupBy("row_id").agg(
        F.sum(F.col("n") * F.col("links")).alias("cold_sum"), F.sum(F.when(F.col("is_best"), F.col("links")).otherwise(0)).alias("cold_best"))
    zero = F.lit(0).cast("bigint")
    return first.drop("cold", "cold_links").join(more, "row_id", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("bests") + F.coalesce("cold_best", zero)).alias("n_best"),
        (F.col("sums") + F.coalesce("cold_sum", zero)).alias("count_sum"), "groups_sha256")
