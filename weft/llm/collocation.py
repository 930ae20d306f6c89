"""Phrase collocations by dynamic itemset counting: cyclic scans of shards that count several lengths at once."""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint_folder
from .common import filled, removed, salted_join, stored_at

#: Occurrences of a candidate, words of the longest phrase, phrases reported per language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Shards of a cycle, and the bits (as a power of two) of the filter that holds the phrases that are on their way to LEAST.
SHARDS, FILTER_BITS = 4, 26
#: A filter looks up these shifts of a phrase's hash.
SHIFTS = (0, 19, 38)
#: Bytes of text, and words, that are counted at once (a longer text goes by itself).
PART, PART_WORDS = 1 << 22, 1 << 20
#: Counts that a task of the exact pass holds before it hands them on.
HELD = 1 << 19
END, NEXT = b"\xff", b"\xfe"
#: Bytes of a text: A-Z in lower case, ends of pieces as END (no byte of UTF-8), a tab as a blank.
_TO = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + END * 10 + b" ")


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a phrase with hash ``a`` and one more word with hash ``b``."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _within(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter holds (with some it does not)."""
    mask, out = np.uint64(len(bits) * 64 - 1), np.ones(len(hashes), bool)
    for shift in SHIFTS:
        at = (hashes >> np.uint64(shift)) & mask
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _numbered(texts: list[str], lang: str) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words of some texts of one language by number, their names, and a hash of each. Ends of
    pieces are number 0, ends of texts 1; both have the hash 0."""
    data = NEXT.join([x.encode().translate(_TO) for x in texts] + [b""])
    parts = data.replace(END, b" " + END + b" ").replace(NEXT, b" " + NEXT + b" ").split()
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    number[END], number[NEXT]
    ids = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
    names, seed = list(number), xxhash.xxh64_intdigest(lang.encode())
    own = np.array([xxhash.xxh64_intdigest(w, seed) or 1 for w in names], np.uint64)
    own[:2] = 0
    return ids, names, own


def _by_language(batch: pa.RecordBatch, part: int) -> Iterator[tuple[str, list[str]]]:
    """The texts of a batch by language, each language in parts of its own: a part of several languages has
    few texts of each, and what they share is then counted, and handed on, once per part."""
    by = defaultdict(list)
    for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        by[x].append(y)
    for lang, text in by.items():
        sizes = np.cumsum([len(x) + 1 for x in text])
        lo = 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + part, side="right")))
            yield lang, text[lo:hi]
            lo = hi


def encoded(texts: DataFrame, shards: int, part: int = PART) -> DataFrame:
    """shard, words: the word hashes of each text with 0 at the end of every piece, dealt in turn.
    texts: lang, text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for lang, own_texts in _by_language(batch, part):
                ids, _, own = _numbered(own_texts, lang)
                edges = np.append(0, np.flatnonzero(ids == 1) + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(((np.arange(len(own_texts)) + turn) % shards).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(own[ids].view(np.int64)))], ["shard", "words"])
                turn += len(own_texts)
    return texts.mapInArrow(run, "shard int, words array<bigint>")


def _active(words: np.ndarray, now: np.ndarray | None, before: np.ndarray | None, longest: int):
    """(length, hash, n) of what a scan counts: single words in the first cycle (before is None), and the phrases
    whose two parts of one word less are in ``now`` and were not both in ``before``."""
    if before is None:
        found, n = np.unique(words[words != 0], return_counts=True)
        yield 1, found, n
    if now is None or not len(words):
        return
    held = (words != 0) & _within(now, words)
    old = np.zeros(len(words), bool)
    if before is not None:
        at = np.flatnonzero(held)
        old[at] = _within(before, words[at])
    hashes = words
    for k in range(2, longest + 1):
        at = np.flatnonzero(held[:-1] & held[1:])
        at = at[at + k <= len(words)]
        if not len(at):
            return
        new_hash, seen = _mixed(hashes[at], words[at + k - 1]), old[at] & old[at + 1]
        found, n = np.unique(new_hash[~seen], return_counts=True)
        yield k, found, n
        if k < longest:
            held, old, hashes = np.zeros(len(words), bool), np.zeros(len(words), bool), np.zeros(len(words), np.uint64)
            held[at], hashes[at] = _within(now, new_hash), new_hash
            if before is not None:
                again = at[seen & held[at]]
                old[again] = _within(before, hashes[again])


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint64)


def scanned(shard: DataFrame, now, before, longest: int = LONGEST) -> DataFrame:
    """longer (may it have longer ones), hash, n: what is counted, summed per part of a task; now, before: broadcast filters or None."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [_unpacked(x.value) if x is not None else None for x in (now, before)]
        for batch in batches:
            column = batch.column(0)
            sizes = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + PART_WORDS, side="right")))
                words = column.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                for k, found, n in _active(words, *filters, longest):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k < longest)), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))],
                                                     ["longer", "hash", "n"])
                lo = hi
    return shard.select("words").mapInArrow(run, "longer boolean, hash bigint, n bigint")


def _bits(hashes: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Filter over longer, hash; and only over those that may have longer ones. At most 2^(bits - 6) rows reach the driver."""
    at = hashes.select("longer", F.explode(F.array(*[F.shiftrightunsigned("hash", s).bitwiseAND(F.lit((1 << bits) - 1)) for s in SHIFTS])).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(bit).alias("every"), F.coalesce(F.bit_or(F.when(F.col("longer"), bit)), F.lit(0).cast("bigint")).alias("longer")).toArrow()
    out = []
    for name in ("every", "longer"):
        one = np.zeros(1 << (bits - 6), np.int64)
        one[words["word"].to_numpy()] = words[name].to_numpy()
        out.append(one.view(np.uint64))
    return out[0], out[1]


def _summed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The counts (lang, words, phrase, n) of several batches in one."""
    found = pa.Table.from_batches(batches).group_by(["lang", "words", "phrase"], use_threads=False).aggregate([("n", "sum")])
    return found.select(["lang", "words", "phrase", "n_sum"]).rename_columns(batches[0].schema.names).combine_chunks().to_batches()[0]


def _exact(texts: DataFrame, final, longest: int, part: int = PART, most: int = HELD) -> DataFrame:
    """lang, words, phrase, n per task: how often the words and phrases in the filter occur;
    words = 0: all words of the language. A task sums the counts of its parts; of more than ``most`` it hands some on early."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _unpacked(final.value)
        held, size = [], 0
        for batch in batches:
            for lang, own_texts in _by_language(batch, part):
                for k, phrases, n in _spelled(own_texts, lang, bits, longest):
                    held.append(pa.RecordBatch.from_arrays(
                        [pa.array([lang]).take(pa.array(np.zeros(len(phrases), np.int32))), pa.array(np.full(len(phrases), k, np.int32)),
                         pa.array(phrases, pa.string()), pa.array(n.astype(np.int64))], ["lang", "words", "phrase", "n"]))
                    size += len(phrases)
                if size > most:
                    held = [_summed(held)]
                    size = held[0].num_rows
                    if 2 * size > most:
                        yield from held
                        held, size = [], 0
        if size:
            yield _summed(held)
    return texts.mapInArrow(run, "lang string, words int, phrase string, n bigint")


def _spelled(texts: list[str], lang: str, bits: np.ndarray, longest: int):
    ids, names, own = _numbered(texts, lang)
    yield 0, [""], np.array([(ids > 1).sum()])
    held = _within(bits, own)
    held[:2] = False
    n = np.bincount(ids, minlength=len(names))
    known = np.flatnonzero(held)
    yield 1, [names[i].decode() for i in known], n[known]
    hashes = words = own[ids]
    held, group = held[ids], ids
    for k in range(2, longest + 1):
        at = np.flatnonzero(held[:-1] & held[1:])
        at = at[at + k <= len(ids)]
        new_hash = _mixed(hashes[at], words[at + k - 1])
        passed = _within(bits, new_hash)
        at, new_hash = at[passed], new_hash[passed]
        if not len(at):
            return
        # equal phrases: equal without the last word (by number), and equal last words
        _, first, of, n = np.unique(group[at] * len(names) + ids[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
        yield k, [b" ".join([names[w] for w in row]).decode() for row in ids[at[first][:, None] + np.arange(k)].tolist()], n
        held, hashes, group = np.zeros(len(ids), bool), np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.int64)
        held[at], hashes[at], group[at] = True, new_hash, of


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, bits: int = FILTER_BITS) -> DataFrame:
    """lang, words, phrase, n: every word and every phrase of up to ``longest`` words that occurs
    ``least`` times or more, some that occur less often, and as words = 0 all words of a language.

    Dynamic itemset counting. The texts are dealt into ``shards`` that are scanned in turn, over
    and over, as word hashes. A phrase becomes active as soon as both its parts (without its last
    word, without its first) have reached their share of the threshold, least / shards in one
    shard, in the middle of a cycle, and is then counted for one full cycle; words are active from
    the start. So a scan counts phrases of several lengths, each for the first time in this
    shard. What occurs ``least`` times has such a share in some shard, and so have its parts, so
    nothing is missed. The scans end after a cycle in which no part was new; then one pass over the texts
    counts exactly what reached its share.

    What reached its share goes to the tasks as a filter of 2^bits bits, of one size for any corpus;
    no table of counts is carried on. Filters only grow, and a scan counts what passes the filter and did not
    pass the one of the last scan of this shard: so each phrase is counted once in each shard.
    What passes a full filter by chance costs time, never a wrong count."""
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), filled("text").alias("text"))
    encoded(texts, shards).write.partitionBy("shard").parquet(folder)
    words = spark.read.schema("words array<bigint>, shard int").parquet(folder)
    total = longer = np.zeros(1 << (bits - 6), np.uint64)
    filters: list = [None]
    settled = step = 0
    while step < shards or step <= settled + shards:
        now, before = filters[-1], filters[-1 - shards] if step >= shards else None
        if step < shards or now is not before:
            counts = scanned(words.filter(F.col("shard") == step % shards), now, before, longest)
            share = counts.groupBy("longer", "hash").agg(F.sum("n").alias("n")).filter(F.col("n") * shards >= least)
            more, more_longer = _bits(share, bits)
            if (more_longer & ~longer).any():
                settled, longer = step, longer | more_longer
                now = spark.sparkContext.broadcast(zlib.compress(longer.tobytes(), 1))
            total = total | more
        filters.append(now)
        step += 1
        past = filters[-2 - shards] if len(filters) > shards + 1 else None
        if past is not None and past is not filters[-1 - shards]:
            past.destroy()
    removed(spark, folder)
    final = spark.sparkContext.broadcast(zlib.compress(total.tobytes(), 1))
    return stored_at(_exact(texts, final, longest).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")))[0]


def _words(phrase: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS,
                 bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` collocations of each language.

    A text in lower case (A-Z) is cut into pieces at . , ; : ! ? and line ends, and a piece into
    words at blanks and tabs. Per language, n counts all words, a the occurrences of a phrase of 2
    to ``longest`` words within pieces, overlaps included; a phrase with a >= ``least`` is a candidate.
    A cut of a phrase into two has the counts l and r of its parts and the score
    floor(1000 a n / (l r)); the lowest decides, the first of equal ones. A candidate goes if a
    longer one holds it and occurs as often; since a longer phrase never occurs more often, it
    suffices to look at those longer by one word. Ranks go by score, a (both falling), phrase (by bytes).

    A null language is `und`, a null text is empty; ids and other columns are not read, and
    repeated rows count one by one. An empty table gives no rows. A first part that many
    candidates share is split over salts; a language's list comes from the best ``top`` of each task."""
    totals = phrase_counts(docs, least, longest, shards, bits)
    often, _ = stored_at(totals.filter((F.col("n") >= least) & (F.col("words") > 0)))
    sizes = totals.filter("words = 0").select("lang", "n")
    found = often.filter("words > 1").withColumnRenamed("n", "a")
    inner = found.filter("words > 2").select("lang", "a", F.explode(F.array(
        _words(F.col("phrase"), 1, F.col("words") - 1), _words(F.col("phrase"), 2, F.col("words") - 1))).alias("phrase"))
    inside = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = found.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    cuts, _ = stored_at(kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns({
        "left": _words(F.col("phrase"), 1, F.col("k")), "right": _words(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k"))}))
    part = often.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    with_left, _ = stored_at(salted_join(cuts, part, ["lang", "left"]))
    both, _ = stored_at(salted_join(with_left, part.toDF("lang", "right", "r"), ["lang", "right"]))
    both = salted_join(both, sizes, ["lang"])
    big = "decimal(19,0)"
    score = F.expr(f"(cast(a as {big}) * 1000 * cast(n as {big})) div (cast(l as {big}) * cast(r as {big}))")
    best = both.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
