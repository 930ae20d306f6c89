"""Languages of words and spans: script ranges, n-gram scores, Viterbi with a switching penalty."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled

#: The model is fitted on about this many documents of each language, drawn by hash.
SAMPLE = 3000
#: Runs of GRAMS characters around each letter are counted in this many buckets per language.
BUCKETS, GRAMS = 1 << 17, (3, 5)
#: A change of language costs as much as this many nats of word evidence.
PENALTY = 8.0
#: A language is a candidate for a script if this share of its training words is written in it.
SCRIPT_SHARE = 0.02
#: Characters of the texts whose words are scored at once.
PART = 1 << 20
#: First code points of scripts, in order; a code point belongs to the last start that is not above it.
SCRIPTS = ((0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
           (0x700, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
           (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"),
           (0xAC00, "hangul"), (0xD7B0, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0x20000, "han"))
_STARTS = np.array([s for s, _ in SCRIPTS])


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of all planes: is it a letter, and its lower case (itself if that is not one character)."""
    every = [chr(c) for c in range(sys.maxunicode + 1)]
    return (np.array([x.isalpha() for x in every]),
            np.array([ord(y) if len(y := x.lower()) == 1 else ord(x) for x in every], np.uint64))


@dataclass
class Words:
    """The words (runs of letters) of some texts: places in the joined texts, and n-gram buckets of their letters."""
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    buckets: list[np.ndarray]
    letter_start: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> tuple[Words, np.ndarray]:
        """The words, and the place where each text begins."""
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter, lower = _letters()
        mask = is_letter[codes]
        edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        reach = max(GRAMS) // 2
        chars = np.pad(np.where(mask, lower[codes], np.uint64(0)), reach)
        at = np.flatnonzero(mask) + reach
        buckets = []
        for n in GRAMS:
            h = np.zeros(len(at), np.uint64)
            for k in range(-(n // 2), n // 2 + 1):
                h = (h ^ chars[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            buckets.append((h % np.uint64(BUCKETS)).astype(np.int64))
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        script = np.searchsorted(_STARTS, codes[start], side="right") - 1 if len(start) else np.zeros(0, int)
        return (cls(start, end, script, buckets, np.append(0, np.cumsum(end - start)[:-1])[:len(start)]),
                np.append(0, np.cumsum(sizes)[:-1])[:len(texts)])


@dataclass
class Model:
    languages: list[str]
    #: For each of GRAMS, log frequency by bucket and language.
    scores: list[np.ndarray]
    #: Candidate languages of each script that the training texts use.
    scripts: dict[str, np.ndarray]

    def words(self, w: Words) -> np.ndarray:
        """Evidence of each word in nats for each language, 0 for the best candidate of its script."""
        if not len(w.start):
            return np.zeros((0, len(self.languages)), np.float32)
        each = sum(table[b] for table, b in zip(self.scores, w.buckets))
        size = (w.end - w.start)[:, None]
        s = np.add.reduceat(each, w.letter_start, axis=0) / (len(GRAMS) * size) * np.minimum(size, 8)
        for i, (_, name) in enumerate(SCRIPTS):
            if name in self.scripts and not self.scripts[name].all():
                s[np.ix_(w.script == i, ~self.scripts[name])] = -50.0
        return (s - s.max(axis=1, keepdims=True)).astype(np.float32)


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best language of each word of each text (words x languages), all texts step by step."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    flat = np.concatenate([scores[i] for i in order]) if len(order) else np.zeros((0, 1), np.float32)
    starts = np.append(0, np.cumsum(sizes)[:-1])
    steps = int(sizes[0]) if len(sizes) else 0
    jump, best_of = np.zeros(flat.shape, bool), np.zeros(len(flat), np.int32)
    now = np.zeros((len(order), flat.shape[1]), np.float64)
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")
    for t in range(steps):
        n = alive[t]
        at = starts[:n] + t
        v = now[:n]
        if t:
            top = v.argmax(axis=1)
            best = v[np.arange(n), top][:, None] - penalty
            jump[at], best_of[at] = best > v, top
            v = np.maximum(v, best)
        now[:n] = v + flat[at]
    state, path = now.argmax(axis=1), np.zeros(len(flat), np.int32)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        at = starts[:n] + t
        path[at] = state[:n]
        state[:n] = np.where(jump[at, state[:n]], best_of[at], state[:n])
    out: list = [None] * len(scores)
    for k, i in enumerate(order):
        out[i] = path[starts[k]:starts[k] + sizes[k]]
    return out


def learned(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the (text, lang) rows of ``docs`` with a language: about ``sample`` documents
    of each. Words and scripts are counted by the executors; the driver gets one row per
    language and used bucket, which BUCKETS bounds. Languages are few by nature (classes)."""
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    n = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(n)
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, min(1.0, sample / n[lang])).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, own in frame.groupby("lang"):
                for lo in range(0, len(own), 64):
                    w, _ = Words.of(own["text"].iloc[lo:lo + 64].to_list())
                    rows = [(g, *np.unique(b, return_counts=True)) for g, b in enumerate(w.buckets)]
                    rows.append((-1, *np.unique(w.script, return_counts=True)))
                    for g, values, n in rows:
                        yield pd.DataFrame({"lang": lang, "kind": g, "bucket": values, "n": n})
    counted = docs.filter(drawn).mapInPandas(count, "lang string, kind int, bucket bigint, n bigint").groupBy(
        "lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    place = counted["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)
    bucket, n = counted["bucket"].to_numpy(int), counted["n"].to_numpy(float)
    scores = []
    for g in range(len(GRAMS)):
        counts = np.zeros((BUCKETS, max(1, len(languages))))
        own = counted["kind"].to_numpy() == g
        counts[bucket[own], place[own]] = n[own]
        scores.append(np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32))
    written: dict[str, np.ndarray] = {}
    for i, p, k in zip(bucket, place, n * (counted["kind"] == -1)):
        if k:
            written.setdefault(SCRIPTS[i][1], np.zeros(len(languages)))[p] += k
    total = sum(written.values(), np.zeros(len(languages)))
    scripts = {s: k >= SCRIPT_SHARE * total.clip(1) for s, k in written.items()}
    return Model(languages, scores, {s: ok for s, ok in scripts.items() if ok.any()})


def _labelled(texts: list[str], model: Model, penalty: float) -> Iterator[tuple]:
    """(language, score, spans) of each text."""
    words, begins = Words.of(texts)
    scores = model.words(words)
    cut = np.append(np.searchsorted(words.start, begins), len(words.start))
    for i, path in enumerate(viterbi([scores[a:b] for a, b in zip(cut, cut[1:])], penalty)):
        if not len(path) or not model.languages:
            yield "und", 0.0, []
            continue
        first, last = (x[cut[i]:cut[i + 1]] - begins[i] for x in (words.start, words.end))
        letters = np.bincount(path, weights=last - first, minlength=len(model.languages))
        best = int(letters.argmax())
        turns = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
        ends = np.append(turns[1:], len(path)) - 1
        yield (model.languages[best], float(letters[best] / letters.sum()),
               [{"start": int(first[a]), "end": int(last[b]), "lang": model.languages[path[a]]} for a, b in zip(turns, ends)])


def labelled(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, spans (start, end, lang; code points) for every row of ``docs``.

    Each word (a run of letters) is scored for the languages whose script it is written in;
    the best path over the words, with ``penalty`` for a change, gives spans. The language
    with the most letters is the document's, its share of the letters the score. Null
    texts and texts without a letter are ``und`` with score 0 and no spans, and so is
    everything if nothing was learned. Repeated rows are labelled one by one; an empty table
    gives no rows; other columns are not read."""
    handle = docs.sparkSession.sparkContext.broadcast((model, penalty))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, penalty = handle.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            order, out, part, size = sorted(range(len(texts)), key=lambda i: len(texts[i])), [None] * len(texts), [], 0
            for k, i in enumerate(order):
                part.append(i)
                size += len(texts[i])
                if size > PART or k == len(order) - 1:
                    for j, found in zip(part, _labelled([texts[j] for j in part], model, penalty)):
                        out[j] = found
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()),
                pa.array([x[2] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))],
                ["doc_id", "lang_pred", "score", "spans"])
    return docs.select(F.col("doc_id").alias("doc_id"), filled("text").alias("text")).mapInArrow(
        label, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the documents that nothing is learned from: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))
