"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled

#: The field is fitted on about this many labelled documents, drawn by hash; those with more lines
#: than MOST_LINES are scored like any other but not fitted on.
SAMPLE, MOST_LINES = 3000, 200
STEPS, RATE, DECAY = 80, 0.1, 1e-3
#: Characters of the texts whose lines are measured at once.
PART = 1 << 20
TOP = 0x3000
SYMBOLS = "#*$%&|<>@^~_=+\\{}[]"
NAMES = ("one", "log_chars", "log_words", "upper", "digit", "symbol", "mark", "shout", "space", "word_length", "long_words", "repeats",
         "same_as_before", "seen", "ends_in_mark")


@cache
def _classes() -> np.ndarray:
    """Class of each code point: 1 upper, 2 other letter, 3 digit, 4 symbol, 5 exclamation, 6 other mark, 7 white space."""
    out = np.full(TOP + 1, 2, np.uint8)
    for i in range(TOP):
        c = chr(i)
        out[i] = (1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 7 if c.isspace() else 4 if c in SYMBOLS
                  else 5 if c == "!" else 6)
    return out


def measured(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of each line (lines x NAMES), its length + 1, and how many lines each text has."""
    lines = [text.split("\n") for text in texts]
    counts = np.array([len(x) for x in lines], np.int64)
    flat = [x for own in lines for x in own]
    codes = np.frombuffer(("\n".join(flat) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _classes()[np.minimum(codes, TOP)]
    size = np.array([len(x) + 1 for x in flat], np.int64)
    start = np.append(0, np.cumsum(size)[:-1])
    share = {k: np.add.reduceat((kind == k).astype(np.int32), start) / size for k in range(1, 7)}
    blank = kind == 7
    ends = blank & ~np.append(True, blank[:-1])
    words = np.add.reduceat(ends.astype(np.int32), start)
    spaces = (np.add.reduceat(blank.astype(np.int32), start) - 1) / size
    repeats, before, seen, mark = (np.zeros(len(flat)) for _ in range(4))
    i = 0
    for own in lines:
        known: set[str] = set()
        last = None
        for x in own:
            w = x.split()
            if w:
                repeats[i] = 1 - len(set(w)) / len(w)
                before[i], seen[i] = x == last, x in known
                mark[i] = w[-1][-1] in ".?\"')»"
                known.add(x)
                last = x
            i += 1
    length = (size - 1) * (1 - spaces) / np.maximum(words, 1)
    return (np.column_stack([np.ones(len(flat)), np.log(size) / 5, np.log1p(words) / 4, share[1] * 5, share[3] * 5, share[4] * 10,
                             share[6] * 10, share[5] * 10, spaces * 5, np.minimum(length, 30) / 10, np.minimum(length, 60) > 15, repeats * 2,
                             before, seen, mark]).astype(np.float64), size, counts)


def featured(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``measured``, with the numbers of the previous and the next line of the same text beside
    each line's own (0 where there is none), and pair terms of the shares."""
    x, size, counts = measured(texts)
    first = np.append(0, np.cumsum(counts)[:-1])
    previous, following = np.vstack([np.zeros((1, x.shape[1])), x[:-1]]), np.vstack([x[1:], np.zeros((1, x.shape[1]))])
    previous[first] = 0
    following[np.append(first[1:] - 1, len(x) - 1)] = 0
    return np.hstack([x, x[:, 2:] ** 2, previous, following]), size, counts


@dataclass
class Field:
    weights: np.ndarray
    step: np.ndarray


def marginals(evidence: np.ndarray, step: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(line is good), log of the sum over paths of each text, expected number of each change.

    evidence: log weight of good against bad per line; step[a, b]: log weight of b after a.
    Forward and backward sums run over all texts at once, position by position."""
    order = np.argsort(-counts, kind="stable")
    start = np.append(0, np.cumsum(counts)[:-1])[order]
    sizes = counts[order]
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")
    unary = np.column_stack([np.zeros(len(evidence)), evidence])
    ahead, back = np.zeros_like(unary), np.zeros_like(unary)
    for t in range(steps):
        at = start[:alive[t]] + t
        ahead[at] = unary[at] if t == 0 else unary[at] + np.logaddexp(ahead[at - 1][:, :1] + step[0], ahead[at - 1][:, 1:] + step[1])
    for t in range(steps - 2, -1, -1):
        at = start[:alive[t + 1]] + t
        ready = unary[at + 1] + back[at + 1]
        back[at] = np.logaddexp(step[:, 0] + ready[:, :1], step[:, 1] + ready[:, 1:])
    end = np.cumsum(counts) - 1
    log_sum = np.logaddexp(ahead[end, 0], ahead[end, 1])
    line_sum = np.repeat(log_sum, counts)
    good = np.exp(ahead[:, 1] + back[:, 1] - line_sum)
    inner = np.setdiff1d(np.arange(len(evidence)), end, assume_unique=True)
    pair = ahead[inner][:, :, None] + step[None] + (unary[inner + 1] + back[inner + 1])[:, None, :] - line_sum[inner][:, None, None]
    return good, log_sum, np.exp(pair).sum(axis=0)


def fit(x: np.ndarray, counts: np.ndarray, good: np.ndarray) -> Field:
    """Weights that make the label of a text likely for all its lines, by gradient steps (Adam) on
    the log likelihood, each text with one vote, with weight decay."""
    label = np.repeat(good.astype(float), counts)
    vote = np.repeat(1.0 / counts, counts)
    inside = counts - 1
    stays = np.array([[((1 - good) * inside).sum(), 0.0], [0.0, (good * inside).sum()]])
    w, step = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    n = max(1, len(counts))
    for k in range(1, STEPS + 1):
        p, _, pairs = marginals(x @ w, step, counts)
        g = np.append(x.T @ ((p - label) * vote) / n + DECAY * w, (pairs - stays).ravel() / max(1, inside.sum()) + 10 * DECAY * step.ravel())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = RATE * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
        w, step = w - d[:-4], step - d[-4:].reshape(2, 2)
    return Field(w, step)


def scores(texts: list[str], field: Field) -> np.ndarray:
    """Share of each text's characters in good lines, by the lines' marginals."""
    x, size, counts = featured(texts)
    good, _, _ = marginals(x @ field.weights, field.step, counts)
    first = np.append(0, np.cumsum(counts)[:-1])
    return np.clip(np.add.reduceat(good * size, first) / np.add.reduceat(size, first), 0, 1)


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field fitted on about ``sample`` of the labelled documents (doc_id, text; doc_id, quality).
    The driver gets the numbers of their lines, which the sample and MOST_LINES bound."""
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        F.max(F.col("quality").cast("int")).alias("quality"))
    n = marks.count()
    drawn = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < min(1.0, sample / max(1, n)) * (1 << 30))
    rows = docs.select("doc_id", filled("text").alias("text")).join(F.broadcast(drawn), "doc_id").filter(
        F.size(F.split("text", "\n")) <= MOST_LINES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo in range(0, len(texts), 256):
                x, _, counts = featured(texts[lo:lo + 256])
                cut = np.split(x.astype(np.float32), np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[lo:lo + 256], batch.column("quality")[lo:lo + 256], pa.array(counts, pa.int64()),
                    pa.array([c.ravel() for c in cut], pa.list_(pa.float32()))], ["doc_id", "quality", "n", "x"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(measure, f"doc_id {kind}, quality int, n bigint, x array<float>").toPandas().sort_values(["doc_id", "n"])
    if not len(got):
        return Field(np.zeros(featured([""])[0].shape[1]), np.zeros((2, 2)))
    counts = got["n"].to_numpy()
    x = np.concatenate(got["x"].to_list()).reshape(counts.sum(), -1).astype(float)
    return fit(x, counts, got["quality"].to_numpy(float))


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score for every row of ``docs``: the probability that a character's line is good.

    Whole texts are read; a line is judged with its neighbours. A null text is an empty one,
    which has one empty line and the score of that. Repeated rows are scored one by one; an
    empty table gives no rows; other columns are not read. With nothing learned all scores
    are 0.5."""
    handle = docs.sparkSession.sparkContext.broadcast(field)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            order, out, part, size = sorted(range(len(texts)), key=lambda i: texts[i].count("\n")), np.zeros(len(texts)), [], 0
            for k, i in enumerate(order):
                part.append(i)
                size += len(texts[i]) + 1
                if size > PART or k == len(order) - 1:
                    out[part] = scores([texts[j] for j in part], handle.value)
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id").alias("doc_id"), filled("text").alias("text")).mapInArrow(score, f"doc_id {kind}, score double")
