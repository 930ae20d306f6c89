"""Substring dedup against the set of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from weft.llm import substring_dedup

SCHEMA = "doc_id bigint, text string, id string, anchor int, hash string, first int, text_key string"


def expected(rows, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    ids = [float("inf") if i is None else i for i, _ in rows]
    first = {}
    for i, ws in zip(ids, words):
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k:k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), own, ws in zip(rows, ids, words):
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k:k + window])] < own:
                gone.update(range(k, k + window))
        left = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "n_factors", "kept_sha256").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "h", 2, "k") for i, t in rows], SCHEMA).repartition(4)


def corpus(window, seed=7):
    """Copies, passages at and just under a window, texts of few different words, and edge cases."""
    rng = random.Random(seed)

    def fresh(n):
        return [f"w{rng.randint(0, 50_000)}" for _ in range(n)]
    passages = [fresh(n) for n in (window - 1, window, window, window + 1, 3 * window, 7 * window)]
    few = ["ba", "bo", "bi"]
    texts = []
    for _ in range(120):
        ws = fresh(rng.randint(0, window))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            lo = rng.randint(0, len(p) // 2) if rng.random() < 0.5 else 0
            ws += p[lo:] + fresh(rng.choice([0, 1, 2, window]))
        texts.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(ws))
    texts += [" ".join(rng.choices(few, k=rng.randint(window, 3 * window))) for _ in range(10)] + ["ba " * (3 * window), "ba " * (2 * window)]
    base = fresh(4 * window)
    for _ in range(25):
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 8 + [None, "", " \n\t", "one", "é\u0085ü " * window, "é\u0085ü " * window]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    return rows + [(None, " ".join(base)), (None, " ".join(base)), (3, texts[3]), (3, texts[4]), (-5, " ".join(passages[5]))]


@pytest.mark.parametrize("window, anchor", [(50, 25), (6, 3), (4, 1), (5, 5)])
def test_against_all_windows(spark, window, anchor):
    rows = corpus(window)
    assert rows_of(substring_dedup.deduplicated(frame(spark, rows), window, anchor)) == expected(rows, window)


def test_kept_text(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "a b " + passage), (2, "c  " + passage + "\nd"), (9, "e")]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.deduplicated(frame(spark, rows), texts=True).collect()}
    assert got == {1: "a b " + passage, 2: "c d", 9: "e"}


def test_blocks_hold_every_window():
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 400))) for _ in range(30)] + [""]
    text, anchor, _, first, last = substring_dedup.blocks_of(texts)
    for t in range(len(texts)):
        n, mine = len(texts[t].split()), np.flatnonzero(text == t)
        covered = [w for b in mine for w in range(first[b], last[b] + 1)]
        assert covered == list(range(max(0, n - 49)))
    whole = substring_dedup.blocks_of(texts)
    single = [substring_dedup.blocks_of([t]) for t in texts]
    for k in (1, 2, 3, 4):
        assert np.concatenate([s[k] for s in single]).tolist() == whole[k].tolist()


def test_long_text_and_empty_table(spark):
    long = " ".join(f"v{i % 977}x{i % 31}" for i in range(120_000))
    rows = [(1, long), (2, "begin " + long), (3, "y" * 1_000_000)]
    got = rows_of(substring_dedup.deduplicated(frame(spark, rows)))
    assert [r[2] for r in got] == [0, 120_000, 0]
    empty = substring_dedup.deduplicated(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and "kept_sha256" in empty.columns
