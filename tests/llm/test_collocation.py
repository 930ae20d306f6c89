"""Collocations against a count of every phrase."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import collocation
from weft.llm.common import salted_join

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n bigint, words int, shard string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest=5):
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return counts


def expected(rows, least, top):
    out = []
    for lang, counts in counted(rows).items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        often = {p: c for p, c in counts.items() if c >= least and len(p) > 1}
        listed = []
        for p, a in often.items():
            if any(c >= a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in often.items()):
                continue
            cuts = [(1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            listed.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], n))
        for rank, (score, a, phrase, l, r, n) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["the", "The", "of", "a", "Äpfel", "x", "naïve", "\u0085y", "word word"] + [f"w{i}" for i in range(15)]
    fixed = ["New York City hall", "a a a a a a", "of the  of\tthe of the", "w1 w2 w3 w4 w5 w6 w7", "the naïve x, Äpfel"]
    rows = []
    for i in range(400):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(vocabulary, range(len(vocabulary), 0, -1), k=rng.randint(1, 9)))
                 for _ in range(rng.randint(0, 8))]
        rows.append((rng.choice([". ", " ", "\n", ";", " ! ", "\x0b"]).join(parts), rng.choice(["de", "de", "de", None, "und", "en"])))
    return rows + [(None, "de"), ("", None), (" \n\t.,", "en"), ("a a a a a a " * 300, "de"), ("lone", "xx")] + [("copied words here. " * 3, "de")] * 40


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", 1, 2, "s") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("least, top, shards, bits", [(12, 2000, 4, 26), (12, 7, 3, 7), (3, 2000, 1, 12), (40, 2000, 5, 10)])
def test_against_all_phrases(spark, corpus, least, top, shards, bits):
    got = collocation.collocations(frame(spark, corpus), least=least, top=top, shards=shards, bits=bits)
    assert rows_of(got) == expected(corpus, least, top)


@pytest.mark.parametrize("bits", [6, 9, 20])
def test_counts_are_whole(spark, corpus, bits):
    got = {(r["lang"], tuple(r["phrase"].split(" "))): r["n"] for r in collocation.phrase_counts(
        frame(spark, corpus), least=5, shards=4, bits=bits).collect()}
    for lang, counts in counted(corpus).items():
        assert got.get((lang, ("",)), 0) == sum(c for p, c in counts.items() if len(p) == 1)
        for phrase, n in counts.items():
            assert got[lang, phrase] == n if n >= 5 else got.get((lang, phrase), n) == n


def test_score_is_exact(spark):
    big = [10 ** 15 + 7, 10 ** 17 + 3, 10 ** 12 + 1, 10 ** 13 + 9]
    a, n, l, r = big
    got = spark.createDataFrame([(a, n, l, r)], "a bigint, n bigint, l bigint, r bigint").select(F.expr(
        "(cast(a as decimal(19,0)) * 1000 * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").alias("s"))
    assert got.first()["s"] == 1000 * a * n // (l * r)


def test_salted_join(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(50)] + [("none", 1)], "key string, v int")
    one = spark.createDataFrame([("hot", 1), ("other", 5)] + [(f"k{i}", i) for i in range(50)], "key string, x int")
    got = salted_join(rows, one, ["key"], share=10)
    want = rows.join(one, "key")
    assert sorted(map(tuple, got.select("key", "v", "x").collect())) == sorted(map(tuple, want.select("key", "v", "x").collect()))


def test_empty_table_and_long_text(spark):
    empty = collocation.collocations(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [("one two three four " * 100_000, "en"), ("x" * 1_000_000, "en")]
    assert rows_of(collocation.collocations(frame(spark, rows), least=100)) == expected(rows, 100, 2000)


@pytest.mark.parametrize("most", [1 << 19, 3])
def test_parts_of_a_task_are_summed_before_they_leave(spark, most):
    """Every part of a task has the same phrases: they leave it once, unless it would hold too many."""
    texts = spark.createDataFrame([("en", "one two three"), ("de", "one two")] * 20, "lang string, text string").coalesce(1)
    every = spark.sparkContext.broadcast(zlib.compress(np.full(1 << 4, -1, np.int64).view(np.uint64).tobytes(), 1))
    found = [tuple(r) for r in collocation._exact(texts, every, 3, part=20, most=most).collect()]
    if most > 3:
        assert len(found) == len({r[:3] for r in found})
    total = Counter()
    for lang, words, phrase, n in found:
        total[lang, words, phrase] += n
    assert total == {("en", 0, ""): 60, ("de", 0, ""): 40} | {(lang, k, " ".join(w)): 20 for lang, all_ in (("en", ["one", "two", "three"]), ("de", ["one", "two"]))
                                                            for k in (1, 2, 3) for w in (all_[i:i + k] for i in range(len(all_) - k + 1))}
