"""Token alignment against a walk over the bytes of every text."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from weft.llm import alignment
from weft.llm.common import table

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, a string, n string, pair bigint, best string, row_id bigint"


def expected(texts):
    """Per text: the columns after doc_id, by one step per token."""
    t = alignment.tokens()
    per, pairs = [], Counter()
    for text in texts:
        a, b = t.encoded(text) if text else ([], [])
        groups, links, at, left, right = [], Counter(), [0, 0], [], []
        ends = [0, 0]
        while at[0] < len(a) or at[1] < len(b):
            if ends[0] <= ends[1] and at[0] < len(a):
                left.append(a[at[0]])
                ends[0] += len(t.a_bytes[a[at[0]]])
                at[0] += 1
            else:
                right.append(b[at[1]])
                ends[1] += len(t.b_bytes[b[at[1]]])
                at[1] += 1
            if ends[0] == ends[1]:
                groups.append((left, right))
                links.update((p, q) for p in left for q in right)
                left, right = [], []
        per.append((len(a), len(b), groups, links))
        pairs.update(links.keys())
    best = defaultdict(int)
    for (p, _), n in pairs.items():
        best[p] = max(best[p], n)
    return [(n_a, n_b, len(groups), sum(links.values()), sum(c for k, c in links.items() if pairs[k] == best[k[0]]),
             sum(c * pairs[k] for k, c in links.items()),
             hashlib.sha256(";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups).encode()).hexdigest() if groups else "")
            for n_a, n_b, groups, links in per]


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@pytest.mark.parametrize("hot", [1 << 18, 40, 1])
def test_against_a_walk(spark, hot):
    docs = table(spark, FOLDER, "documents").repartition(3)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = sorted(((i, *x) for i, x in zip(texts, expected(texts.values()))), key=str)
    assert rows(alignment.alignment(docs, hot=hot)) == want


def test_odd_texts(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n \t", "a▁b", "<|endoftext|> <s> </s><unk>", "naïve Straße – “déjà” 日本語テキスト 🙂🙂🙂 ع", "\u0000\u0001x", "x" * 200_000,
             "=-" * 40_000, "🙂" * 3000, "ab12" * 5000, "same text", "same text", "".join(chr(rng.randint(33, 0x2FF)) for _ in range(4000)), "\r\n a  b\x0b\x0c"]
    data = [(i if i % 5 else None, x, "a", "n", i, "b", 7) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(4)
    want = sorted(((d[0], *x) for d, x in zip(data, expected(texts))), key=str)
    assert rows(alignment.alignment(docs)) == want
    assert want[0][1:] != want[1][1:] and any(w[3] > 0 and w[4] > w[3] for w in want)


def test_large_groups_go_by_distinct_ids(spark, monkeypatch):
    texts = ["🙂é" * 400, "plain words and 12345678901234567890", "x" * 5000]
    t = alignment.tokens()
    whole = alignment._of_texts(texts, t)
    monkeypatch.setattr(alignment, "LINKS", 3)
    parts = alignment._of_texts(texts, t)
    assert {k: v.to_pylist() for k, v in whole.items()} == {k: v.to_pylist() for k, v in parts.items()}


def test_empty_table(spark):
    got = alignment.alignment(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and "groups_sha256" in got.columns
