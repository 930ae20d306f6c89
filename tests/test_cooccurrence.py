"""Pairs of words counted inside tasks, and what their tables leave on disk."""

from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa

from weft.operators import factor, text


def test_pairs_over_several_chunks(monkeypatch):
    """Texts longer than a chunk, shorter than the window, empty and null ones; no pair goes over the end of a text."""
    rng = np.random.default_rng(2)
    texts = [["w" + "abcde"[i] for i in rng.integers(0, 5, n)] for n in (40, 1, 2, 0, 7, 3, 25)] + [None]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.list_(pa.string()))], ["t"]) for t in (texts[:3], texts[3:])]
    want = Counter()
    for t in texts:
        for i, w in enumerate(t or []):
            for v in t[i + 1:i + 4]:
                want[tuple(sorted((w, v)))] += 1
    for size, rows in ((1, 2), (10, 3), (1000, 1000)):
        monkeypatch.setattr(text, "TOKENS", size)
        monkeypatch.setattr(text, "ROWS", rows)
        got, seen = Counter(), 0
        for b in text._pair_counter(3)(iter(batches)):
            for r in b.to_pylist():
                got[r["w1"], r["w2"]] += r["n"]
                seen += 1
        assert got == want
    assert seen == len(want)


def test_word_vectors_leave_one_table_of_pairs(spark, tmp_path, monkeypatch):
    """The texts' tokens and the counts of pairs go once the positive entries are stored."""
    monkeypatch.setattr("weft.plans.lineage.checkpoint_folder", lambda _: str(tmp_path))
    texts = spark.createDataFrame([(i, "care nurse family care river stone") for i in range(6)], "study_id int, text string")
    assert {r["word"] for r in factor.word_vectors(texts, dim=2).collect()} == {"care", "nurse", "family", "river", "stone"}
    left = [spark.read.parquet(str(f)).columns for f in Path(tmp_path).iterdir()]
    assert sorted(c for c in left if c != ["term", "n"]) == [["w1", "w2", "ppmi"]]
