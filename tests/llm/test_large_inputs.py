"""What larger inputs hold against the operators."""

import os

import pyarrow as pa

from weft.llm import chunk_dedup, collocation
from weft.plans.lineage import checkpoint_folder


def test_parts_of_one_language():
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y", "x", "y", "x"]), pa.array(["aa", "bb", "cc", "dd", "e" * 9])], ["lang", "text"])
    assert list(collocation._by_language(batch, 6)) == [("x", ["aa", "cc"]), ("x", ["e" * 9]), ("y", ["bb", "dd"])]


def test_line_dedup_keeps_one_table(spark):
    docs = spark.createDataFrame([(i, f"one {i % 3}\ntwo\nthree\nfour {i}") for i in range(9)], "doc_id bigint, text string")
    folder = checkpoint_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert chunk_dedup.without_repeats(docs).count() == 9
    assert len(set(os.listdir(folder)) - before) == 1
