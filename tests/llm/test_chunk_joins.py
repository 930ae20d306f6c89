"""A small table is joined with the texts as a large one is."""

from weft.llm import chunk_dedup


def test_texts_are_merged_at_any_size(spark):
    docs = spark.createDataFrame([(i, "one line here\nand a second one") for i in range(3)], "doc_id bigint, text string")
    plan = chunk_dedup.deduplicated(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
