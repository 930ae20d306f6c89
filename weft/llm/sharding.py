"""Shards by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, ranked, stored


def interleaved(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot: ``docs`` dealt into ``shards`` by equal
    row counts (at most one apart), each with every source in its share of the whole.

    The rows of a source are shuffled by a seeded hash and ranked r = 1..n; all rows are
    sorted by (2r - 1) / 2n and the sorted rows are cut into equal runs, so a run of 1/k of
    the rows holds 1/k of each source, give or take a row. Both rankings go by ranges of
    their order: a source with a third of all rows is spread like any other.

    A null source is a source of its own (last among ties); a null text counts 0 bytes and
    a null doc_id is shuffled by the word ``null``. Rows with the same doc_id follow each
    other by checksum and size; equal rows are interchangeable. An empty table gives no
    rows. Other columns are not read."""
    row = docs.select(
        F.col("doc_id").alias("doc_id"), F.col("source").alias("source"),
        (F.octet_length(filled("text")) + 1).cast("bigint").alias("size"),
        F.crc32(filled("text")).alias("text_crc32"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_h"))
    source = F.col("source").asc_nulls_last()
    own = ranked(stored(row), [source, F.col("_h"), F.col("text_crc32"), F.col("size")], "_rank")
    span = own.groupBy(F.col("source").alias("_s")).agg(F.min("_rank").alias("_first"), F.count("*").alias("_n"))
    part = own.join(span, F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "_f", (2 * (F.col("_rank") - F.col("_first")) + 1).cast("double") / (2 * F.col("_n")).cast("double"))
    placed = ranked(part.drop("_s", "_first", "_n", "_rank"),
                    [F.col("_f"), source, F.col("_h"), F.col("text_crc32"), F.col("size")], "_at")
    total = placed.count()
    shard = F.expr(f"cast((_at * {shards}) div {max(total, 1)} as int)")
    first = F.expr(f"(shard * cast({total} as bigint) + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("_at") - first).select(
        "doc_id", "source", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 17) -> None:
    """Whole documents below ``path``/shard=k, each shard in slot order. doc_id must be a key."""
    place = interleaved(docs, shards, seed).select(F.col("doc_id").alias("_id"), "shard", "slot")
    rows = docs.select(F.struct("*").alias("row")).join(place, F.col("row.doc_id").eqNullSafe(F.col("_id")))
    (rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .select(F.col("row"), "shard", "slot").write.partitionBy("shard").parquet(path))
