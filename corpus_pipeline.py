"""The corpus pipeline: from raw documents to packed training sequences.

Every stage works on all rows that the one before it kept. Stage results are written as
Parquet below spark.checkpoint.dir and read again, so a lost executor never costs more
than the stage it was in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import chunk_dedup, line_rules, mixing, packing, simhash
from weft.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the rules and lines that over 30 texts of their host share."""
    return line_rules.cleaned(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops runs of two or more lines, and long lines, that stood earlier."""
    return chunk_dedup.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by the rates of their sources."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the token pieces of all documents into sequences."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup),
          ("mixing", mix), ("best_fit_packing", pack)]

#: Tokens and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
