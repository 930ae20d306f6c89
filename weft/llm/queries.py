"""The registered queries of the training-data operators, with their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, chunk_dedup, collocation, forest, language, line_crf, line_rules, mixing, packing, secret_scan,
               sharding, simhash, sql, substring_dedup)
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


@query("op6_stratified_shards", sql.SHARDS)
def stratified_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Eight shards of all documents by row count, every source in proportion in each."""
    return sharding.interleaved(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op7_mixing", sql.MIXING)
def mixing_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.rates(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op5_line_rules", sql.LINE_RULES)
def line_rules_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and the verdict of the quality rules for every document."""
    return line_rules.judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_removed_words", "kept")


@query("op1_secret_scan", sql.SECRETS)
def secrets_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's secrets."""
    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    kinds = [k[0] for k in (*secret_scan.BASE, *secret_scan.CLASSES)]
    return secret_scan.scanned(table(spark, folder, "documents")).select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(secret_scan.listed(F.col("base"), kinds), 256).alias("base_sha256"),
        secret_scan.listed(F.concat("base", "extra"), kinds).alias("spans"))


@query("op9_simhash")
def simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_projection_forest")
def vector_components(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector."""
    return forest.near_duplicates(table(spark, folder, "embeddings"))


@query("op10_chunk_dedup", sql.CHUNKS)
def chunks_removed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the chunks of lines that an earlier one has."""
    return chunk_dedup.deduplicated(table(spark, folder, "documents"))


@query("op2_best_fit_packing")
def packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.packed(table(spark, folder, "documents"))


@query("op8_language_spans")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; the fold with remainder 0 is not learned from."""
    docs = table(spark, folder, "documents")
    model = language.learned(docs.filter(~language.held_out(F.col("doc_id"))))
    return language.labelled(docs, model).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query("op4_line_crf")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document; the fold with remainder 0 is not learned from."""
    docs = table(spark, folder, "documents")
    out = language.held_out(F.col("doc_id"))
    field = line_crf.learned(docs.filter(~out), table(spark, folder, "labels").filter(~out))
    return line_crf.scored(docs, field).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op11_alignment")
def tokens_aligned(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of two tokenizers' tokens over the same bytes, and the corpus counts of the linked ids."""
    return alignment.alignment(table(spark, folder, "documents"))


@query("op12_collocations", sql.COLLOCATIONS)
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best 2,000 collocations of every language."""
    return collocation.collocations(table(spark, folder, "documents"))


@query("op13_substring_dedup", sql.SUBSTRINGS)
def substrings_removed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages of 50 words and more that an earlier one has."""
    return substring_dedup.deduplicated(table(spark, folder, "documents"))
