"""Helpers of the training-data operators: tables written between jobs, ranks, components."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.components import star_roots as components  # noqa: F401
from ..plans.lineage import removed, stored_at  # noqa: F401

#: A word is a run of characters other than these (blank, \t \n \v \f \r).
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def filled(c: str | Column) -> Column:
    """A text, empty where it is null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet below the shared checkpoint folder and read back: later jobs
    start from the files, so a lost executor costs no recomputation of what came before."""
    return stored_at(df)[0]


def released(spark: SparkSession) -> None:
    """Lets go of what finished jobs hold: Spark deletes the shuffle files of plans that nothing refers to
    any more when the driver collects garbage, which a small heap may put off for long."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def salted_join(rows: DataFrame, one: DataFrame, keys: list[str], share: int = 1024) -> DataFrame:
    """rows joined with ``one``, which has one row per key. A key with more than 1 / ``share`` of the
    rows is dealt over salts, so no task gets more than that of one key; there are at most
    2 ``share`` such keys, and only they are broadcast. ``rows`` is read twice: store it before."""
    limit = max(rows.count() // share, 1)
    hot = F.broadcast(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(
        *keys, F.ceil(F.col("_n") / limit).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int"))
    copies = one.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.drop("_salts").join(copies.drop("_salts"), [*keys, "_salt"]).drop("_salt")


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``name``, the 0-based place of each row in ``order``.

    Rows are dealt by ranges of the order, so no key has to fit into one task; a range
    knows its start from the row counts of the ranges before it (one row per partition,
    which is what is broadcast). The placed rows are written once, so the ranks are the
    same however often the result is read."""
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("_ranked_at", F.monotonically_increasing_id()))
    part = F.shiftright("_ranked_at", 33)
    before = Window.orderBy("_ranked_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_ranked_part")).agg(F.count("*").alias("_n")).select(
        "_ranked_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ranked_start"))
    return (placed.withColumn("_ranked_part", part).join(F.broadcast(starts), "_ranked_part")
            .withColumn(name, F.col("_ranked_start") + F.col("_ranked_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_ranked_part", "_ranked_start", "_ranked_at"))
