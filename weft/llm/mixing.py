"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .common import WORD, filled, ranked

#: Up to this many sources their rates are sent to every task; beyond it they are joined.
SMALL = 10_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """_s, source_size, target for a table (_s, source_size) with one row per source.

    Sources in code point order (null last) take the weights in turn. They share ``share``
    times all words; a target stops at ``most`` times its source, and what is over goes to
    the rest by weight until none is above. The share of one unit of weight only grows from
    round to round, so a round needs three sums, and nothing else reaches the driver."""
    turn = (F.col("_i") % len(weights)).cast("int")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    rows = cut(ranked(sizes, [F.col("_s").asc_nulls_last()], "_i")
               .select("_s", "source_size", pick.alias("_w"), (F.col("source_size") * most).alias("_cap")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    unit, closed = 0.0, -1
    while True:
        full = F.col("_cap") / F.col("_w") < unit
        n, cap, weight = rows.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("_cap"))),
                                  F.sum(F.when(~full, F.col("_w")))).first()
        if n == closed:
            break
        closed, unit = n, (total * share - (cap or 0.0)) / weight if weight else unit
    return rows.select("_s", "source_size", F.least(F.col("_w") * unit, "_cap").alias("target"))


def draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the seed, the id and the text; 52 bits of an MD5."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), filled(text)))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 23,
          keep: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, copies: how often the mix emits each document:
    floor(rate) times, and once more if a number drawn from seed, id and text is below the
    fraction; rate = target / source_size. With ``keep`` also ``row``, the whole input row.

    A null text has 0 words, a null source is a source. Without any words all rates are 0.
    Equal rows draw alike. An empty table gives no rows; extra columns are kept in ``row``."""
    row = [F.struct("*").alias("row")] if keep else []
    sized = docs.select(*row, F.col("doc_id").alias("doc_id"), F.col("source").alias("_source"),
                        word_count(filled("text")).alias("size"), draw(seed, F.col("doc_id"), F.col("text")).alias("_u"))
    per = docs.select(F.col("source").alias("_s"), word_count(filled("text")).alias("_n")).groupBy("_s").agg(
        F.sum("_n").alias("source_size"))
    goal = cut(targets(per, weights, share, most).withColumn("_rate", F.when(
        F.col("source_size") > 0, F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))).otherwise(0.0)))
    goal = F.broadcast(goal) if goal.count() <= SMALL else goal
    whole = F.floor("_rate")
    return sized.join(goal, F.col("_source").eqNullSafe(F.col("_s"))).select(
        *(["row"] if keep else []), "doc_id", "size", "source_size", "target",
        (whole + F.when(F.col("_u") < F.col("_rate") - whole, 1).otherwise(0)).alias("copies"))


def mixed(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 23) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says."""
    rows = rates(docs, weights, share, most, seed, keep=True).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("_copy")).select("row.*")
