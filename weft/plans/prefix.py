"""Running sums over a long order, in two levels.

A window without (or with a skewed) partition key sorts everything in one task. Here
the rows are dealt into ranges of the order (ties by the tie columns) whose cuts Spark
takes from a sample, so an outlier or a heavy value does not fill one range: the inner
window runs per (key, range), the outer one only over the range totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def _ranged(df: DataFrame, order: str, tie: Sequence[str]) -> DataFrame:
    """Adds _range, rising with the order. Written once, so it is the same in every use."""
    return cut(df.repartitionByRange(order, *tie).withColumn("_range", F.spark_partition_id().cast("bigint")))


def running_sums(df: DataFrame, order: str, sums: dict[str, Column], by: Sequence[str] = (),
                 tie: Sequence[str] = ()) -> DataFrame:
    """Add, per output name, the sum of its column over all rows of the same ``by``
    key up to and including this row in ``order`` (then ``tie``)."""
    by = list(by)
    rows = _ranged(df, order, tie)
    for name, c in sums.items():
        rows = rows.withColumn(f"_v_{name}", c)
    inner = (Window.partitionBy(*by, "_range").orderBy(order, *tie)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = rows.select("*", *[F.sum(f"_v_{n}").over(inner).alias(f"_in_{n}") for n in sums])
    totals = rows.groupBy(*by, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    # one row per key and range
    outer = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    outer = outer.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(k).alias(f"_k_{k}") for k in by]
    offsets = totals.select(*keys, F.col("_range").alias("_k_range"),
                            *[F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_off_{n}")
                              for n in sums])
    on = F.col("_range") == F.col("_k_range")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = within.join(offsets, on)
    for n in sums:
        out = out.withColumn(n, F.col(f"_in_{n}") + F.col(f"_off_{n}"))
    return out.drop("_range", "_k_range", *[f"_k_{k}" for k in by],
                    *[f"{p}{n}" for n in sums for p in ("_v_", "_in_", "_off_")])


def numbered(df: DataFrame, order: str, name: str = "idx", by: Sequence[str] = (),
             tie: Sequence[str] = ()) -> DataFrame:
    """1-based row number per ``by`` key in ``order``, without a one-task sort."""
    return running_sums(df, order, {name: F.lit(1).cast("bigint")}, by, tie)
