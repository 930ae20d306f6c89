"""Average ranks and rank correlation without a one-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from .prefix import running_sums


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """value, name: the mean 1-based rank of each distinct value."""
    hist = df.groupBy(F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    run = running_sums(hist, "_value", {"_upto": F.col("_n")})
    return run.select(F.col("_value").alias(value), (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))


def correlation(x, y):
    """Pearson correlation as an aggregate, 0 where either side is constant."""
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.coalesce(safe_div(F.covar_pop(x, y), F.when(F.abs(spread) > 1e-15, spread).otherwise(F.lit(0.0))), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rank correlation of two columns, 0 with fewer than two rows."""
    ranked = df.select(x, y).join(average_ranks(df, x, "_rx"), x).join(average_ranks(df, y, "_ry"), y)
    return ranked.agg(correlation("_rx", "_ry").alias("correlation"))
