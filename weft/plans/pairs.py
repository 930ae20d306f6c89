"""Pairs of themes and overlaps of their study sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import numbered


def incidence(theme_studies: DataFrame, studies: DataFrame | None = None) -> DataFrame:
    """Distinct (study_id, theme_id); with ``studies``, only known studies."""
    rows = theme_studies.select("study_id", "theme_id").distinct()
    return rows if studies is None else rows.join(studies.select("study_id"), "study_id", "left_semi")


def theme_sets(inc: DataFrame) -> DataFrame:
    """themes ARRAY (sorted), n: how many studies carry exactly this set of themes.

    Studies with the same themes fold into one row before any pairing, and a set
    is never longer than the codebook."""
    return (inc.groupBy("study_id").agg(F.array_sort(F.collect_set("theme_id")).alias("themes"))
            .groupBy("themes").agg(F.count("*").alias("n")))


def overlaps(inc: DataFrame) -> DataFrame:
    """a < b, inter: theme pairs that share a study, with the number shared."""
    sets = theme_sets(inc).filter(F.size("themes") > 1)
    left = sets.select("themes", "n", F.posexplode("themes").alias("i", "a"))
    return (left.select("a", F.explode(F.slice("themes", F.col("i") + 2, F.size("themes"))).alias("b"), "n")
            .groupBy("a", "b").agg(F.sum("n").alias("inter")))


def sizes(inc: DataFrame) -> DataFrame:
    return inc.groupBy("theme_id").agg(F.count("*").alias("n_studies"))


def ordered_overlaps(inc: DataFrame, themes: DataFrame) -> DataFrame:
    """Overlaps with a before b by theme order, and the sizes of both themes."""
    size = themes.select("theme_id", "ord").join(sizes(inc), "theme_id", "left").select(
        "theme_id", "ord", F.coalesce("n_studies", F.lit(0)).alias("n"))
    both = (overlaps(inc)
            .join(size.select(F.col("theme_id").alias("a"), F.col("ord").alias("oa"), F.col("n").alias("na")), "a")
            .join(size.select(F.col("theme_id").alias("b"), F.col("ord").alias("ob"), F.col("n").alias("nb")), "b"))
    first = F.col("oa") < F.col("ob")

    def pick(x, y):
        return F.when(first, F.col(x)).otherwise(F.col(y))
    return both.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"),
                       pick("na", "nb").alias("n_a"), pick("nb", "na").alias("n_b"), "inter")


def theme_pairs(themes: DataFrame) -> DataFrame:
    """Every unordered theme pair (a before b by ord): the size of the answer of a
    pairwise comparison. Each theme lists the numbers of the later themes and
    meets them by an equi-join."""
    n = themes.count()
    ids = numbered(themes.select("theme_id", "ord"), "ord", "i", tie=["theme_id"])
    left = ids.filter(F.col("i") < n).select(
        F.col("theme_id").alias("a"), F.explode(F.sequence(F.col("i") + 1, F.lit(n).cast("bigint"))).alias("j"))
    right = ids.select(F.col("theme_id").alias("b"), F.col("i").alias("j"))
    return left.join(right, "j").select("a", "b")


def all_pair_overlaps(inc: DataFrame, themes: DataFrame) -> DataFrame:
    """Every theme pair with both sizes and the overlap, 0 where nothing is shared."""
    n = themes.select("theme_id").join(sizes(inc), "theme_id", "left").select(
        "theme_id", F.coalesce("n_studies", F.lit(0)).alias("n"))
    inter = ordered_overlaps(inc, themes).select("a", "b", "inter")
    return (theme_pairs(themes).join(inter, ["a", "b"], "left")
            .join(n.select(F.col("theme_id").alias("a"), F.col("n").alias("n_a")), "a")
            .join(n.select(F.col("theme_id").alias("b"), F.col("n").alias("n_b")), "b")
            .select("a", "b", "n_a", "n_b", F.coalesce("inter", F.lit(0)).alias("inter")))


def top_k(df: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. Spark limits each key before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
