"""Themes as objects, inclusion of study sets as arrows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..plans.pairs import all_pair_overlaps, incidence, ordered_overlaps, theme_pairs
from ..sources.documents import Evidence
from .synthesis import theme_counts


def morphisms(ev: Evidence) -> DataFrame:
    """source, target: identities and inclusions; an empty theme maps to every theme."""
    o = all_pair_overlaps(incidence(ev.theme_studies), ev.themes)
    return (ev.themes.select(F.col("theme_id").alias("source"), F.col("theme_id").alias("target"))
            .unionByName(o.filter("inter = n_a").select(F.col("a").alias("source"), F.col("b").alias("target")))
            .unionByName(o.filter("inter = n_b").select(F.col("b").alias("source"), F.col("a").alias("target"))))


def products(ev: Evidence) -> DataFrame:
    """a before b by order, n_studies: pairs with a non-empty intersection."""
    return ordered_overlaps(incidence(ev.theme_studies), ev.themes).select("a", "b", F.col("inter").alias("n_studies"))


def product_members(ev: Evidence) -> DataFrame:
    """a, b, study_id: the studies of each product, pairs cut from each study's themes."""
    sets = incidence(ev.theme_studies).join(ev.themes.select("theme_id", "ord"), "theme_id").groupBy("study_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "theme_id"))), lambda s: s["theme_id"]).alias("t"))
    left = sets.select("study_id", "t", F.posexplode("t").alias("i", "a"))
    return left.select("a", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("b"), "study_id")


def coproducts(ev: Evidence) -> DataFrame:
    """a before b, n_studies: size of the union for every pair."""
    o = all_pair_overlaps(incidence(ev.theme_studies), ev.themes)
    return o.select("a", "b", (F.col("n_a") + F.col("n_b") - F.col("inter")).alias("n_studies"))


def coproduct_members(ev: Evidence) -> DataFrame:
    """a before b, study_id: the studies of each union. As long as the answer: each study once for
    every pair with one of its themes."""
    inc, pairs = incidence(ev.theme_studies), theme_pairs(ev.themes)
    sides = [pairs.join(inc.withColumnRenamed("theme_id", c), c).select("a", "b", "study_id") for c in ("a", "b")]
    return sides[0].unionByName(sides[1]).distinct()


def isomorphism_classes(ev: Evidence) -> DataFrame:
    """theme_id, representative: themes with the same study set (all empty ones
    together) share the first by order."""
    counts = theme_counts(ev.themes.select("theme_id", "ord"), incidence(ev.theme_studies), "n")
    o = ordered_overlaps(incidence(ev.theme_studies), ev.themes).filter("inter = n_a AND inter = n_b")
    firsts = (o.join(counts.select(F.col("theme_id").alias("a"), "ord"), "a").groupBy(F.col("b").alias("theme_id"))
              .agg(F.min(F.struct("ord", "a")).alias("m")))
    empty = counts.filter("n = 0").agg(F.min(F.struct("ord", "theme_id"))["theme_id"]).scalar()
    return counts.join(firsts, "theme_id", "left").select(
        "theme_id", F.when(F.col("n") == 0, empty).otherwise(F.coalesce("m.a", "theme_id")).alias("representative"))


def universal_objects(ev: Evidence, arrows: DataFrame | None = None) -> DataFrame:
    """One row: the terminal theme (covers all assigned studies) and the initial theme
    (inside every theme), first by order, null where there is none."""
    inc = incidence(ev.theme_studies)
    arrows = morphisms(ev) if arrows is None else arrows
    k = ev.themes.agg(F.count("*")).scalar()
    everything = inc.agg(F.countDistinct("study_id")).scalar()
    rows = (theme_counts(ev.themes.select("theme_id", "ord"), inc, "n")
            .join(arrows.groupBy(F.col("source").alias("theme_id")).agg(F.count("*").alias("up")), "theme_id", "left")
            .withColumn("all", everything).withColumn("k", k))

    def first(condition):
        return F.min(F.when(condition, F.struct("ord", "theme_id")))["theme_id"]
    return rows.agg(first(F.col("n") == F.col("all")).alias("terminal"), first(F.col("up") == F.col("k")).alias("initial"))


def adjunction_score(ev: Evidence) -> DataFrame:
    """One row: share of themes recovered by theme -> studies -> themes, i.e. of themes
    with a study."""
    counts = theme_counts(ev.themes.select("theme_id"), incidence(ev.theme_studies), "n")
    return counts.agg(safe_div(F.count_if(F.col("n") > 0), F.count("*")).alias("adjunction_score"))


def category_report(ev: Evidence) -> dict[str, DataFrame]:
    return {"morphisms": morphisms(ev), "products": products(ev), "product_members": product_members(ev),
            "coproducts": coproducts(ev), "iso_classes": isomorphism_classes(ev),
            "universal": universal_objects(ev), "adjunction": adjunction_score(ev)}
