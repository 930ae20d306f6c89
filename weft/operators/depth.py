"""Conceptual depth: abstraction levels, coding density, hierarchy, recurrence,
refutation, and the index that combines them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, safe_div
from ..functions.lexicons import ABSTRACTION_WORDS, DISCONFIRMING_WORDS, LEVEL_FIELD
from ..plans.codebook import containing
from ..plans.lineage import cut
from ..plans.pairs import incidence
from ..plans.prefix import numbered, running_sums
from ..plans.ranks import average_ranks, correlation
from ..sources.documents import Evidence
from .argument import clean_words, label_words
from .synthesis import theme_counts


def abstraction_levels(themes: DataFrame) -> DataFrame:
    """theme_id, level 1..4: the highest level with a label word, else the level field."""
    field = F.lit(1)
    for name, value in LEVEL_FIELD.items():
        field = F.when(F.col("level") == name, value).otherwise(field)

    def pick(words):
        out = field
        for level in sorted(ABSTRACTION_WORDS):
            listed = ABSTRACTION_WORDS[level]
            out = F.when(F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in listed]))) > 0, level).otherwise(out)
        return out
    return themes.select("theme_id", let(clean_words("label"), pick).alias("abstraction"))


def level_stats(levels: DataFrame) -> DataFrame:
    """One row: count per level, mean level, share at level 3 or above."""
    a = F.col("abstraction")
    return levels.agg(*[F.count_if(a == k).alias(f"level_{k}") for k in (1, 2, 3, 4)],
                      F.coalesce(F.avg(a), F.lit(0.0)).alias("mean_abstraction"),
                      F.coalesce(F.avg((a >= 3).cast("double")), F.lit(0.0)).alias("theoretical_reach"))


def coding_density(ev: Evidence, quotes: DataFrame) -> DataFrame:
    """One row: mean over studies of distinct coded quotes / max(1, findings)."""
    coded = quotes.join(ev.theme_quotes.select("quote_id").distinct(), "quote_id", "left_semi").groupBy("study_id").agg(
        F.countDistinct("quote_id").alias("codes"))
    return ev.studies.select("study_id", F.size("findings").alias("f")).join(coded, "study_id", "left").agg(
        F.coalesce(F.avg(F.coalesce("codes", F.lit(0)) / F.greatest("f", F.lit(1))), F.lit(0.0)).alias("coding_density"))


def hierarchy_depths(themes: DataFrame, max_rounds: int = 10000) -> DataFrame:
    """theme_id, depth: length of the parent chain; a chain stops before it repeats."""
    up = cut(themes.select(F.col("theme_id").alias("tip"), "parent_id").join(
        themes.select(F.col("theme_id").alias("parent_id")), "parent_id", "left_semi"))
    front = themes.select("theme_id", F.col("theme_id").alias("tip"), F.array().cast("array<string>").alias("seen"))
    out = front
    for _ in range(max_rounds):
        front = cut(front.join(up, "tip").filter(~F.array_contains("seen", F.col("parent_id"))).select(
            "theme_id", F.col("parent_id").alias("tip"), F.concat("seen", F.array("parent_id")).alias("seen")))
        if front.isEmpty():
            return out.groupBy("theme_id").agg(F.max(F.size("seen")).alias("depth"))
        out = out.unionByName(front)
    raise RuntimeError("hierarchy is deeper than max_rounds")


def concept_recurrence(ev: Evidence) -> DataFrame:
    """One row: mean share of studies per concept; the themes stand in for concepts when
    no theme has any."""
    n = ev.studies.agg(F.count("*")).scalar()
    inc = incidence(ev.theme_studies)
    concepts = ev.themes.select("theme_id", F.explode("concepts").alias("concept"))
    reach = concepts.join(inc, "theme_id", "left").groupBy("concept").agg(F.countDistinct("study_id").alias("n"))
    by_concept = reach.agg(F.avg(F.col("n").cast("double"))).scalar()
    by_theme = theme_counts(ev.themes.select("theme_id"), inc, "n").agg(F.avg(F.col("n").cast("double")).alias("t"))
    return by_theme.select(F.coalesce(safe_div(F.coalesce(by_concept, F.col("t")), n), F.lit(0.0)).alias("concept_recurrence"))


def refuted_themes(ev: Evidence, findings: DataFrame, negations=DISCONFIRMING_WORDS) -> DataFrame:
    """theme_id: a study outside the theme has a finding that mentions a label word and
    holds a negation. findings: study_id, text."""
    negated = findings.filter(F.exists(clean_words("text"), lambda w: w.isin(list(negations))))
    hits = containing(negated.select("study_id", "text"), label_words(ev.themes)).select("study_id", "theme_id").distinct()
    return hits.join(incidence(ev.theme_studies), ["study_id", "theme_id"], "left_anti").select("theme_id").distinct()


def refutational_integration(ev: Evidence, findings: DataFrame, negations=DISCONFIRMING_WORDS) -> DataFrame:
    n = ev.themes.agg(F.count("*")).scalar()
    return refuted_themes(ev, findings, negations).agg(safe_div(F.count("*"), n).alias("refutational_integration"))


def development_correlation(ev: Evidence, levels: DataFrame) -> DataFrame:
    """One row: rank correlation of the study order by year (then ord) with the mean
    level of a study's themes (1.0 without any)."""
    mean = incidence(ev.theme_studies).join(levels, "theme_id").groupBy("study_id").agg(
        F.avg(F.col("abstraction").cast("double")).alias("m"))
    rows = cut(ev.studies.select("study_id", "year", "ord").join(mean, "study_id", "left").select(
        "study_id", "year", "ord", F.round(F.coalesce("m", F.lit(1.0)), 12).alias("value")))
    inside = numbered(rows, "ord", "place", by=["year"])
    years = rows.groupBy("year").agg(F.count("*").alias("n"))
    before = running_sums(years, "year", {"upto": F.col("n")}).select("year", (F.col("upto") - F.col("n")).alias("before"))
    placed = inside.join(before, "year").withColumn("rx", F.col("place") + F.col("before"))
    return placed.join(average_ranks(rows, "value", "ry"), "value").agg(correlation("rx", "ry").alias("correlation"))


def depth_index(ev: Evidence, quotes: DataFrame, findings: DataFrame, negations=DISCONFIRMING_WORDS) -> DataFrame:
    """One row: the components and their weighted index in [0, 1]."""
    one = level_stats(abstraction_levels(ev.themes)).select("mean_abstraction", "theoretical_reach")
    parts = {"hierarchy_depth": hierarchy_depths(ev.themes).agg(F.coalesce(F.max("depth"), F.lit(0))).scalar(),
             "coding_density": coding_density(ev, quotes).scalar(), "concept_recurrence": concept_recurrence(ev).scalar(),
             "refutational_integration": refutational_integration(ev, findings, negations).scalar()}
    row = one.select("*", *[v.alias(k) for k, v in parts.items()])
    top = F.lit(1.0)
    index = (0.30 * F.col("mean_abstraction") / 4 + 0.20 * F.least(F.col("hierarchy_depth") / 4, top)
             + 0.20 * F.least("coding_density", top) + 0.15 * F.least("concept_recurrence", top)
             + 0.15 * F.least("refutational_integration", top))
    return row.withColumn("depth_index", F.greatest(F.lit(0.0), F.least(top, index)))


def depth_report(ev: Evidence, quotes: DataFrame, findings: DataFrame) -> dict[str, DataFrame]:
    levels = abstraction_levels(ev.themes)
    return {"levels": levels, "level_stats": level_stats(levels), "index": depth_index(ev, quotes, findings),
            "development": development_correlation(ev, levels)}
