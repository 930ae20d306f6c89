"""Graded membership of studies in themes.

Membership is a sparse table (study_id, theme_id, mu > 0); a missing cell is 0."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, safe_div, tokenise
from ..plans.codebook import shared_words
from ..plans.pairs import incidence, theme_pairs
from ..sources.documents import Evidence


def membership(ev: Evidence, quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """mu is the share of the study's quotes assigned to the theme; where the study has
    no quote or the theme no assigned quote, the Jaccard overlap of the tokens of the
    findings (``texts``: study_id, text) and of the theme's label and concepts. An
    assigned study has at least 0.5."""
    per_study = quotes.groupBy("study_id").agg(F.countDistinct("quote_id").alias("n_quotes"))
    links = ev.theme_quotes.select("theme_id", "quote_id").distinct()
    quoted = links.select("theme_id").distinct().withColumn("has_quotes", F.lit(True))
    zero = F.lit(None).cast("double")
    by_quote = (quotes.select("study_id", "quote_id").distinct().join(links, "quote_id")
                .groupBy("study_id", "theme_id").agg(F.count("*").alias("shared"))
                .join(per_study, "study_id")
                .select("study_id", "theme_id", safe_div("shared", "n_quotes").alias("q"), zero.alias("j"), F.lit(False).alias("a")))
    words = F.array_distinct(tokenise(F.concat_ws(" ", "label", F.array_join("concepts", " "))))
    book = ev.themes.select("theme_id", words.alias("words")).select("theme_id", F.size("words").alias("size"), F.explode("words").alias("word"))
    said = texts.select("study_id", F.array_distinct(tokenise("text")).alias("t")).select("study_id", F.size("t").alias("n_t"), "t")
    met = shared_words(said, "t", book).groupBy("study_id", "theme_id").agg(
        F.count("*").alias("n"), F.first("n_t").alias("n_t"), F.first("size").alias("size"))
    by_word = met.select("study_id", "theme_id", zero.alias("q"), safe_div("n", F.col("n_t") + F.col("size") - F.col("n")).alias("j"), F.lit(False).alias("a"))
    by_hand = incidence(ev.theme_studies).select("study_id", "theme_id", zero.alias("q"), zero.alias("j"), F.lit(True).alias("a"))
    rows = (by_quote.unionByName(by_word).unionByName(by_hand).groupBy("study_id", "theme_id")
            .agg(F.max("q").alias("q"), F.max("j").alias("j"), F.bool_or("a").alias("a"))
            .join(ev.studies.select("study_id"), "study_id", "left_semi")
            .join(per_study, "study_id", "left").join(quoted, "theme_id", "left"))
    graded = F.when(F.col("n_quotes").isNotNull() & F.col("has_quotes").isNotNull(), F.coalesce("q", F.lit(0.0))).otherwise(
        F.coalesce("j", F.lit(0.0)))
    return rows.select("study_id", "theme_id", F.when(F.col("a"), F.greatest(graded, F.lit(0.5))).otherwise(graded).alias("mu")
                       ).filter("mu > 0")


def theme_measures(ev: Evidence, mu: DataFrame, alpha: float = 0.3) -> DataFrame:
    """theme_id, cardinality, core (mu > 0.5), support (mu > 0), alpha_cut (mu >= alpha),
    entropy over all studies, sharpness."""
    n = ev.studies.agg(F.count("*")).scalar()
    m = F.col("mu")
    inner = (m > 0) & (m < 1)
    x = F.when(inner, m).otherwise(F.lit(0.5))
    sums = mu.groupBy("theme_id").agg(
        F.sum(m).alias("cardinality"), F.count_if(m > 0.5).alias("core"), F.count_if(m > 0).alias("support"),
        F.count_if(m >= alpha).alias("alpha_cut"),
        F.sum(F.when(inner, -(x * F.log(x) + (1 - x) * F.log(1 - x))).otherwise(F.lit(0.0))).alias("e"))
    rows = ev.themes.select("theme_id").join(sums, "theme_id", "left").fillna(0)
    entropy = clamp(safe_div("e", n * math.log(2)))
    return rows.select("theme_id", "cardinality", "core", "support", "alpha_cut", entropy.alias("entropy"),
                       (1 - entropy).alias("sharpness"))


def members(mu: DataFrame, level: float, strict: bool = False) -> DataFrame:
    """theme_id, study_id of a cut: core (0.5, strict), support (0, strict), alpha-cut."""
    m = F.col("mu")
    return mu.filter(m > level if strict else m >= level).select("theme_id", "study_id")


def fuzzy_similarity(ev: Evidence, mu: DataFrame) -> DataFrame:
    """a before b, jaccard, cosine for every theme pair. Pairs are cut from a study's own
    cells (at most the codebook) and summed before the shuffle; sum(max) follows from
    the cardinalities, so studies in only one of the two are never paired."""
    cells = mu.join(ev.themes.select("theme_id", "ord"), "theme_id").groupBy("study_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "theme_id", "mu"))).alias("c"))
    left = cells.select("c", F.posexplode("c").alias("i", "x"))
    both = left.select("x", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("y")).groupBy(
        F.col("x.theme_id").alias("a"), F.col("y.theme_id").alias("b")).agg(
        F.sum(F.least("x.mu", "y.mu")).alias("low"), F.sum(F.col("x.mu") * F.col("y.mu")).alias("dot"))
    own = ev.themes.select("theme_id").join(mu.groupBy("theme_id").agg(
        F.sum("mu").alias("s"), F.sum(F.col("mu") * F.col("mu")).alias("q")), "theme_id", "left").fillna(0.0)
    rows = (theme_pairs(ev.themes).join(both, ["a", "b"], "left").fillna(0.0)
            .join(own.toDF("a", "sa", "qa"), "a").join(own.toDF("b", "sb", "qb"), "b"))
    return rows.select("a", "b", safe_div("low", F.col("sa") + F.col("sb") - F.col("low")).alias("jaccard"),
                       safe_div("dot", F.sqrt("qa") * F.sqrt("qb")).alias("cosine"))


def dominant_themes(ev: Evidence, mu: DataFrame) -> DataFrame:
    """study_id, theme_id: the strongest membership, first by theme order; the first
    theme for a study without any."""
    first = ev.themes.agg(F.min(F.struct("ord", "theme_id"))["theme_id"]).scalar()
    best = mu.join(ev.themes.select("theme_id", "ord"), "theme_id").groupBy("study_id").agg(
        F.max(F.struct("mu", (-F.col("ord")).alias("o"), "theme_id"))["theme_id"].alias("theme_id"))
    return ev.studies.select("study_id").join(best, "study_id", "left").select(
        "study_id", F.coalesce("theme_id", first).alias("theme_id"))


def fuzzy_report(ev: Evidence, mu: DataFrame) -> dict[str, DataFrame]:
    return {"membership": mu, "measures": theme_measures(ev, mu), "similarity": fuzzy_similarity(ev, mu),
            "core": members(mu, 0.5, True), "support": members(mu, 0.0, True), "alpha_cut": members(mu, 0.3),
            "dominant": dominant_themes(ev, mu)}
