"""Opposed themes and the themes that bridge them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, round_binary, safe_div, tokenise
from ..functions.lexicons import DIALECTIC_NEGATIVE, DIALECTIC_POSITIVE
from ..plans.lineage import cut
from ..plans.pairs import incidence, overlaps, sizes, theme_pairs, theme_sets
from ..sources.documents import Evidence


def theme_polarity(ev: Evidence, findings: DataFrame, positive=DIALECTIC_POSITIVE, negative=DIALECTIC_NEGATIVE) -> DataFrame:
    """theme_id, polarity: (positive - negative) / both, from the distinct indicator
    tokens of each finding (study_id, text) of the theme's studies; 4 decimals."""
    def count(t, listed):
        return F.size(F.filter(t, lambda w: w.isin(list(listed))))
    both = let(F.array_distinct(tokenise("text")), lambda t: F.struct(count(t, positive).alias("p"), count(t, negative).alias("n")))
    per_study = findings.select("study_id", both.alias("c")).groupBy("study_id").agg(F.sum("c.p").alias("p"), F.sum("c.n").alias("n"))
    per_theme = incidence(ev.theme_studies).join(per_study, "study_id").groupBy("theme_id").agg(
        F.sum("p").alias("p"), F.sum("n").alias("n"))
    return ev.themes.select("theme_id").join(per_theme, "theme_id", "left").select(
        "theme_id", F.round(F.coalesce(safe_div(F.col("p") - F.col("n"), F.col("p") + F.col("n")), F.lit(0.0)), 4).alias("polarity"))


def antithetical_pairs(ev: Evidence, polarity: DataFrame) -> DataFrame:
    """thesis (positive), antithesis (negative), strength of opposed theme pairs."""
    p = polarity.select("theme_id", "polarity")
    rows = theme_pairs(ev.themes).join(p.toDF("a", "pa"), "a").join(p.toDF("b", "pb"), "b").filter(F.col("pa") * F.col("pb") < 0)
    up = F.col("pa") > 0
    return rows.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("thesis"),
                       F.when(up, F.col("b")).otherwise(F.col("a")).alias("antithesis"),
                       round_binary(F.abs(F.col("pa") - F.col("pb")) / 2, 4).alias("strength"))


def syntheses(ev: Evidence, pairs: DataFrame) -> DataFrame:
    """thesis, antithesis, synthesis_theme, completeness: a third theme that shares
    studies with both, and the share of their studies it covers."""
    inc = incidence(ev.theme_studies)
    half = cut(overlaps(inc))
    near = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "inter"))
    n = sizes(inc)
    third = (pairs.select("thesis", "antithesis")
             .join(near.toDF("thesis", "t", "with_thesis"), "thesis")
             .join(near.toDF("antithesis", "t", "with_antithesis"), ["antithesis", "t"]))
    # studies that carry all three themes, from the distinct theme sets
    sets = theme_sets(inc)
    pair = pairs.select("thesis", "antithesis")
    all_three = (sets.select("themes", "n", F.explode("themes").alias("thesis")).join(pair, "thesis")
                 .filter(F.array_contains("themes", F.col("antithesis")))
                 .select("thesis", "antithesis", "n", F.explode("themes").alias("t"))
                 .groupBy("thesis", "antithesis", "t").agg(F.sum("n").alias("triple")))
    both = near.toDF("thesis", "antithesis", "both")
    rows = (third.join(all_three, ["thesis", "antithesis", "t"], "left").join(both, ["thesis", "antithesis"], "left")
            .join(n.toDF("thesis", "n1"), "thesis").join(n.toDF("antithesis", "n2"), "antithesis").fillna(0))
    covered = F.col("with_thesis") + F.col("with_antithesis") - F.col("triple")
    return rows.select("thesis", "antithesis", F.col("t").alias("synthesis_theme"),
                       F.round(safe_div(covered, F.col("n1") + F.col("n2") - F.col("both")), 4).alias("completeness"))


def contradiction_matrix(ev: Evidence, pairs: DataFrame, found: DataFrame) -> DataFrame:
    """a before b, relation: synthesized, contradictory or concordant."""
    key = [F.least("thesis", "antithesis").alias("x"), F.greatest("thesis", "antithesis").alias("y")]
    solved = found.select(*key).distinct().withColumn("solved", F.lit(True))
    opposed = pairs.select(*key).withColumn("opposed", F.lit(True))
    rows = theme_pairs(ev.themes).withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b"))
    return rows.join(solved, ["x", "y"], "left").join(opposed, ["x", "y"], "left").select(
        "a", "b", F.when(F.col("solved"), "synthesized").when(F.col("opposed"), "contradictory").otherwise("concordant").alias("relation"))


def dialectic_scores(ev: Evidence, pairs: DataFrame, found: DataFrame) -> DataFrame:
    """One row: dialectical_depth (pairs with a synthesis / pairs) and resolution_score
    (mean share of a pair's studies that carry one of its synthesis themes)."""
    per_pair = found.groupBy("thesis", "antithesis").agg(F.collect_set("synthesis_theme").alias("s"))
    sets = theme_sets(incidence(ev.theme_studies)).withColumn("id", F.sha2(F.concat_ws("\x01", "themes"), 256))
    side = per_pair.select("thesis", "antithesis", "s", F.explode(F.array("thesis", "antithesis")).alias("theme"))
    met = (sets.select("id", "themes", "n", F.explode("themes").alias("theme")).join(side, "theme")
           .dropDuplicates(["id", "thesis", "antithesis"]))
    share = met.groupBy("thesis", "antithesis").agg(
        safe_div(F.sum(F.when(F.arrays_overlap("themes", "s"), F.col("n")).otherwise(F.lit(0))), F.sum("n")).alias("share"))
    rows = pairs.join(share, ["thesis", "antithesis"], "left")
    return rows.agg(safe_div(F.count("share"), F.count("*")).alias("dialectical_depth"),
                    safe_div(F.coalesce(F.sum("share"), F.lit(0.0)), F.count("*")).alias("resolution_score"))


def dialectic_report(ev: Evidence, findings: DataFrame) -> dict[str, DataFrame]:
    polarity = cut(theme_polarity(ev, findings))
    pairs = cut(antithetical_pairs(ev, polarity))
    found = cut(syntheses(ev, pairs))
    return {"polarity": polarity, "pairs": pairs, "syntheses": found,
            "matrix": contradiction_matrix(ev, pairs, found), "scores": dialectic_scores(ev, pairs, found)}
