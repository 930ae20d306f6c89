"""Entropy saturation, species richness of themes, reflexivity indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import entropy_of, entropy_term, let, log_choose, log_factorial, safe_div
from ..functions.lexicons import REFLEXIVITY_ADVICE
from ..plans.lineage import cut
from ..plans.pairs import incidence, sizes
from ..plans.prefix import numbered, running_sums
from ..sources.documents import Evidence
from .synthesis import covered_studies, theme_counts


# --- entropy ------------------------------------------------------------------

def theme_distribution(ev: Evidence) -> DataFrame:
    """Every theme with its number of known studies (zeros kept)."""
    return theme_counts(ev.themes.select("theme_id", "ord"), incidence(ev.theme_studies, ev.studies),
                        "n_studies")


def diversity(counts: DataFrame, count: str = "n_studies") -> DataFrame:
    """One row over a table of counts: total, Shannon entropy, entropy over log2 of
    the number of rows (zeros included), and the Gini-Simpson index."""
    c = F.col(count).cast("double")
    row = counts.agg(F.sum(count).alias("total"), F.sum(entropy_term(count)).alias("terms"),
                     F.sum(c * c).alias("squares"), F.count("*").alias("k"))
    h = entropy_of("total", "terms")
    return row.select(
        F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(h, F.lit(0.0)).alias("entropy"),
        F.when(F.col("k") > 1, F.coalesce(h, F.lit(0.0)) / F.log2(F.greatest(F.col("k"), F.lit(2))))
        .otherwise(F.lit(0.0)).alias("normalised_entropy"),
        F.when(F.col("total") > 0, F.lit(1.0) - safe_div("squares", F.col("total").cast("double") * F.col("total")))
        .otherwise(F.lit(0.0)).alias("gini"))


def saturation_curve(ev: Evidence) -> DataFrame:
    """Entropy of the theme distribution after each study, in study order.

    With c the running count of a theme, a row adds f(c) - f(c - 1), f(c) = c log2 c;
    the entropy of a prefix is then log2(T) - S / T from two running sums."""
    k = ev.themes.agg(F.count("*")).scalar()
    rows = incidence(ev.theme_studies).join(ev.studies.select("study_id", "ord"), "study_id")
    ranked = numbered(rows, "ord", "c", by=["theme_id"])
    steps = ranked.groupBy("study_id").agg(
        F.count("*").alias("added"),
        F.sum(entropy_term("c") - entropy_term(F.col("c") - 1)).alias("gained"))
    per_study = cut(ev.studies.select("study_id", "ord").join(steps, "study_id", "left").select(
        "study_id", "ord", F.coalesce("added", F.lit(0)).alias("added"),
        F.coalesce("gained", F.lit(0.0)).alias("gained")))
    run = running_sums(per_study, "ord", {"t": F.col("added"), "s": F.col("gained"),
                                          "position": F.lit(1).cast("bigint")})
    h = entropy_of("t", "s")
    # the prefix without this study, from the same running sums
    before = F.when(F.col("position") == 1, F.lit(0.0)).otherwise(
        entropy_of(F.col("t") - F.col("added"), F.col("s") - F.col("gained")))
    return run.select(
        "study_id", (F.col("position") - 1).alias("idx"), h.alias("entropy"),
        F.when(k > 1, h / F.log2(F.greatest(k, F.lit(2)))).otherwise(F.lit(0.0)).alias("normalised_entropy"),
        (h - before).alias("info_gain"))


def saturation_index(curve: DataFrame, threshold: float = 0.05) -> DataFrame:
    """One row: first index past 0 whose gain is under the threshold, or null."""
    return curve.filter((F.col("idx") >= 1) & (F.abs("info_gain") < threshold)).agg(
        F.min("idx").alias("saturation_index"))


def mutual_information(ev: Evidence) -> DataFrame:
    """One row: H(T) minus the mean entropy of the themes inside a study. A study has
    each theme once, so its entropy is log2 of its number of themes."""
    inc = incidence(ev.theme_studies, ev.studies)
    whole = sizes(inc).agg(F.sum("n_studies").alias("total"),
                           F.sum(entropy_term("n_studies")).alias("terms"))
    inside = inc.groupBy("study_id").agg(F.count("*").alias("n")).agg(
        F.sum(entropy_term("n"))).scalar()
    return whole.select(F.when(F.col("total") > 0, entropy_of("total", "terms")
                               - safe_div(inside, F.col("total"))).otherwise(F.lit(0.0))
                        .alias("mutual_information"))


# --- richness -----------------------------------------------------------------

def abundances(ev: Evidence) -> DataFrame:
    """abundance, f: how many themes have exactly that many known studies."""
    return (sizes(incidence(ev.theme_studies, ev.studies))
            .groupBy(F.col("n_studies").alias("abundance")).agg(F.count("*").alias("f")))


def richness(ev: Evidence, z: float = 1.96) -> DataFrame:
    """One row: observed themes, Chao1 with its log-normal interval, Good-Turing
    probability of a new theme, coverage, unseen themes."""
    a, f = F.col("abundance"), F.col("f")
    base = abundances(ev).agg(
        F.coalesce(F.sum(f), F.lit(0)).alias("s"),
        F.coalesce(F.sum(F.when(a == 1, f)), F.lit(0)).alias("f1"),
        F.coalesce(F.sum(F.when(a == 2, f)), F.lit(0)).alias("f2"),
        F.coalesce(F.sum(a * f), F.lit(0)).alias("n"))
    s, f1, f2 = (F.col(c).cast("double") for c in ("s", "f1", "f2"))
    two = F.col("f2") > 0
    unseen = F.when(two, safe_div(f1 * f1, 2 * f2)).otherwise(f1 * (f1 - 1) / 2)
    spread = F.when(two, safe_div(f1 * f1, 2 * f2) * (1 + safe_div(f1 * f1, 4 * f2 * f2))).otherwise(
        f1 * (f1 - 1) / 2 + f1 * (2 * f1 - 1) * (2 * f1 - 1) / 4)
    row = base.withColumn("d", unseen).withColumn("v", spread)
    d, v = F.col("d"), F.col("v")
    factor = F.exp(z * F.sqrt(F.log(1 + safe_div(v, d * d))))
    known, degenerate = d <= 0, v <= 0
    p_new = safe_div("f1", "n")
    return row.select(
        F.col("s").alias("observed"), F.col("f1").alias("singletons"), F.col("f2").alias("doubletons"),
        F.col("n").alias("assignments"), (s + d).alias("chao1"),
        F.when(known | degenerate, s).otherwise(s + d / factor).alias("ci_low"),
        F.when(known, s).when(degenerate, s + d).otherwise(s + d * factor).alias("ci_high"),
        p_new.alias("p_new"), F.when(F.col("n") > 0, 1 - p_new).otherwise(F.lit(0.0)).alias("coverage"),
        F.greatest(F.lit(0.0), d).alias("unseen"))


def rarefaction_curve(ev: Evidence) -> DataFrame:
    """m, expected_themes for samples of m = 1..N studies.

    One row per study number; the abundance histogram rides along as an array
    (never longer than the codebook), so there is no join."""
    n = ev.studies.agg(F.count("*")).scalar()
    hist = abundances(ev).withColumn("n", n.cast("double")).agg(
        F.collect_list(F.struct(F.col("abundance").cast("double").alias("a"), F.col("f").cast("double").alias("f"),
                                log_factorial(F.col("n") - F.col("abundance")).alias("l")))).scalar()
    m = F.col("m").cast("double")
    rows = numbered(ev.studies.select("ord"), "ord", "m").select("m", n.cast("double").alias("n"),
                                                                hist.alias("hist"))
    # log choose(n - a, m) - log choose(n, m); what does not depend on the abundance is found once a row
    once = F.struct(log_factorial(m).alias("m"), log_choose(F.col("n"), m).alias("all"))
    seen = let(once, lambda o: F.aggregate("hist", F.lit(0.0), lambda acc, h: acc + h["f"] * (
        1 - F.when(F.col("n") - h["a"] >= m, F.exp(
            h["l"] - o["m"] - log_factorial(F.greatest(F.col("n") - h["a"], m) - m) - o["all"]))
        .otherwise(F.lit(0.0)))))
    return rows.select("m", seen.alias("expected_themes"))


def extrapolation_curve(ev: Evidence) -> DataFrame:
    """m, expected_themes for m = N+1 .. max(2N, N+5), from singletons only."""
    a, f = F.col("abundance"), F.col("f")
    base = abundances(ev).agg(
        F.struct(F.coalesce(F.sum(f), F.lit(0)).cast("double").alias("s"),
                 F.coalesce(F.sum(F.when(a == 1, f)), F.lit(0)).cast("double").alias("f1"))).scalar()
    n = ev.studies.agg(F.count("*")).scalar()
    rows = numbered(ev.studies.select("ord"), "ord", "i").withColumn("n", n).select("n", F.explode(
        # the last study also carries the steps of a collection of fewer than five
        F.when((F.col("i") == F.col("n")) & (F.col("n") < 5), F.sequence(F.col("i"), F.lit(5).cast("bigint")))
        .otherwise(F.array("i"))).alias("extra"))
    s, f1 = base["s"], base["f1"]
    d = F.when(f1 > 1, f1 * (f1 - 1) / 2).otherwise(f1)
    grown = s + d - d * F.exp(-safe_div(f1 * F.col("extra"), d))
    return rows.select((F.col("n") + F.col("extra")).alias("m"),
                       F.when((d <= 0) | (f1 <= 0), s).otherwise(grown).alias("expected_themes"))


def richness_report(ev: Evidence) -> dict[str, DataFrame]:
    return {"richness": richness(ev), "rarefaction": rarefaction_curve(ev),
            "extrapolation": extrapolation_curve(ev)}


def saturation_report(ev: Evidence, threshold: float = 0.05) -> dict[str, DataFrame]:
    curve = saturation_curve(ev)
    return {"curve": curve, "saturation_index": saturation_index(curve, threshold),
            "mutual_information": mutual_information(ev), "diversity": diversity(theme_distribution(ev))}


# --- reflexivity --------------------------------------------------------------

def reflexivity(ev: Evidence, cells: DataFrame | None = None) -> DataFrame:
    """indicator, score, overall, rating, advice: six indicators as six rows."""
    n = ev.studies.agg(F.count("*")).scalar()
    ids = ev.studies.agg(F.countDistinct("study_id")).scalar()
    covered = covered_studies(ev).agg(F.countDistinct("study_id")).scalar()
    rows = theme_counts(ev.themes.select("theme_id", "level", "concepts"), ev.theme_studies, "n_studies")
    if ev.theme_quotes is not None:
        rows = theme_counts(rows, ev.theme_quotes, "n_quotes")
    else:
        rows = rows.withColumn("n_quotes", F.lit(0))
    filled = (cells.agg(F.avg((F.col("type") != "absent").cast("double"))).scalar()
              if cells is not None else F.lit(None).cast("double"))

    def share(condition):
        return F.coalesce(F.avg(condition.cast("double")), F.lit(0.0))
    one = rows.withColumn("_n", n).agg(
        share((F.col("_n") > 0) & (F.col("n_studies") > F.col("_n") / 2)).alias("theme_saturation"),
        F.coalesce(F.least(F.avg("n_quotes") / 5, F.lit(1.0)), F.lit(0.0)).alias("quote_density"),
        share(F.exists("concepts", lambda c: F.contains(F.lower(c), F.lit("refut")))).alias("disconfirming_evidence"),
        share(F.col("level") == "analytical").alias("analytical_depth")
    ).withColumn("study_coverage", safe_div(covered, ids)).withColumn(
        "translation_completeness", F.coalesce(filled, F.lit(0.0)))
    names = list(REFLEXIVITY_ADVICE)
    overall = sum((F.col(c) for c in names), F.lit(0.0)) / len(names)
    rating = F.when(overall >= 0.7, "Green").when(overall >= 0.4, "Amber").otherwise("Red")
    long = one.select(overall.alias("overall"), rating.alias("rating"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("indicator"), F.col(c).alias("score"), F.lit(REFLEXIVITY_ADVICE[c]).alias("advice"))
        for c in names])).alias("i"))
    return long.select("i.indicator", "i.score", "overall", "rating",
                       F.when(F.col("i.score") < 0.5, F.col("i.advice")).alias("advice"))
