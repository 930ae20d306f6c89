"""Theme assignment measured as retrieval: precision, recall, F1, NDCG, AUC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quality_weight, safe_div
from ..plans.pairs import sizes
from ..plans.prefix import numbered, running_sums
from ..sources.documents import Evidence


def precision_recall(ev: Evidence) -> DataFrame:
    """theme_id, precision (mean quality weight of the known assigned studies), recall
    (share of all studies, at most 1), f1."""
    n = ev.studies.agg(F.count("*")).scalar()
    weights = ev.studies.select("study_id", quality_weight("quality_score").alias("w"))
    p = ev.theme_studies.join(weights, "study_id").groupBy("theme_id").agg(F.avg("w").alias("p"))
    rows = (ev.themes.select("theme_id").join(p, "theme_id", "left").join(sizes(ev.theme_studies), "theme_id", "left")
            .select("theme_id", F.coalesce("p", F.lit(0.0)).alias("precision"),
                    F.least(safe_div(F.coalesce("n_studies", F.lit(0)), n), F.lit(1.0)).alias("recall")))
    pr, rc = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", safe_div(2 * pr * rc, pr + rc))


def mean_precision(per_theme: DataFrame) -> DataFrame:
    return per_theme.agg(F.coalesce(F.avg("precision"), F.lit(0.0)).alias("map_score"))


def ndcg(ev: Evidence, mu: DataFrame | None = None) -> DataFrame:
    """theme_id, ndcg: assigned studies ranked by membership, then position; the gain is
    the quality weight.

    A rank is the number of rows in better groups plus the place inside the own group;
    both come from range-cut running sums, so one huge theme is not one task."""
    rows = ev.theme_studies.join(ev.studies.select("study_id", quality_weight("quality_score").alias("w")), "study_id")
    if mu is None:
        rows = rows.withColumn("score", F.lit(-1.0))
    else:
        rows = rows.join(mu, ["theme_id", "study_id"], "left").withColumn("score", -F.coalesce("mu", F.lit(0.0)))
    rows = rows.select("theme_id", "study_id", "pos", "w", "score")

    def ranked(rows, group, name):
        inside = numbered(rows, "pos", name, by=["theme_id", group], tie=["study_id"])
        hist = rows.groupBy("theme_id", group).agg(F.count("*").alias("n"))
        run = running_sums(hist, group, {"upto": F.col("n")}, by=["theme_id"])
        better = run.select("theme_id", group, (F.col("upto") - F.col("n")).alias("before"))
        return inside.join(better, ["theme_id", group]).withColumn(name, F.col(name) + F.col("before")).drop("before")
    gain = F.col("w") / F.log2(F.col("r") + 1)
    actual = ranked(rows, "score", "r").groupBy("theme_id").agg(F.sum(gain).alias("dcg"))
    ideal = ranked(rows.withColumn("level", -F.col("w")), "level", "r").groupBy("theme_id").agg(F.sum(gain).alias("idcg"))
    return ev.themes.select("theme_id").join(actual, "theme_id", "left").join(ideal, "theme_id", "left").select(
        "theme_id", F.coalesce(safe_div("dcg", "idcg"), F.lit(0.0)).alias("ndcg"))


def auc(ev: Evidence, mu: DataFrame) -> DataFrame:
    """theme_id, auc: chance that an assigned study outranks another one, ties half; 0.5
    when all studies are on one side. Works on the histogram of membership values; the
    cells missing from the sparse table are one group at 0."""
    n = ev.studies.agg(F.count("*")).scalar()
    positive = (ev.theme_studies.select("theme_id", "study_id").distinct()
                .join(ev.studies.select("study_id"), "study_id", "left_semi").withColumn("hit", F.lit(1)))
    total = positive.groupBy("theme_id").agg(F.count("*").alias("p"))
    per_theme = ev.themes.select("theme_id").join(total, "theme_id", "left").select(
        "theme_id", F.coalesce("p", F.lit(0)).alias("p"), n.alias("n"))
    hist = mu.join(positive, ["theme_id", "study_id"], "left").groupBy("theme_id", "mu").agg(
        F.count("hit").alias("np"), (F.count("*") - F.count("hit")).alias("nn"))
    listed = hist.groupBy("theme_id").agg(F.sum("np").alias("lp"), F.sum("nn").alias("ln"))
    zeros = per_theme.join(listed, "theme_id", "left").fillna(0).select(
        "theme_id", F.lit(0.0).alias("mu"), (F.col("p") - F.col("lp")).alias("np"),
        (F.col("n") - F.col("p") - F.col("ln")).alias("nn"))
    run = running_sums(hist.unionByName(zeros), "mu", {"upto": F.col("nn")}, by=["theme_id"])
    wins = run.groupBy("theme_id").agg(F.sum(F.col("np") * (F.col("upto") - F.col("nn") / 2.0)).alias("u"))
    pairs = F.col("p").cast("double") * (F.col("n") - F.col("p"))
    return per_theme.join(wins, "theme_id", "left").select("theme_id", safe_div("u", pairs, 0.5).alias("auc"))


def retrieval_report(ev: Evidence, mu: DataFrame | None = None) -> dict[str, DataFrame]:
    base = precision_recall(ev)
    area = auc(ev, mu) if mu is not None else ev.themes.select("theme_id", F.lit(0.5).alias("auc"))
    return {"precision_recall": base, "map": mean_precision(base), "ndcg": ndcg(ev, mu), "auc": area,
            "mean_auc": area.agg(F.coalesce(F.avg("auc"), F.lit(0.5)).alias("mean_auc"))}
