"""Predicting a study's theme from its words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import entropy_of, entropy_term
from ..plans.lineage import cut
from ..plans.prefix import running_sums
from ..sources.documents import Evidence
from .text import document_frequency, term_counts

FEATURES = 50
#: Levels of a tree, studies that a node needs to be split.
DEPTH, LEAST = 5, 2


def top_features(texts: DataFrame, k: int = FEATURES) -> DataFrame:
    """term, df: the k terms of most studies, ties by term."""
    return document_frequency(texts).orderBy(F.desc("df"), F.asc("term")).limit(k)


def feature_values(texts: DataFrame, features: DataFrame) -> DataFrame:
    """study_id, term, value (TF-IDF) of the feature terms that occur."""
    n = texts.agg(F.count("*")).scalar()
    return term_counts(texts).join(features, "term").select(
        "study_id", "term", (F.col("tf") / F.col("n_tokens") * F.log(n / (1.0 + F.col("df")))).alias("value"))


def first_claim_labels(ev: Evidence) -> DataFrame:
    """study_id, label: the first theme by order that has the study."""
    rows = ev.theme_studies.join(ev.themes.select("theme_id", "ord"), "theme_id").join(
        ev.studies.select("study_id"), "study_id", "left_semi")
    return rows.groupBy("study_id").agg(F.min(F.struct("ord", "theme_id"))["theme_id"].alias("label"))


def _gains(sides: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, gain from label counts (n, left) per key; keys with an empty side are left out."""
    right = F.col("n") - F.col("left")
    sums = sides.groupBy(*keys).agg(
        F.sum("left").alias("nl"), F.sum(entropy_term("left")).alias("tl"), F.sum(right).alias("nr"),
        F.sum(entropy_term(right)).alias("tr"), F.sum("n").alias("n"), F.sum(entropy_term("n")).alias("t"))
    mixed = (F.col("nl") * entropy_of("nl", "tl") + F.col("nr") * entropy_of("nr", "tr")) / F.col("n")
    return sums.filter("nl > 0 AND nr > 0").select(*keys, "n", (entropy_of("n", "t") - mixed).alias("gain"))


def split_gains(values: DataFrame, labels: DataFrame, features: DataFrame) -> DataFrame:
    """term, threshold, gain: entropy gain of splitting the labelled studies at the upper
    median of each feature (missing values are 0). Features with an empty side are left
    out. The median comes from running sums over the value histogram."""
    labelled = cut(values.join(labels, "study_id").select("term", F.round("value", 12).alias("value"), "label"))
    total = labels.groupBy("label").agg(F.count("*").alias("n"))
    n = labels.count()
    hist = labelled.groupBy("term", "value").agg(F.count("*").alias("c"))
    seen = hist.groupBy("term").agg(F.sum("c").alias("s"))
    zeros = features.select("term").join(seen, "term", "left").select(
        "term", F.lit(0.0).alias("value"), (n - F.coalesce("s", F.lit(0))).alias("c")).filter("c > 0")
    run = running_sums(hist.unionByName(zeros).groupBy("term", "value").agg(F.sum("c").alias("c")), "value",
                       {"upto": F.col("c")}, by=["term"])
    median = run.filter(F.col("upto") > n // 2).groupBy("term").agg(F.min("value").alias("threshold"))
    found = labelled.join(median, "term").groupBy("term", "label").agg(
        F.count("*").alias("present"), F.count_if(F.col("value") <= F.col("threshold")).alias("low"))
    # label counts on both sides, the zeros of a label counted by subtraction
    book = total.agg(F.collect_list(F.struct("label", "n"))).scalar()
    grid = median.select("term", "threshold", F.explode(book).alias("l")).select("term", "threshold", "l.label", "l.n")
    sides = grid.join(found, ["term", "label"], "left").fillna(0, ["present", "low"]).withColumn(
        "left", F.col("low") + F.when(F.col("threshold") >= 0, F.col("n") - F.col("present")).otherwise(F.lit(0)))
    return _gains(sides, ["term", "threshold"]).drop("n")


def grow(values: DataFrame, samples: DataFrame, features: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Entropy trees, all at once and level by level.

    values: study_id, term, value of the features that occur (others are 0). samples: tree,
    study_id, label, draws, a row for every study that a tree learns from (draws > 0, so often) or
    that it shall only predict (0). features: tree, term.

    Returns ``said`` (tree, study_id, label, draws, predicted) and ``splits`` (tree, node, term,
    threshold, gain, n). A node of one label, of fewer than two draws or at the last level is a leaf
    and says its most frequent label, ties the smallest. Others are split at the upper median of
    the free feature (not yet used above) with the largest gain at 12 decimals, ties the first term;
    without a gain they are leaves.

    A level costs grouped histograms of (tree, node, term, value, label); zeros come by
    subtraction. Node, split and feature tables are broadcast: they have at most trees x 2^depth
    x features rows, whatever the number of studies."""
    place = ["tree", "node"]
    values = values.select("study_id", "term", F.round("value", 12).alias("value"))
    at = cut(samples.select("tree", "study_id", "label", "draws", F.lit(1).cast("bigint").alias("node")))
    path, found = None, []
    for level in range(depth):
        learned = at.filter((F.col("draws") > 0) & (F.col("node") >= 1 << level))
        counts = cut(learned.groupBy(*place, "label").agg(F.sum("draws").alias("n")))
        nodes = counts.groupBy(*place).agg(F.sum("n").alias("total"), F.count("*").alias("labels")).filter(
            (F.col("labels") > 1) & (F.col("total") >= LEAST)).drop("labels")
        free = nodes.join(F.broadcast(features), "tree")
        free = cut(free if path is None else free.join(F.broadcast(path), [*place, "term"], "left_anti"))
        present = learned.join(values, "study_id").join(F.broadcast(free.select(*place, "term")), [*place, "term"]).groupBy(
            *place, "term", "label", "value").agg(F.sum("draws").alias("c"))
        seen = present.groupBy(*place, "term", "label").agg(F.sum("c").alias("s"))
        zeros = free.select(*place, "term").join(counts, place).join(seen, [*place, "term", "label"], "left").select(
            *place, "term", "label", F.lit(0.0).alias("value"), (F.col("n") - F.coalesce("s", F.lit(0))).alias("c")).filter("c > 0")
        hist = cut(present.unionByName(zeros))
        run = running_sums(hist.groupBy(*place, "term", "value").agg(F.sum("c").alias("c")), "value", {"upto": F.col("c")}, by=[*place, "term"])
        median = run.join(F.broadcast(free), [*place, "term"]).filter(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(
            *place, "term").agg(F.min("value").alias("threshold"))
        sides = hist.join(F.broadcast(median), [*place, "term"]).groupBy(*place, "term", "threshold", "label").agg(
            F.sum(F.when(F.col("value") <= F.col("threshold"), F.col("c")).otherwise(0)).alias("l"), F.sum("c").alias("n"))
        gains = _gains(sides.withColumnRenamed("l", "left"), [*place, "term", "threshold"])
        best = cut(gains.filter(F.round("gain", 12) > 0).groupBy(*place).agg(F.min(F.struct(
            (-F.round("gain", 12)).alias("g"), "term", "threshold", "gain", "n")).alias("b")).select(
            *place, "b.term", "b.threshold", "b.gain", "b.n"))
        if best.isEmpty():
            break
        found.append(best)
        down = at.join(F.broadcast(best.select(*place, "term", "threshold")), place, "left").join(values, ["study_id", "term"], "left")
        child = F.col("node") * 2 + (F.coalesce("value", F.lit(0.0)) > F.col("threshold")).cast("int")
        at = cut(down.select("tree", "study_id", "label", "draws", F.when(F.col("term").isNull(), F.col("node")).otherwise(child).alias("node")))
        above = best.select(*place, "term") if path is None else best.select(*place, "term").unionByName(
            path.join(best.select(*place), place, "left_semi"))
        path = cut(above.select("tree", F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("node"), "term"))
    leaves = at.filter("draws > 0").groupBy(*place, "label").agg(F.sum("draws").alias("n")).groupBy(*place).agg(
        F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("predicted"))
    said = at.join(F.broadcast(leaves), place, "left").select("tree", "study_id", "label", "draws", "predicted")
    splits = at.select("tree", "node").limit(0).selectExpr(
        "tree", "node", "'' AS term", "0D AS threshold", "0D AS gain", "0L AS n") if not found else found[0]
    for more in found[1:]:
        splits = splits.unionByName(more)
    return said, splits


def tree_predictions(values: DataFrame, labels: DataFrame, features: DataFrame) -> DataFrame:
    """study_id, label, predicted by one tree over all labelled studies."""
    said, _ = grow(values, labels.select(F.lit(0).alias("tree"), "study_id", "label", F.lit(1).alias("draws")),
                   features.select(F.lit(0).alias("tree"), "term"))
    return said.select("study_id", "label", "predicted")


def _uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) per key that does not depend on partitioning: 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), 1, 8), 16, 10).cast(
        "bigint") / float(1 << 32)


def poisson_limits() -> list[float]:
    """A uniform number has so many Poisson(1) draws as limits that it reaches."""
    limits, p, total = [], math.exp(-1), 0.0
    for i in range(1, 9):
        total += p
        limits.append(total)
        p /= i
    return limits


def forest(values: DataFrame, labels: DataFrame, features: DataFrame, trees: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``said`` and ``splits`` of trees that each draw every study Poisson(1) times, by hash, and use
    the first sqrt(k) of the k features in the order of a hash of their own."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    u = _uniform(seed, "tree", "study_id")
    drawn = sum((F.when(u >= limit, 1).otherwise(0) for limit in poisson_limits()), F.lit(0))
    samples = labels.select("study_id", "label", numbers).withColumn("draws", drawn)
    # at most k rows a tree
    order = Window.partitionBy("tree").orderBy(_uniform(seed, "tree", "term"), "term")
    k = max(1, math.isqrt(features.count()))
    chosen = features.select("term", numbers).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return grow(values, samples, cut(chosen.select("tree", "term")))


def forest_importance(values: DataFrame, labels: DataFrame, features: DataFrame, trees: int = 10, seed: int = 42, k: int = 10) -> DataFrame:
    """term, importance: the k features with the largest gains, each weighed by its node's share of
    the draws and averaged over the trees."""
    said, splits = forest(values, labels, features, trees, seed)
    bags = said.groupBy("tree").agg(F.sum("draws").alias("bag"))
    share = splits.join(F.broadcast(bags), "tree").groupBy("term").agg(
        (F.sum(F.col("gain") * F.col("n") / F.col("bag")) / trees).alias("importance"))
    return share.orderBy(F.desc(F.round("importance", 12)), "term").limit(k)


def out_of_bag_error(values: DataFrame, labels: DataFrame, features: DataFrame, trees: int = 10, seed: int = 42) -> DataFrame:
    """One row: n, oob_error of the forest's votes on studies that a tree did not draw. A study
    that every tree drew has no vote and is not counted in n; a label that no bag of its
    voters has counts as an error."""
    said, _ = forest(values, labels, features, trees, seed)
    return vote_error(said.filter("draws = 0").select("study_id", "label", "predicted"))


def vote_error(votes: DataFrame) -> DataFrame:
    """One row: n, oob_error of the most frequent prediction per study (ties: the smallest),
    for a table (study_id, label, predicted) with a row per vote."""
    counts = votes.groupBy("study_id", "label", "predicted").agg(F.count("*").alias("n"))
    best = counts.groupBy("study_id", "label").agg(F.min(F.struct((-F.col("n")).alias("n"), "predicted"))["predicted"].alias("predicted"))
    return best.agg(F.count("*").alias("n"), (1 - F.avg((F.col("label") == F.col("predicted")).cast("double"))).alias("oob_error"))


def fold_accuracy(values: DataFrame, labels: DataFrame, features: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """One row: n, accuracy of trees tested on folds they did not see. A label that only the
    tested fold has counts as an error."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("tree")
    own = F.floor(_uniform(seed, "study_id") * folds).cast("int")
    said, _ = grow(values, labels.select("study_id", "label", numbers).withColumn("draws", (own != F.col("tree")).cast("int")),
                   cut(features.select("term", numbers)))
    right = F.coalesce(F.col("label") == F.col("predicted"), F.lit(False)).cast("double")
    return said.filter("draws = 0").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))


def classifier_report(ev: Evidence, texts: DataFrame, seed: int = 42) -> dict[str, DataFrame]:
    features = cut(top_features(texts))
    labels = cut(first_claim_labels(ev))
    values = cut(feature_values(texts, features))
    return {"split_gains": split_gains(values, labels, features), "predictions": tree_predictions(values, labels, features),
            "importance": forest_importance(values, labels, features, seed=seed),
            "oob_error": out_of_bag_error(values, labels, features, seed=seed),
            "fold_accuracy": fold_accuracy(values, labels, features, seed=seed)}
