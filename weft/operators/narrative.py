"""Storylines (themes in order of first mention), their similarity and traditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, safe_div, spaced_words
from ..plans.blocks import paired_within
from ..plans.codebook import shared_words
from ..plans.components import connected_components
from ..plans.lineage import cut
from ..plans.pairs import incidence, theme_pairs
from ..sources.documents import Evidence


def storylines(ev: Evidence) -> DataFrame:
    """study_id, themes ARRAY: themes by the first finding with one of their words, then
    the assigned but unmentioned ones, ties in theme order."""
    long = F.filter(F.array_distinct(F.concat(spaced_words("label"), F.flatten(F.transform("concepts", spaced_words)))),
                    lambda w: F.length(w) > 2)
    book = ev.themes.select("theme_id", "ord", F.explode(long).alias("word"))
    said = ev.studies.select("study_id", F.posexplode("findings").alias("at", "text")).select("study_id", "at", spaced_words("text").alias("words"))
    first = shared_words(said, "words", book).groupBy("study_id", "theme_id", "ord").agg(F.min("at").cast("bigint").alias("at"))
    own = incidence(ev.theme_studies).join(ev.themes.select("theme_id", "ord"), "theme_id").select(
        "study_id", "theme_id", "ord", F.lit(1 << 40).alias("at"))
    told = first.unionByName(own).groupBy("study_id", "theme_id", "ord").agg(F.min("at").alias("at")).groupBy("study_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "ord", "theme_id"))), lambda t: t["theme_id"]).alias("themes"))
    return ev.studies.select("study_id").join(told, "study_id", "left").select(
        "study_id", F.coalesce("themes", F.array().cast("array<string>")).alias("themes"))


def storyline_classes(stories: DataFrame) -> DataFrame:
    """line (key), themes, n: equal storylines are one row before any comparison."""
    return stories.groupBy(F.array_join("themes", "\x01").alias("line"), "themes").agg(F.count("*").alias("n"))


def storyline_similarity(ev: Evidence, classes: DataFrame) -> DataFrame:
    """a < b, similarity = 1 - edit distance / longer length, for distinct storylines with
    a common theme. Without a common theme the distance is the longer length, so the
    missing pairs are exactly 0; equal storylines are 1."""
    met = paired_within(classes.select("line", "themes", F.explode("themes").alias("theme")).distinct(), "theme", "line", ["themes"])
    pairs = met.select("a", "b", "themes_a", "themes_b").distinct()

    def spelled(themes, known):
        """One character per theme, by its place among the themes of the pair."""
        def letter(t):
            at = F.array_position(known, t)
            return F.decode(F.unhex(F.lpad(F.hex(at + F.when(at < 20_000, 0x4E00).otherwise(0x20000)), 8, "0")), "UTF-32")
        return F.array_join(F.transform(themes, letter), "")
    distance = let(F.array_union("themes_a", "themes_b"), lambda known: F.levenshtein(
        spelled(F.col("themes_a"), known), spelled(F.col("themes_b"), known)))
    longer = F.greatest(F.size("themes_a"), F.size("themes_b"))
    return pairs.select("a", "b", (1 - distance / longer).alias("similarity"))


def traditions(ev: Evidence, stories: DataFrame, threshold: float = 0.5) -> DataFrame:
    """study_id, cluster: single linkage of storylines above the threshold; a cluster is
    its first study in order."""
    classes = cut(storyline_classes(stories))
    near = storyline_similarity(ev, classes).filter(F.col("similarity") > threshold)
    groups = connected_components(classes.select("line"), near.select("a", "b"), "line")
    rows = (stories.select("study_id", F.array_join("themes", "\x01").alias("line")).join(groups, "line")
            .join(ev.studies.select("study_id", "ord"), "study_id"))
    first = rows.groupBy("component").agg(F.min(F.struct("ord", "study_id"))["study_id"].alias("cluster"))
    return rows.join(first, "component").select("study_id", "cluster")


def core_themes(stories: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, theme_id, distinctive: themes of more than half of a cluster's studies;
    distinctive when no other cluster has it as core."""
    n = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    counts = (stories.select("study_id", F.explode("themes").alias("theme_id")).join(clusters, "study_id")
              .groupBy("cluster", "theme_id").agg(F.count("*").alias("c")).join(n, "cluster").filter(F.col("c") > F.col("n") * 0.5))
    holders = counts.groupBy("theme_id").agg(F.count("*").alias("k"))
    return counts.join(holders, "theme_id").select("cluster", "theme_id", (F.col("k") == 1).alias("distinctive"))


def paradigm_evolution(ev: Evidence, clusters: DataFrame) -> DataFrame:
    """year, cluster: the most frequent cluster, first by study order on a tie."""
    counts = ev.studies.select("study_id", "year", "ord").join(clusters, "study_id").groupBy("year", "cluster").agg(
        F.count("*").alias("n"), F.min("ord").alias("first"))
    return counts.groupBy("year").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "cluster"))["cluster"].alias("cluster"))


def _theme_clusters(stories: DataFrame, clusters: DataFrame) -> DataFrame:
    rows = stories.select("study_id", F.explode("themes").alias("theme_id")).join(clusters, "study_id")
    return rows.select("theme_id", "cluster").distinct()


def bridging_themes(stories: DataFrame, clusters: DataFrame) -> DataFrame:
    return _theme_clusters(stories, clusters).groupBy("theme_id").agg(F.count("*").alias("n")).filter("n >= 2").select("theme_id")


def incommensurability(ev: Evidence, stories: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: of the theme pairs with different cluster sets, the share that no study
    tells together. Cluster sets are compared by order-free hash sums."""
    h = F.xxhash64("cluster")
    sets = cut(_theme_clusters(stories, clusters).groupBy("theme_id").agg(F.concat_ws(
        ":", F.count("*"), F.bit_xor(h), F.sum(F.xxhash64("cluster", F.lit(7)).cast("decimal(38,0)"))).alias("key")))
    lines = stories.select(F.array_sort("themes").alias("t")).distinct()
    told = lines.select("t", F.posexplode("t").alias("i", "a")).select(
        "a", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("b")).distinct().withColumn("told", F.lit(1))
    pairs = (theme_pairs(ev.themes).join(sets.toDF("a", "ka"), "a").join(sets.toDF("b", "kb"), "b").filter("ka <> kb")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(told, ["a", "b"], "left"))
    return pairs.agg(F.count("*").alias("n_pairs"), safe_div(F.count("*") - F.count("told"), F.count("*")).alias("incommensurability"))


def narrative_report(ev: Evidence) -> dict[str, DataFrame]:
    stories = cut(storylines(ev))
    clusters = cut(traditions(ev, stories))
    return {"storylines": stories, "similarity": storyline_similarity(ev, storyline_classes(stories)), "clusters": clusters,
            "core_themes": core_themes(stories, clusters), "evolution": paradigm_evolution(ev, clusters),
            "incommensurability": incommensurability(ev, stories, clusters), "bridging": bridging_themes(stories, clusters)}
