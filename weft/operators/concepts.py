"""Formal concepts and exact implications of the study x theme incidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.pairs import incidence, theme_sets
from ..sources.documents import Evidence


def _fingerprint(extent):
    """Order-free key of a set of objects, summed without collecting it."""
    h = F.xxhash64(extent)
    return F.concat_ws(":", F.count("*"), F.bit_xor(h), F.sum(F.xxhash64(extent, F.lit(7)).cast("decimal(38,0)")))


def object_classes(ev: Evidence) -> DataFrame:
    """obj, themes, n: known studies folded by their exact theme set (studies with no
    theme are the class of the empty set)."""
    inc = incidence(ev.theme_studies, ev.studies)
    sets = theme_sets(inc)
    bare = ev.studies.select("study_id").join(inc, "study_id", "left_anti").groupBy().agg(F.count("*").alias("n"))
    rows = sets.unionByName(bare.filter("n > 0").select(F.array().cast("array<string>").alias("themes"), "n"))
    return rows.withColumn("obj", F.sha2(F.concat_ws("\x01", "themes"), 256))


def closures(ev: Evidence, sets: DataFrame) -> DataFrame:
    """set_id, closure ARRAY (sorted), n_studies for given theme sets (set_id, themes ARRAY): how many studies
    carry all themes of the set, and the themes that all of these carry. A set that no study
    carries closes to all themes, the empty set to the themes of every study.

    A set meets the study classes of its themes and keeps those it meets in every theme, so the
    work grows with these meetings, not with sets x studies."""
    objects = cut(object_classes(ev))
    has = cut(objects.select("obj", F.explode("themes").alias("theme")))
    sets = sets.select("set_id", F.array_distinct("themes").alias("themes"))
    weight = objects.select("obj", "n")
    extents = cut(sets.select("set_id", F.size("themes").alias("k"), F.explode("themes").alias("theme")).join(has, "theme").groupBy(
        "set_id", "k", "obj").agg(F.count("*").alias("c")).filter("c = k").join(weight, "obj").select("set_id", "obj", "n"))
    size = extents.groupBy("set_id").agg(F.sum("n").alias("n_studies"))
    shared = extents.join(has, "obj").groupBy("set_id", "theme").agg(F.sum("n").alias("c")).join(size, "set_id").filter("c = n_studies")
    found = shared.groupBy("set_id", "n_studies").agg(F.array_sort(F.collect_list("theme")).alias("closure"))
    everything = objects.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    common = has.join(weight, "obj").groupBy("theme").agg(F.sum("n").alias("c")).withColumn("all", everything).filter("c = all").agg(
        F.array_sort(F.collect_list("theme"))).scalar()
    every = ev.themes.agg(F.array_sort(F.collect_list("theme_id"))).scalar()
    bare = F.size("themes") == 0
    return sets.join(found, "set_id", "left").withColumns({"_all": everything, "_common": common, "_every": every}).select(
        "set_id", F.when(bare & (F.col("_all") > 0), F.col("_common")).otherwise(F.coalesce("closure", "_every")).alias("closure"),
        F.when(bare, F.col("_all")).otherwise(F.coalesce("n_studies", F.lit(0))).cast("bigint").alias("n_studies"))


def _lattice(ev: Evidence) -> tuple[DataFrame, DataFrame]:
    """Concepts (concept, intent, n_studies) and the cover relation (parent, child).

    Round by round each new concept is extended by one theme; equal extents are one
    concept. Joins are on the object class and the concept key only. A concept covers another one
    if all themes that the other has more lead to it, so covers come from these steps, and no concept
    is compared with all others. The theme set of no study, when it exists, closes the lattice
    at the bottom."""
    objects = cut(object_classes(ev))
    has = cut(objects.select("obj", F.explode("themes").alias("theme")))
    weight = objects.select("obj", "n")
    top = objects.select("obj").withColumn("concept", objects.agg(_fingerprint("obj")).scalar())
    front = cut(top.select("concept", "obj"))
    extents, known, steps = front, cut(front.select("concept").distinct()), None
    while True:
        sized = front.groupBy("concept").agg(F.count("*").alias("size"))
        grown = front.join(has, "obj")
        part = grown.groupBy("concept", "theme").agg(F.count("*").alias("n"), _fingerprint("obj").alias("next"))
        smaller = cut(part.join(sized, "concept").filter("n < size").select("concept", "theme", "next"))
        steps = smaller if steps is None else steps.unionByName(smaller)
        fresh = (smaller.groupBy("next").agg(F.min(F.struct("concept", "theme")).alias("s"))
                 .join(known.select(F.col("concept").alias("next")), "next", "left_anti")
                 .select("next", F.col("s.concept").alias("concept"), F.col("s.theme").alias("theme")))
        front = cut(grown.join(fresh, ["concept", "theme"]).select(F.col("next").alias("concept"), "obj"))
        if front.isEmpty():
            break
        extents = extents.unionByName(front)
        known = cut(known.unionByName(front.select("concept").distinct()))
    extents = cut(extents)
    size = extents.join(weight, "obj").groupBy("concept").agg(F.count("*").alias("c"), F.sum("n").alias("n_studies"))
    shared = (extents.join(has, "obj").groupBy("concept", "theme").agg(F.count("*").alias("k"))
              .join(size.select("concept", "c"), "concept").filter("k = c")
              .groupBy("concept").agg(F.array_sort(F.collect_list("theme")).alias("intent")))
    out = cut(size.join(shared, "concept", "left").select(
        "concept", F.coalesce("intent", F.array().cast("array<string>")).alias("intent"), "n_studies"))
    every = ev.themes.agg(F.array_sort(F.collect_list("theme_id")).alias("intent"))
    full = out.agg(F.max(F.size("intent"))).scalar()
    bottom = every.filter(F.size("intent") > full).select(
        F.lit("bottom").alias("concept"), "intent", F.lit(0).cast("bigint").alias("n_studies"))
    length = out.select("concept", F.size("intent").alias("length"))
    led = steps.groupBy("concept", "next").agg(F.count("*").alias("k"))
    covers = led.join(length, "concept").join(length.toDF("next", "longer"), "next").filter(F.col("longer") - F.col("length") == F.col("k")).select(
        F.col("concept").alias("parent"), F.col("next").alias("child"))
    lowest = out.select("concept").join(steps.select("concept").distinct(), "concept", "left_anti").withColumn(
        "child", bottom.agg(F.first("concept")).scalar()).filter("child IS NOT NULL").select(F.col("concept").alias("parent"), "child")
    return out.unionByName(bottom), covers.unionByName(lowest)


def formal_concepts(ev: Evidence) -> DataFrame:
    """concept, intent ARRAY (sorted), n_studies: all maximal study set / theme set pairs."""
    return _lattice(ev)[0]


def concept_covers(ev: Evidence) -> DataFrame:
    """parent, child: concepts with none between them; the child has the larger intent."""
    return _lattice(ev)[1]


def concept_ranks(concepts: DataFrame, covers: DataFrame) -> DataFrame:
    """concept, rank: length of the longest chain of covers below."""
    front, out, rank = concepts.select("concept"), concepts.select("concept", F.lit(0).alias("rank")), 0
    while True:
        rank += 1
        front = cut(covers.join(front.withColumnRenamed("concept", "child"), "child", "left_semi").select(F.col("parent").alias("concept")).distinct())
        if front.isEmpty():
            return out.groupBy("concept").agg(F.max("rank").alias("rank"))
        out = out.unionByName(front.withColumn("rank", F.lit(rank)))


def implications(ev: Evidence, max_size: int | None = 4) -> DataFrame:
    """antecedent ARRAY, consequent, support: theme sets of at most ``max_size`` themes
    (None: of any size, two to the power of the largest theme set) whose studies all carry the consequent. Subsets are cut from the distinct theme
    sets, each with the number of studies that carry it."""
    sets = theme_sets(incidence(ev.theme_studies, ev.studies))
    grow = sets.select("themes", "n", F.array().cast("array<string>").alias("a"), F.lit(0).alias("next"))
    subsets = None
    if max_size is None:
        max_size = max(1, sets.agg(F.max(F.size("themes"))).first()[0] or 1)
    for _ in range(max_size):
        grow = (grow.filter(F.col("next") < F.size("themes"))
                .select("themes", "n", "a", "next", F.posexplode(
                    F.slice("themes", F.col("next") + 1, F.size("themes"))).alias("i", "t"))
                .select("themes", "n", F.concat("a", F.array("t")).alias("a"), (F.col("next") + F.col("i") + 1).alias("next")))
        subsets = grow.select("themes", "n", "a") if subsets is None else subsets.unionByName(grow.select("themes", "n", "a"))
    support = subsets.groupBy("a").agg(F.sum("n").alias("support"))
    with_item = subsets.select("a", "n", F.explode(F.array_except("themes", "a")).alias("consequent")).groupBy(
        "a", "consequent").agg(F.sum("n").alias("both"))
    return with_item.join(support, "a").filter("both = support").select(
        F.col("a").alias("antecedent"), "consequent", "support")


def concept_report(ev: Evidence) -> dict[str, DataFrame]:
    """Concepts with the covers, ranks, height and width (largest rank level) of their lattice."""
    concepts, edges = (cut(x) for x in _lattice(ev))
    level = cut(concept_ranks(concepts, edges))
    return {"concepts": concepts, "edges": edges, "ranks": level,
            "summary": level.groupBy("rank").agg(F.count("*").alias("n")).agg(
                F.sum("n").alias("n_concepts"), F.max("rank").alias("height"), F.max("n").alias("width")),
            "implications": implications(ev)}
