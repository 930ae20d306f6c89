"""Themes over publication years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, entropy_of, entropy_term, let, safe_div
from ..plans.lineage import cut
from ..plans.pairs import incidence, theme_pairs
from ..plans.prefix import numbered
from ..sources.documents import Evidence

#: Pairs of studies with this many themes each, or fewer, are counted through theme subsets.
NARROW = 12
#: Parts of the themes that subsets are summed by, and years that are summed at once.
PARTS, YEARS = 4, 16


def yearly(ev: Evidence) -> DataFrame:
    """theme_id, year, n: known assigned studies per year."""
    return incidence(ev.theme_studies).join(ev.studies.select("study_id", "year"), "study_id").groupBy(
        "theme_id", "year").agg(F.count("*").alias("n"))


def emergence(ev: Evidence) -> DataFrame:
    first = yearly(ev).groupBy("theme_id").agg(F.min("year").alias("year"))
    return ev.themes.select("theme_id").join(first, "theme_id", "left")


def growth_curves(ev: Evidence) -> DataFrame:
    """theme_id, year, cumulative: every year from the first to the last of a theme."""
    counts = yearly(ev)
    spans = counts.groupBy("theme_id").agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    grid = spans.select("theme_id", F.explode(F.sequence("lo", "hi")).alias("year"))
    run = Window.partitionBy("theme_id").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(counts, ["theme_id", "year"], "left").select(
        "theme_id", "year", F.sum(F.coalesce("n", F.lit(0))).over(run).alias("cumulative"))


def temporal_diversity(ev: Evidence) -> DataFrame:
    """year, entropy of the theme counts of that year (0 in a year without themes)."""
    per = yearly(ev).groupBy("year").agg(F.sum("n").alias("t"), F.sum(entropy_term("n")).alias("s"))
    return ev.studies.select("year").distinct().join(per, "year", "left").select(
        "year", entropy_of(F.coalesce("t", F.lit(0)), F.coalesce("s", F.lit(0.0))).alias("entropy"))


def innovation_rate(ev: Evidence) -> DataFrame:
    """year, rate: themes that emerge in the year / all themes."""
    k = ev.themes.agg(F.count("*")).scalar()
    born = emergence(ev).groupBy("year").agg(F.count("*").alias("n"))
    return ev.studies.select("year").distinct().join(born, "year", "left").select(
        "year", safe_div(F.coalesce("n", F.lit(0)), k).alias("rate"))


def paradigm_shifts(diversity: DataFrame, drop: float = 0.30) -> DataFrame:
    """year: the entropy fell by more than ``drop`` of the previous study year's."""
    # one row per year, so the unpartitioned window is a few hundred rows at most
    before = F.lag("entropy").over(Window.partitionBy(F.lit(0)).orderBy("year"))
    return diversity.withColumn("before", before).filter(F.col("before") > 0).filter(
        safe_div(F.col("before") - F.col("entropy"), "before") > drop).select("year")


def influence_edges(ev: Evidence) -> DataFrame:
    """source, target: an earlier study and a later one with a common theme. The answer
    itself can be quadratic; ``influence_degree`` does not build it."""
    rows = incidence(ev.theme_studies).join(ev.studies.select("study_id", "year"), "study_id")
    later = rows.select("theme_id", F.col("study_id").alias("target"), F.col("year").alias("later"))
    return rows.join(later, "theme_id").filter("year < later").select(F.col("study_id").alias("source"), "target").distinct()


def _subset_counts(counts: DataFrame, years: list[str]) -> DataFrame:
    """s and a column per year: how many studies of the year have a theme of s, for the sets s of counts (s, a
    column per year with the studies of exactly this set) and all their subsets but the empty one.

    First the studies that have all themes of s are summed, then these sums over the subsets of s with alternating signs.
    Both go by a part of the themes at a time, so a set meets its subsets within one part and never all of them, and equal
    subsets are one row after each part."""
    def within(part: int) -> Column:
        split = F.struct(F.filter("s", lambda t: t % PARTS == part).alias("i"), F.filter("s", lambda t: t % PARTS != part).alias("o"))
        return F.explode(let(split, lambda x: F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.pow(F.lit(2), F.size(x["i"])).cast("bigint") - 1),
            lambda m: F.array_sort(F.concat(x["o"], F.filter(x["i"], lambda t, k: (
                F.floor(m / F.pow(F.lit(2), k)).cast("bigint") % 2) == 1))))))
    sums = [F.sum(y).alias(y) for y in years]
    for part in range(PARTS):
        counts = cut(counts.select(within(part).alias("s"), *years).groupBy("s").agg(*sums))
    odd = F.size("s") % 2 == 1
    counts = counts.filter(F.size("s") > 0).select("s", *[F.when(odd, F.col(y)).otherwise(-F.col(y)).alias(y) for y in years])
    for part in range(PARTS):
        met = counts.select(F.col("s").alias("x"), within(part).alias("s")).join(counts, "s")
        counts = cut(met.groupBy(F.col("x").alias("s")).agg(*sums))
    return counts


def influence_degree(ev: Evidence, narrow: int = NARROW) -> DataFrame:
    """study_id, degree: number of later studies that share a theme.

    Studies are folded by (theme set, year). Among the sets of up to ``narrow`` themes, those that meet a
    set are counted by inclusion and exclusion over its subsets (``_subset_counts``), for some years at a time: the work
    grows with the different subsets and not with the pairs. A set with more themes meets the others
    theme by theme, and costs its own pairs only. A study without a year is neither earlier nor later."""
    links = incidence(ev.theme_studies)
    names = cut(numbered(links.select("theme_id").distinct(), "theme_id", "t").select("theme_id", F.col("t").cast("int").alias("t")))
    per_study = links.join(names, "theme_id").groupBy("study_id").agg(F.array_sort(F.collect_list("t")).alias("s"))
    rows = cut(per_study.join(ev.studies.select("study_id", "year").filter("year IS NOT NULL"), "study_id"))
    classes = cut(rows.groupBy("s", "year").agg(F.count("*").alias("n")))
    few = classes.filter(F.size("s") <= narrow)
    years = sorted(r["year"] for r in classes.select("year").distinct().collect())
    meets = classes.select("s", "year", F.lit(0).cast("bigint").alias("n")).limit(0)
    sets = few.select("s").distinct()
    for at in range(0, len(years), YEARS):
        some = {f"y{y}": y for y in years[at:at + YEARS]}
        counts = few.groupBy("s").agg(*[F.coalesce(F.sum(F.when(F.col("year") == y, F.col("n"))), F.lit(0)).alias(c) for c, y in some.items()])
        found = _subset_counts(counts, list(some)).join(sets, "s", "left_semi")
        meets = meets.unionByName(found.select("s", F.explode(F.array(*[F.struct(F.lit(y).cast(classes.schema["year"].dataType).alias(
            "year"), F.col(c).alias("n")) for c, y in some.items()])).alias("y")).select("s", "y.*"))
    later = Window.partitionBy("s").orderBy(F.desc("year")).rowsBetween(Window.unboundedPreceding, -1)
    among_few = meets.select("s", "year", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("k"))
    item = classes.select("s", "year", "n", F.explode("s").alias("t"))
    wide = item.filter(F.size("s") > narrow).select(F.col("s").alias("w"), F.col("year").alias("y"), F.col("n").alias("m"), "t")
    # sets with several common themes meet in the first of them only
    met = item.join(wide, "t").filter((F.col("year") != F.col("y")) & (F.col("t") == F.array_min(F.array_intersect("s", "w"))))
    with_wide = met.filter("year < y").select("s", "year", F.col("m").alias("k")).unionByName(
        met.filter((F.col("year") > F.col("y")) & (F.size("s") <= narrow)).select(
            F.col("w").alias("s"), F.col("y").alias("year"), F.col("n").alias("k")))
    reach = among_few.unionByName(with_wide).groupBy("s", "year").agg(F.sum("k").alias("degree"))
    found = rows.join(reach, ["s", "year"]).select("study_id", "degree")
    return ev.studies.select("study_id").join(found, "study_id", "left").select(
        "study_id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def co_evolution(ev: Evidence) -> DataFrame:
    """a before b, correlation of the cumulative counts over all study years (0 where a
    side is constant). Each theme carries its counts as one array over the years."""
    years = ev.studies.agg(F.sort_array(F.collect_set("year"))).scalar()
    per = yearly(ev).groupBy("theme_id").agg(F.collect_list(F.struct("year", "n")).alias("h"))
    grown = F.transform("years", lambda y: F.aggregate(
        F.filter(F.coalesce("h", F.array().cast("array<struct<year:int,n:bigint>>")), lambda p: p["year"] <= y),
        F.lit(0.0), lambda s, p: s + p["n"]))
    vectors = ev.themes.select("theme_id").join(per, "theme_id", "left").withColumn("years", years).select(
        "theme_id", grown.alias("v"))

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def centred(v):
        return let(v, lambda x: let(total(x) / F.greatest(F.size(x), F.lit(1)), lambda m: F.transform(x, lambda e: e - m)))

    def product(x, y):
        return total(F.zip_with(x, y, lambda p, q: p * q))
    vectors = vectors.select("theme_id", centred(F.col("v")).alias("v"))
    rows = theme_pairs(ev.themes).join(vectors.toDF("a", "va"), "a").join(vectors.toDF("b", "vb"), "b")
    spread = F.sqrt(product(F.col("va"), F.col("va"))) * F.sqrt(product(F.col("vb"), F.col("vb")))
    return rows.select("a", "b", clamp(safe_div(product(F.col("va"), F.col("vb")), spread), -1.0, 1.0).alias("correlation"))


def temporal_report(ev: Evidence) -> dict[str, DataFrame]:
    diversity = temporal_diversity(ev)
    return {"emergence": emergence(ev), "growth": growth_curves(ev), "diversity": diversity,
            "innovation": innovation_rate(ev), "shifts": paradigm_shifts(diversity),
            "influence": influence_degree(ev), "co_evolution": co_evolution(ev)}
