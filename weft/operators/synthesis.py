"""Theme bookkeeping, translation of concepts across studies, grading of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..functions.lexicons import CONCERN_WEIGHTS
from ..plans.pairs import incidence
from ..sources.documents import THEME_DEFAULTS, Evidence, distinct_links


# --- themes -------------------------------------------------------------------

def create_themes(themes: DataFrame, new: DataFrame) -> DataFrame:
    """Append a batch of themes; an id that exists keeps its row. Missing level and
    description take their defaults."""
    batch = new
    for name, value in THEME_DEFAULTS.items():
        if name not in batch.columns:
            batch = batch.withColumn(name, F.lit(value))
    fresh = batch.join(themes.select("theme_id"), "theme_id", "left_anti")
    fresh = fresh.dropDuplicates(["theme_id"])
    return themes.unionByName(fresh, allowMissingColumns=True)


def assign_quotes(theme_quotes: DataFrame, theme_studies: DataFrame, assignments: DataFrame):
    """Add (theme_id, quote_id, study_id, pos) rows. Assigning twice changes nothing.
    Returns the new theme_quotes and theme_studies."""
    quotes = theme_quotes.select("theme_id", "quote_id", "pos").unionByName(
        assignments.select("theme_id", "quote_id", "pos"))
    studies = theme_studies.select("theme_id", "study_id", "pos").unionByName(
        assignments.select("theme_id", "study_id", "pos"))
    return (distinct_links(quotes, "theme_id", "quote_id"),
            distinct_links(studies, "theme_id", "study_id"))


def merge_links(links: DataFrame, mapping: DataFrame, item: str) -> DataFrame:
    """Links of merged themes: each item once, ordered by (old theme order, position).
    mapping: old_id, new_id, ord."""
    return (links.join(mapping, F.col("theme_id") == F.col("old_id"))
            .groupBy(F.col("new_id").alias("theme_id"), item)
            .agg(F.min(F.struct("ord", "pos")).alias("first"))
            .select("theme_id", item, F.col("first.ord").alias("theme_ord"),
                    F.col("first.pos").alias("pos")))


def merge_themes(themes: DataFrame, mapping: DataFrame, labels: DataFrame) -> DataFrame:
    """Replace the mapped themes by their merged theme. The new theme takes the label
    from ``labels`` (new_id, label), default level and description and no parent."""
    kept = themes.join(mapping.select(F.col("old_id").alias("theme_id")), "theme_id", "left_anti")
    concepts = (themes.join(mapping.drop("ord"), F.col("theme_id") == F.col("old_id"))
                .select("new_id", "ord", F.posexplode("concepts").alias("pos", "concept"))
                .groupBy("new_id", "concept").agg(F.min(F.struct("ord", "pos")).alias("first"))
                .groupBy("new_id").agg(F.transform(
                    F.array_sort(F.collect_list(F.struct("first", "concept"))),
                    lambda s: s["concept"]).alias("concepts")))
    merged = (mapping.groupBy("new_id").agg(F.min("ord").alias("ord"))
              .join(labels, "new_id").join(concepts, "new_id", "left")
              .select(F.col("new_id").alias("theme_id"), "ord", "label",
                      F.lit(THEME_DEFAULTS["description"]).alias("description"),
                      F.lit(THEME_DEFAULTS["level"]).alias("level"),
                      F.lit(None).cast("string").alias("parent_id"),
                      F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts")))
    return kept.unionByName(merged, allowMissingColumns=True)


def theme_counts(themes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Every theme with its number of links, 0 where it has none."""
    n = links.groupBy("theme_id").agg(F.count("*").alias(name))
    return themes.join(n, "theme_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def theme_saturation(ev: Evidence) -> DataFrame:
    """Share of all studies assigned to each theme."""
    total = ev.studies.agg(F.count("*")).scalar()
    return theme_counts(ev.themes.select("theme_id", "ord"), ev.theme_studies, "n_studies").select(
        "theme_id", "n_studies", safe_div("n_studies", total).alias("saturation"))


def study_coverage(ev: Evidence) -> DataFrame:
    """Themes of each study in theme order."""
    rows = incidence(ev.theme_studies).join(ev.themes.select("theme_id", "ord"), "theme_id")
    return rows.groupBy("study_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "theme_id"))),
                    lambda s: s["theme_id"]).alias("themes"))


def theme_stats(ev: Evidence) -> DataFrame:
    total = ev.studies.agg(F.count("*")).scalar()
    rows = theme_counts(ev.themes.select("theme_id", "ord", "label", "level"), ev.theme_studies, "n_studies")
    if ev.theme_quotes is not None:
        rows = theme_counts(rows, ev.theme_quotes, "n_quotes")
    else:
        rows = rows.withColumn("n_quotes", F.lit(0).cast("bigint"))
    return rows.select("theme_id", "label", "level", "n_quotes", "n_studies",
                       F.round(safe_div("n_studies", total), 2).alias("saturation"))


def covered_studies(ev: Evidence) -> DataFrame:
    return ev.studies.select("study_id").join(ev.theme_studies.select("study_id").distinct(),
                                              "study_id", "left_semi")


def theme_summary(ev: Evidence) -> DataFrame:
    """One row: counts by level, study coverage, labels by level in theme order."""
    n = ev.studies.agg(F.countDistinct("study_id")).scalar()
    covered = covered_studies(ev).agg(F.countDistinct("study_id")).scalar()

    def labels(level):
        kept = F.collect_list(F.when(F.col("level") == level, F.struct("ord", "label")))
        return F.transform(F.array_sort(kept), lambda s: s["label"])
    return ev.themes.agg(
        F.count_if(F.col("level") == "descriptive").alias("n_descriptive"),
        F.count_if(F.col("level") == "analytical").alias("n_analytical"),
        F.count("*").alias("n_total"),
        labels("descriptive").alias("descriptive_labels"),
        labels("analytical").alias("analytical_labels"),
    ).withColumn("study_coverage", F.round(safe_div(covered, n), 2))


# --- grading ------------------------------------------------------------------

CONCERNS = ["methodological_limitations", "coherence", "adequacy", "relevance"]


def assess_findings(findings: DataFrame) -> DataFrame:
    """Overall confidence from the four ordinal concerns; an unknown concern weighs 0."""
    def weight(name):
        w = F.lit(0)
        for concern, value in CONCERN_WEIGHTS.items():
            w = F.when(F.col(name) == concern, F.lit(value)).otherwise(w)
        return w
    weights = [weight(c) for c in CONCERNS]
    total = weights[0] + weights[1] + weights[2] + weights[3]
    worst = F.greatest(*weights)
    grade = (F.when(worst >= 3, "Very Low").when(worst >= 2, "Low").when(total >= 3, "Low")
             .when(total == 0, "High").otherwise("Moderate"))
    return findings.withColumn("overall_confidence", grade)


def findings_table(assessed: DataFrame) -> DataFrame:
    """Summary-of-findings table."""
    return assessed.select("finding_id", F.col("finding_text").alias("finding"),
                           F.col("overall_confidence").alias("confidence"),
                           F.size("contributing_studies").cast("bigint").alias("n_studies"),
                           F.col("contributing_studies").alias("studies"), "explanation")


# --- translation --------------------------------------------------------------

def translation_matrix(studies: DataFrame, concepts: list[str], findings: str = "findings",
                       quotes: DataFrame | None = None) -> DataFrame:
    """study_id, concept, type: present where the concept (lower case, _ as blank) is
    inside the joined findings or inside any quote. One pass over each study row;
    ``concepts`` is the caller's list. Quotes come from the study row, or from a
    separate table (study_id, text) that is reduced to its hits before the join."""
    wanted = [(c, c.lower().replace("_", " ")) for c in dict.fromkeys(concepts)]
    text = F.lower(F.array_join(findings, " "))
    in_row = "quotes" in studies.columns

    def hit(needle):
        found = F.contains(text, F.lit(needle))
        if in_row:
            found = found | F.exists("quotes", lambda q: F.contains(F.lower(q["text"]), F.lit(needle)))
        return found
    cells = studies.select("study_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("concept"), hit(needle).alias("hit")) for c, needle in wanted])).alias("c")
    ).select("study_id", "c.concept", "c.hit")
    if quotes is not None:
        quoted = quotes.select("study_id", F.explode(F.filter(F.array(*[
            F.when(F.contains(F.lower("text"), F.lit(needle)), F.lit(c)) for c, needle in wanted]),
            lambda c: c.isNotNull())).alias("concept")).distinct().withColumn("quoted", F.lit(True))
        cells = cells.join(quoted, ["study_id", "concept"], "left").withColumn(
            "hit", F.col("hit") | F.coalesce("quoted", F.lit(False)))
    return cells.select("study_id", "concept",
                        F.when(F.col("hit"), "present").otherwise("absent").alias("type"))


def coverage(n_present, n_studies):
    return F.when(F.col(n_studies) > 0, F.col(n_present) / F.col(n_studies)).otherwise(F.lit(0.0))


def consistency(n_present, n_refutational):
    p, r = F.col(n_present), F.col(n_refutational)
    return F.when(p > 0, safe_div(p - r, p)).otherwise(F.lit(0.0))


def translation_type(mean_consistency, has_refutational):
    c, r = F.col(mean_consistency), F.col(has_refutational)
    return (F.when((c >= 0.8) & ~r, "reciprocal").when(c < 0.5, "refutational")
            .otherwise("line_of_argument"))


def concept_stats(cells: DataFrame) -> DataFrame:
    """Per concept: coverage and consistency (3 decimals) from any cells table,
    including partial and refutational cells entered by a user."""
    n = cells.agg(F.countDistinct("study_id")).scalar()
    counts = cells.groupBy("concept").agg(
        F.count_if(F.col("type") == "present").alias("n_present"),
        F.count_if(F.col("type") == "refutational").alias("n_refutational")).withColumn("_n", n)
    return counts.select("concept", F.round(coverage("n_present", "_n"), 3).alias("coverage"),
                         F.round(consistency("n_present", "n_refutational"), 3).alias("consistency"),
                         "n_present", "n_refutational")


def matrix_verdict(stats: DataFrame) -> DataFrame:
    """One row: mean consistency over present concepts (1.0 without any) and the type."""
    row = stats.agg(
        F.coalesce(F.avg(F.when(F.col("n_present") > 0, F.col("consistency"))), F.lit(1.0)).alias("c"),
        F.coalesce(F.bool_or(F.col("n_refutational") > 0), F.lit(False)).alias("r"))
    return row.select(F.round("c", 3).alias("overall_consistency"),
                      translation_type("c", "r").alias("translation_type"))


# --- provenance ---------------------------------------------------------------

def input_fingerprint(studies: DataFrame, block: int = 10_000) -> DataFrame:
    """First 16 hex digits of a SHA-256 over (id, n, year) in study order.

    Every ``block`` consecutive order numbers make one JSON list, and each list its digest.
    The digest of a collection of one list is that list's, as for any review; of more, that
    of the JSON list of their digests. No text holds more than a block of studies."""
    item = F.format_string('{"id": "%s", "n": %d, "year": %d}', F.col("study_id").cast("string"),
                           F.col("sample_size"), F.col("year"))

    def listed(name, order):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda s: s[name]), ", ")
    lists = studies.select(F.floor(F.col("ord") / block).alias("block"), "ord", item.alias("item")).groupBy("block").agg(
        F.sha2(F.concat(F.lit("["), listed("item", "ord"), F.lit("]")), 256).alias("digest"))
    several = F.sha2(F.concat(F.lit("["), listed("digest", "block"), F.lit("]")), 256)
    none = F.sha2(F.lit("[]"), 256)
    return lists.agg(F.substring(F.when(F.count("*") == 0, none).when(F.count("*") == 1, F.min("digest")).otherwise(several),
                                 1, 16).alias("input_hash"))


def certification(n_studies, n_themes, n_findings):
    return (F.when(n_studies < 2, "REJECT").when((n_themes == 0) & (n_findings == 0), "WARN")
            .otherwise("PASS"))


def certify(ev: Evidence) -> DataFrame:
    """One row: counts and the certificate."""
    found = (ev.findings_assessed.agg(F.count("*")).scalar() if ev.findings_assessed is not None
             else F.lit(0).cast("bigint"))
    n_themes = ev.themes.agg(F.count("*")).scalar()
    return ev.studies.agg(F.count("*").alias("n_studies")).select(
        "n_studies", n_themes.alias("n_themes"), found.alias("n_findings")).withColumn(
        "certification", certification(F.col("n_studies"), F.col("n_themes"), F.col("n_findings")))


def run_synthesis(ev: Evidence, concepts: list[str] | None = None,
                  synthesis_type: str = "thematic_synthesis") -> dict[str, DataFrame]:
    """The whole first-level report as named tables."""
    out = {"theme_summary": theme_summary(ev), "theme_stats": theme_stats(ev),
           "coverage": study_coverage(ev)}
    if ev.findings_assessed is not None:
        out["findings"] = assess_findings(ev.findings_assessed)
        out["summary_of_findings"] = findings_table(out["findings"])
    concepts = ev.concepts if concepts is None else concepts
    if concepts:
        synthesis_type = "meta_ethnography"
        out["translation"] = translation_matrix(ev.studies, concepts)
        out["concept_stats"] = concept_stats(out["translation"])
        out["translation_verdict"] = matrix_verdict(out["concept_stats"])
    summary = certify(ev)
    analytical = ev.themes.agg(F.count_if(F.col("level") == "analytical")).scalar()
    if {"sample_size", "year"} <= set(ev.studies.columns):
        summary = summary.withColumn("input_hash", input_fingerprint(ev.studies).scalar())
    out["summary"] = summary.withColumn("n_analytical_themes", analytical).withColumn(
        "synthesis_type", F.lit(synthesis_type))
    return out
