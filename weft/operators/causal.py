"""Causal claims in sentences, the signed theme graph they make, and its loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import raw_words, safe_div, strip_space
from ..functions.lexicons import CAUSAL_PATTERNS
from ..plans.codebook import shared_words
from ..plans.lineage import cut
from ..sources.documents import Evidence
from .sentiment import sentence_rows


def causal_claims(parts: DataFrame, patterns=CAUSAL_PATTERNS, phrase_length: int | None = None) -> DataFrame:
    """study_id, part, sent, pattern, direction, cause, effect: the first match of each
    pattern in a sentence with text on both sides: the whole phrases, or the ``phrase_length``
    characters next to the match."""
    tries = []
    for i, (p, sign) in enumerate(patterns):
        rx = F.lit(f"(?iU){p}")
        at = F.regexp_instr("text", rx)
        tries.append(F.when(at > 0, F.struct(F.lit(i).alias("pattern"), F.lit(sign).alias("direction"), at.alias("at"),
                                             F.length(F.regexp_substr("text", rx)).alias("len"))))
    any_of = "(?iU)" + "|".join(f"(?:{p})" for p, _ in patterns)
    hits = (sentence_rows(parts).filter(F.col("text").rlike(any_of))
            .select("study_id", "part", "sent", "text",
                    F.explode(F.filter(F.array(*tries), lambda h: h.isNotNull())).alias("h")))
    before = strip_space(F.expr("substring(text, 1, h.at - 1)"))
    after = strip_space(F.expr("substring(text, h.at + h.len)"))
    if phrase_length is not None:
        before = strip_space(F.right(before, F.lit(phrase_length)))
        after = strip_space(F.left(after, F.lit(phrase_length)))
    claims = hits.select("study_id", "part", "sent", "h.pattern", "h.direction", before.alias("cause"), after.alias("effect"))
    return claims.filter(~F.col("cause").isin("", "unknown") & ~F.col("effect").isin("", "unknown"))


def claim_themes(ev: Evidence, claims: DataFrame) -> DataFrame:
    """Claims with cause_theme and effect_theme: the theme with the largest token overlap, first by
    order; null without one. Claims are distinct by (study_id, part, sent, pattern)."""
    key = ["study_id", "part", "sent", "pattern"]
    words = F.array_distinct(F.concat(raw_words("label"), F.flatten(F.transform("concepts", lambda c: raw_words(c)))))
    book = ev.themes.select("theme_id", "ord", F.explode(words).alias("word"))
    claims = cut(claims)
    sides = claims.select(*key, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), raw_words(s).alias("words")) for s in ("cause", "effect")])).alias("s"))
    met = shared_words(sides.select(*key, "s.side", "s.words"), "words", book).groupBy(*key, "side", "theme_id", "ord").agg(F.count("*").alias("n"))
    best = met.groupBy(*key).agg(*[F.min(F.when(F.col("side") == s, F.struct((-F.col("n")).alias("n"), "ord", "theme_id")))["theme_id"]
                                   .alias(f"{s}_theme") for s in ("cause", "effect")])
    return claims.join(best, key, "left")


def causal_edges(ev: Evidence, matched: DataFrame) -> DataFrame:
    """cause_theme, effect_theme, direction (of the last claim), count; no self-loops."""
    rows = matched.filter(F.col("cause_theme") != F.col("effect_theme")).join(
        ev.studies.select("study_id", "ord"), "study_id")
    return rows.groupBy("cause_theme", "effect_theme").agg(
        F.max_by("direction", F.struct("ord", "part", "sent", "pattern")).alias("direction"), F.count("*").alias("count"))


def feedback_loops(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """themes ARRAY, type: simple cycles from their smallest theme; an even number of
    '-' edges reinforces. Paths grow by one join per length and never revisit."""
    steps = cut(edges.select(F.col("cause_theme").alias("u"), F.col("effect_theme").alias("v"),
                             (F.col("direction") == "-").cast("int").alias("minus")))
    paths = steps.filter("u < v").select(F.array("u", "v").alias("path"), "v", "minus").withColumnRenamed("v", "tip")
    loops = None
    limit = max_length or steps.select(F.explode(F.array("u", "v"))).distinct().count()
    for _ in range(2, limit + 1):
        paths = cut(paths)
        if paths.isEmpty():
            break
        nexts = paths.join(steps.withColumnRenamed("minus", "m"), F.col("tip") == F.col("u"))
        closed = nexts.filter(F.col("v") == F.element_at("path", 1)).select(
            F.col("path").alias("themes"), (F.col("minus") + F.col("m")).alias("minus"))
        loops = closed if loops is None else loops.unionByName(closed)
        paths = nexts.filter((F.col("v") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("v"))).select(
            F.concat("path", F.array("v")).alias("path"), F.col("v").alias("tip"), (F.col("minus") + F.col("m")).alias("minus"))
    if loops is None:
        loops = steps.filter("false").select(F.array("u").alias("themes"), "minus")
    return loops.select("themes", F.when(F.col("minus") % 2 == 0, "reinforcing").otherwise("balancing").alias("type"))


def leverage_themes(edges: DataFrame) -> DataFrame:
    """theme_id, score = out-degree / max(1, in-degree) of every linked theme."""
    ends = edges.select(F.col("cause_theme").alias("theme_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("effect_theme").alias("theme_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("theme_id").agg(safe_div(F.sum("o"), F.greatest(F.sum("i"), F.lit(1))).alias("score"))


def causal_density(parts: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: claims, sentences, claims per sentence."""
    n = claims.agg(F.count("*")).scalar()
    return sentence_rows(parts).agg(F.count("*").alias("n_sentences")).withColumn("n_claims", n).withColumn(
        "density", safe_div("n_claims", "n_sentences"))


def system_archetypes(edges: DataFrame, loops: DataFrame) -> DataFrame:
    """archetype rows that the graph shows."""
    e = edges.select(F.col("cause_theme").alias("u"), F.col("effect_theme").alias("v"))
    detour = e.select("u", F.col("v").alias("m")).join(e.select(F.col("u").alias("m"), "v"), "m").join(
        e, ["u", "v"], "left_semi").agg(F.count("*")).scalar()
    size = F.when(F.col("type") == "reinforcing", F.size("themes"))
    row = loops.agg(F.coalesce(F.bool_or(size >= 3), F.lit(False)).alias("big"),
                    F.coalesce(F.bool_or(size == 3), F.lit(False)).alias("three")).withColumn("detour", detour > 0)
    named = [("big", "Reinforcing loop (>=3 nodes)"), ("three", "Fixes that fail"), ("detour", "Shifting the burden")]
    return row.select(F.explode(F.filter(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in named]),
                                         lambda a: a.isNotNull())).alias("archetype"))


def causal_report(ev: Evidence, parts: DataFrame, patterns=CAUSAL_PATTERNS, phrase_length: int | None = None) -> dict[str, DataFrame]:
    claims = cut(claim_themes(ev, causal_claims(parts, patterns, phrase_length)))
    edges = cut(causal_edges(ev, claims))
    loops = feedback_loops(edges)
    return {"claims": claims, "edges": edges, "matrix": edges.select("cause_theme", "effect_theme", "direction"),
            "loops": loops, "leverage": leverage_themes(edges), "density": causal_density(parts, claims),
            "archetypes": system_archetypes(edges, loops)}
