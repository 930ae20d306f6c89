"""Queries over the study x theme tables: synthesis, saturation, richness."""

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import saturation as sat
from ..operators import synthesis as syn
from ..sources import tables
from .registry import query
from .views import CUSTOMERS, DOCS, EVENTS, ORDERS
from .views import r6 as R

big = "bigint"


@query("theme_saturation", f"""WITH {ORDERS}
SELECT th.theme_id, count(study_id) AS n_studies, {R("count(study_id) / (SELECT count(*) FROM st)::DOUBLE")} AS saturation
FROM th LEFT JOIN ts ON ts.theme_id = th.theme_id GROUP BY th.theme_id""")
def theme_saturation(spark, folder):
    return syn.theme_saturation(tables.orders_evidence(spark, folder)).select(
        "theme_id", "n_studies", r6("saturation").alias("saturation"))


@query("study_coverage", f"""WITH {ORDERS}
SELECT study_id, string_agg(ts.theme_id, ',' ORDER BY ord) AS themes FROM ts JOIN th ON th.theme_id = ts.theme_id
GROUP BY study_id""")
def study_coverage(spark, folder):
    return syn.study_coverage(tables.orders_evidence(spark, folder)).select(
        "study_id", F.array_join("themes", ",").alias("themes"))


@query("theme_stats", f"""WITH {DOCS},
q AS (SELECT theme_id, count(*) n FROM tq GROUP BY 1), s AS (SELECT theme_id, count(*) n FROM ts GROUP BY 1)
SELECT th.theme_id, label, level, coalesce(q.n, 0) AS n_quotes, coalesce(s.n, 0) AS n_studies,
  round(coalesce(s.n, 0) / (SELECT count(*) FROM st)::DOUBLE, 2) AS saturation
FROM th LEFT JOIN q ON q.theme_id = th.theme_id LEFT JOIN s ON s.theme_id = th.theme_id""")
def theme_stats(spark, folder):
    return syn.theme_stats(tables.documents_evidence(spark, folder))


@query("theme_summary", f"""WITH {DOCS}
SELECT count(*) FILTER (level = 'descriptive') AS n_descriptive, count(*) FILTER (level = 'analytical') AS n_analytical,
  count(*) AS n_total, string_agg(label, '|' ORDER BY ord) FILTER (level = 'descriptive') AS descriptive_labels,
  string_agg(label, '|' ORDER BY ord) FILTER (level = 'analytical') AS analytical_labels,
  round((SELECT count(DISTINCT study_id) FROM ts) / (SELECT count(*) FROM st)::DOUBLE, 2) AS study_coverage FROM th""")
def theme_summary(spark, folder):
    out = syn.theme_summary(tables.documents_evidence(spark, folder))
    return (out.withColumn("descriptive_labels", F.array_join("descriptive_labels", "|"))
            .withColumn("analytical_labels", F.array_join("analytical_labels", "|")))


@query("assign_quotes", f"""WITH {DOCS},
a AS (SELECT 'T' || (study_id % 8) AS theme_id, quote_id FROM quotes),
u AS (SELECT theme_id, quote_id FROM tq UNION SELECT theme_id, quote_id FROM a)
SELECT theme_id, count(*) AS n_quotes FROM u GROUP BY theme_id""")
def assign_quotes(spark, folder):
    ev = tables.documents_evidence(spark, folder)
    new = tables.document_quotes(spark, folder).select(
        F.concat(F.lit("T"), (F.col("study_id") % 8).cast("string")).alias("theme_id"), "quote_id", "study_id", "pos")
    quotes, _ = syn.assign_quotes(ev.theme_quotes, ev.theme_studies, new.unionByName(new))
    return quotes.groupBy("theme_id").agg(F.count("*").alias("n_quotes"))


@query("merge_themes", f"""WITH {CUSTOMERS},
m AS (SELECT theme_id AS old_id, 'M' || (ord % 4) AS new_id FROM th WHERE ord < 1000)
SELECT new_id AS theme_id, count(DISTINCT study_id) AS n_studies, CAST(min(study_id) AS BIGINT) AS first_study
FROM ts JOIN m ON ts.theme_id = m.old_id GROUP BY new_id""")
def merge_themes(spark, folder):
    ev = tables.customers_evidence(spark, folder)
    mapping = ev.themes.filter("ord < 1000").select(
        F.col("theme_id").alias("old_id"), F.concat(F.lit("M"), (F.col("ord") % 4).cast("string")).alias("new_id"), "ord")
    return syn.merge_links(ev.theme_studies, mapping, "study_id").groupBy("theme_id").agg(
        F.count("*").alias("n_studies"), F.min("study_id").cast(big).alias("first_study"))


@query("cerqual", """WITH w AS (SELECT doc_id, [0, 1, 2, 3, 0] AS v FROM documents),
c AS (SELECT doc_id, v[doc_id % 5 + 1] a, v[doc_id % 2 + 1] b, v[doc_id % 3 + 1] c, v[doc_id % 4 % 2 + 1] d FROM w)
SELECT doc_id AS finding_id, CASE WHEN greatest(a, b, c, d) >= 3 THEN 'Very Low' WHEN greatest(a, b, c, d) >= 2 THEN 'Low'
  WHEN a + b + c + d >= 3 THEN 'Low' WHEN a + b + c + d = 0 THEN 'High' ELSE 'Moderate' END AS confidence,
  CAST(doc_id % 3 AS BIGINT) AS n_studies FROM c""")
def cerqual(spark, folder):
    docs = tables.table(spark, folder, "documents").select("doc_id")
    level = ["no", "minor", "moderate", "serious", "unknown"]

    def pick(i):
        return F.element_at(F.array(*[F.lit(x) for x in level]), (i + 1).cast("int"))
    d = F.col("doc_id")
    findings = docs.select(
        F.col("doc_id").alias("finding_id"), F.lit("").alias("finding_text"), F.lit("").alias("explanation"),
        pick(d % 5).alias("methodological_limitations"), pick(d % 2).alias("coherence"),
        pick(d % 3).alias("adequacy"), pick(d % 4 % 2).alias("relevance"),
        F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (d % 3).cast("int")).alias("contributing_studies"))
    return syn.findings_table(syn.assess_findings(findings)).select("finding_id", "confidence", "n_studies")


CONCEPTS = ["tion", "que_les", "the_", "refut", "ing that", "zzz"]
_CELLS = f"""{DOCS},
c(concept) AS (VALUES {", ".join(f"('{c}')" for c in CONCEPTS)}),
cells AS (SELECT st.study_id, concept,
   CASE WHEN contains(lower(replace(text, chr(10), ' ')), replace(concept, '_', ' '))
     OR EXISTS (SELECT 1 FROM quotes q WHERE q.study_id = st.study_id AND contains(lower(q.text), replace(concept, '_', ' ')))
   THEN 'present' ELSE 'absent' END AS type FROM st, c)"""


@query("translation_matrix", f"WITH {_CELLS} SELECT study_id, concept, type FROM cells")
def translation_matrix(spark, folder):
    ev = tables.documents_evidence(spark, folder)
    return syn.translation_matrix(ev.studies, CONCEPTS, quotes=tables.document_quotes(spark, folder))


_STATS = f"""{_CELLS},
user_cells AS (SELECT study_id, concept, CASE WHEN type = 'present' AND study_id % 7 = 0 THEN 'refutational'
   WHEN type = 'absent' AND study_id % 5 = 0 THEN 'partial' ELSE type END AS type FROM cells),
s AS (SELECT concept, count(*) FILTER (type = 'present') p, count(*) FILTER (type = 'refutational') r FROM user_cells GROUP BY 1),
stats AS (SELECT concept, round(p / (SELECT count(*) FROM st)::DOUBLE, 3) AS coverage,
  CASE WHEN p > 0 THEN round((p - r) / p::DOUBLE, 3) ELSE 0.0::DOUBLE END AS consistency, p AS n_present, r AS n_refutational FROM s)"""


def _user_cells(spark, folder):
    t = F.col("type")
    return translation_matrix(spark, folder).withColumn(
        "type", F.when((t == "present") & (F.col("study_id") % 7 == 0), "refutational")
        .when((t == "absent") & (F.col("study_id") % 5 == 0), "partial").otherwise(t))


@query("translation_stats", f"WITH {_STATS} SELECT * FROM stats")
def translation_stats(spark, folder):
    return syn.concept_stats(_user_cells(spark, folder))


@query("translation_type", f"""WITH {_STATS},
o AS (SELECT coalesce(avg(consistency) FILTER (n_present > 0), 1.0) AS c, bool_or(n_refutational > 0) AS r FROM stats)
SELECT round(c, 3) AS overall_consistency, CASE WHEN c >= 0.8 AND NOT r THEN 'reciprocal' WHEN c < 0.5 THEN 'refutational'
  ELSE 'line_of_argument' END AS translation_type FROM o""")
def translation_type(spark, folder):
    return syn.matrix_verdict(syn.concept_stats(_user_cells(spark, folder)))


@query("certify", f"""WITH {ORDERS}, n AS (SELECT (SELECT count(*) FROM st) AS n_studies, (SELECT count(*) FROM th) AS n_themes, 0::BIGINT AS n_findings)
SELECT *, CASE WHEN n_studies < 2 THEN 'REJECT' WHEN n_themes = 0 AND n_findings = 0 THEN 'WARN' ELSE 'PASS' END AS certification FROM n""")
def certify(spark, folder):
    return syn.certify(tables.orders_evidence(spark, folder))


@query("input_fingerprint", f"""WITH {ORDERS}, b AS (SELECT ord // 10000 AS b, sha256('[' || string_agg('{{"id": "' || study_id || '", "n": '
  || (study_id % 50) || ', "year": ' || year || '}}', ', ' ORDER BY ord) || ']') AS d FROM st GROUP BY 1)
SELECT substr(CASE WHEN count(*) = 1 THEN min(d) ELSE sha256('[' || string_agg(d, ', ' ORDER BY b) || ']') END, 1, 16) AS input_hash FROM b""")
def input_fingerprint(spark, folder):
    ev = tables.orders_evidence(spark, folder)
    return syn.input_fingerprint(ev.studies.withColumn("sample_size", F.col("study_id") % 50))


# --- saturation ---------------------------------------------------------------

_H = "CASE WHEN sum(n) > 0 THEN log2(sum(n)) - sum(CASE WHEN n > 0 THEN n * log2(n) ELSE 0 END) / sum(n) ELSE 0 END"
_DIST = "d AS (SELECT th.theme_id, count(st.study_id)::DOUBLE AS n FROM th LEFT JOIN ts ON ts.theme_id = th.theme_id LEFT JOIN st ON st.study_id = ts.study_id GROUP BY 1)"


@query("theme_distribution", f"WITH {ORDERS}, {_DIST} SELECT theme_id, n::BIGINT AS n_studies FROM d")
def theme_distribution(spark, folder):
    return sat.theme_distribution(tables.orders_evidence(spark, folder)).select("theme_id", "n_studies")


@query("diversity", f"""WITH {ORDERS}, {_DIST} SELECT sum(n)::BIGINT AS total, {R(_H)} AS entropy,
  {R(_H + " / log2(count(*))")} AS normalised_entropy,{R("1 - sum(n * n) / (sum(n) * sum(n))")} AS gini FROM d""")
def diversity(spark, folder):
    out = sat.diversity(sat.theme_distribution(tables.orders_evidence(spark, folder)))
    return out.select("total", *[r6(c).alias(c) for c in ("entropy", "normalised_entropy", "gini")])


_CURVE = """
inc AS (SELECT ts.theme_id, st.study_id, st.ord, row_number() OVER (PARTITION BY theme_id ORDER BY st.ord) AS c
        FROM ts JOIN st ON st.study_id = ts.study_id),
step AS (SELECT study_id, count(*) AS t, sum(c * log2(c) - CASE WHEN c > 1 THEN (c - 1) * log2(c - 1) ELSE 0 END) AS s
         FROM inc GROUP BY study_id),
run AS (SELECT st.study_id, row_number() OVER (ORDER BY ord) - 1 AS idx, sum(coalesce(t, 0)) OVER (ORDER BY ord)::DOUBLE AS t,
          sum(coalesce(s, 0)) OVER (ORDER BY ord) AS s FROM st LEFT JOIN step ON step.study_id = st.study_id),
h AS (SELECT study_id, idx, CASE WHEN t > 0 THEN log2(t) - s / t ELSE 0 END AS h FROM run),
curve AS (SELECT study_id, idx, h AS entropy, h / log2((SELECT count(*) FROM th)) AS normalised_entropy,
            h - coalesce(lag(h) OVER (ORDER BY idx), 0) AS info_gain FROM h)"""


@query("entropy_curve", f"""WITH {ORDERS}, {_CURVE} SELECT study_id, idx, {R("entropy")} AS entropy,
  {R("normalised_entropy")} AS normalised_entropy, {R("info_gain")} AS info_gain FROM curve""")
def entropy_curve(spark, folder):
    out = sat.saturation_curve(tables.orders_evidence(spark, folder))
    return out.select("study_id", "idx", *[r6(c).alias(c) for c in ("entropy", "normalised_entropy", "info_gain")])


@query("saturation_index", f"""WITH {CUSTOMERS}, {_CURVE}
SELECT min(idx) AS saturation_index FROM curve WHERE idx >= 1 AND abs(info_gain) < 0.05""")
def saturation_index(spark, folder):
    return sat.saturation_index(sat.saturation_curve(tables.customers_evidence(spark, folder)))


@query("mutual_information", f"""WITH {ORDERS}, {_DIST},
k AS (SELECT count(*)::DOUBLE AS n FROM ts JOIN st ON st.study_id = ts.study_id GROUP BY ts.study_id)
SELECT {R(f"(SELECT {_H} FROM d) - sum(n * log2(n)) / sum(n)")} AS mutual_information FROM k""")
def mutual_information(spark, folder):
    out = sat.mutual_information(tables.orders_evidence(spark, folder))
    return out.select(r6("mutual_information").alias("mutual_information"))


# --- richness: themes are the (source, day of order) style rare codes ---------

_RARE = """
st AS (SELECT o_orderkey AS study_id FROM orders),
ab AS (SELECT n AS abundance, count(*) AS f FROM (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem JOIN orders ON
  o_orderkey = l_orderkey GROUP BY l_partkey, l_linenumber) GROUP BY n),
b AS (SELECT sum(f)::DOUBLE s, coalesce(sum(f) FILTER (abundance = 1), 0)::DOUBLE f1,
  coalesce(sum(f) FILTER (abundance = 2), 0)::DOUBLE f2, sum(abundance * f)::DOUBLE n FROM ab),
v AS (SELECT *, f1 * f1 / (2 * f2) AS d, f1 * f1 / (2 * f2) * (1 + f1 * f1 / (4 * f2 * f2)) AS var FROM b),
e AS (SELECT *, exp(1.96 * sqrt(ln(1 + var / (d * d)))) AS c FROM v)"""


def _rare_themes(spark, folder):
    """Part x line number as a long tail of themes with few orders each."""
    ev = tables.orders_evidence(spark, folder)
    lines = tables.table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_partkey", "l_linenumber").alias("theme_id"), F.col("l_orderkey").alias("study_id"),
        F.col("l_orderkey").alias("pos"))
    return tables.Evidence(ev.studies.select("study_id", "ord"), lines.select("theme_id").distinct(), lines)


@query("chao1", f"""WITH {_RARE} SELECT s::BIGINT AS observed, f1::BIGINT AS singletons, f2::BIGINT AS doubletons,
  {R("s + d")} AS chao1, {R("s + d / c")} AS ci_low, {R("s + d * c")} AS ci_high, {R("d")} AS unseen FROM e""")
def chao1(spark, folder):
    return sat.richness(_rare_themes(spark, folder)).select(
        "observed", "singletons", "doubletons",
        *[r6(c).alias(c) for c in ("chao1", "ci_low", "ci_high", "unseen")])


@query("good_turing", f"""WITH {_RARE} SELECT n::BIGINT AS assignments, {R("f1 / n")} AS p_new, {R("1 - f1 / n")} AS coverage FROM e""")
def good_turing(spark, folder):
    return sat.richness(_rare_themes(spark, folder)).select(
        "assignments", r6("p_new").alias("p_new"), r6("coverage").alias("coverage"))


@query("abundances", f"WITH {_RARE} SELECT abundance, f FROM ab")
def abundances(spark, folder):
    return sat.abundances(_rare_themes(spark, folder))


_LC = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


@query("rarefaction", f"""WITH {EVENTS}, a AS (SELECT count(*)::DOUBLE AS n FROM ts GROUP BY theme_id),
m AS (SELECT unnest(range(1, (SELECT count(*) FROM st) + 1)) AS m), t AS (SELECT count(*)::DOUBLE AS t FROM st)
SELECT m, {R("sum(1 - CASE WHEN t - n >= m THEN exp(" + _LC.format(n="(t - n)", k="m") + " - "
             + _LC.format(n="t", k="m") + ") ELSE 0 END)")} AS expected_themes FROM m, a, t GROUP BY m""")
def rarefaction(spark, folder):
    return sat.rarefaction_curve(tables.events_evidence(spark, folder)).select(
        "m", r6("expected_themes").alias("expected_themes"))


@query("extrapolation", f"""WITH {_RARE}, g AS (SELECT s, f1, CASE WHEN f1 > 1 THEN f1 * (f1 - 1) / 2 ELSE f1 END AS d FROM b),
m AS (SELECT unnest(range(n + 1, greatest(2 * n, n + 5) + 1)) AS m, n FROM (SELECT count(*) AS n FROM st))
SELECT m, {R("CASE WHEN d <= 0 OR f1 <= 0 THEN s ELSE s + d - d * exp(-f1 * (m - n) / d) END")} AS expected_themes FROM m, g""")
def extrapolation(spark, folder):
    return sat.extrapolation_curve(_rare_themes(spark, folder)).select(
        "m", r6("expected_themes").alias("expected_themes"))


@query("reflexivity", f"""WITH {_CELLS},
n AS (SELECT th.theme_id, (SELECT count(*) FROM ts WHERE ts.theme_id = th.theme_id) AS s,
  (SELECT count(*) FROM tq WHERE tq.theme_id = th.theme_id) AS q, level,
  len(list_filter(concepts, lambda c: contains(lower(c), 'refut'))) > 0 AS r FROM th),
i AS (SELECT avg((s > (SELECT count(*) FROM st) / 2.0)::INT) AS theme_saturation, least(avg(q) / 5, 1.0) AS quote_density,
  (SELECT count(DISTINCT study_id) FROM ts) / (SELECT count(*) FROM st)::DOUBLE AS study_coverage,
  (SELECT avg((type <> 'absent')::INT) FROM cells) AS translation_completeness, avg(r::INT) AS disconfirming_evidence,
  avg((level = 'analytical')::INT) AS analytical_depth FROM n),
l AS (UNPIVOT i ON COLUMNS(*) INTO NAME indicator VALUE score), o AS (SELECT avg(score) AS overall FROM l)
SELECT indicator, {R("score")} AS score, {R("overall")} AS overall,
  CASE WHEN overall >= 0.7 THEN 'Green' WHEN overall >= 0.4 THEN 'Amber' ELSE 'Red' END AS rating,
  (score < 0.5)::INT AS advised FROM l, o""")
def reflexivity(spark, folder):
    ev = tables.documents_evidence(spark, folder)
    out = sat.reflexivity(ev, translation_matrix(spark, folder))
    return out.select("indicator", r6("score").alias("score"), r6("overall").alias("overall"), "rating",
                      F.col("advice").isNotNull().cast("int").alias("advised"))
