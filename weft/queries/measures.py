"""Queries over graded membership, retrieval metrics, conceptual depth and time."""

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import depth, fuzzy, retrieval, temporal
from ..plans.lineage import cut
from ..sources import tables
from .language import _RANK, _clean
from .registry import query
from .views import CUSTOMERS, DOCS, ORDERS, quoted, tokens
from .views import r6 as R


def rounded(df, *names):
    return df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])


# --- fuzzy membership ---------------------------------------------------------

_MU = f"""{DOCS},
nq AS (SELECT study_id, count(DISTINCT quote_id) AS n FROM quotes GROUP BY 1),
ov AS (SELECT study_id, theme_id, count(*) AS n FROM quotes JOIN tq ON tq.quote_id = quotes.quote_id GROUP BY 1, 2),
sw AS (SELECT study_id, list_distinct({tokens("text")}) AS t FROM st),
tw AS (SELECT theme_id, list_distinct({tokens("label || ' ' || array_to_string(concepts, ' ')")}) AS t FROM th),
jc AS (SELECT study_id, theme_id, len(list_intersect(sw.t, tw.t)) AS n, len(sw.t) + len(tw.t) AS s FROM sw, tw),
cell AS (SELECT jc.study_id, jc.theme_id, CASE WHEN nq.n IS NOT NULL AND jc.theme_id IN (SELECT theme_id FROM tq)
   THEN coalesce(ov.n, 0) / nq.n::DOUBLE WHEN jc.s > jc.n THEN jc.n / (jc.s - jc.n)::DOUBLE ELSE 0 END AS m,
   ts.study_id IS NOT NULL AS a FROM jc LEFT JOIN nq ON nq.study_id = jc.study_id
   LEFT JOIN ov ON ov.study_id = jc.study_id AND ov.theme_id = jc.theme_id
   LEFT JOIN ts ON ts.study_id = jc.study_id AND ts.theme_id = jc.theme_id),
mu AS (SELECT study_id, theme_id, a, CASE WHEN a THEN greatest(m, 0.5) ELSE m END AS mu FROM cell)"""


def _membership(spark, folder):
    ev = tables.documents_evidence(spark, folder)
    mu = fuzzy.membership(ev, tables.document_quotes(spark, folder), tables.document_texts(spark, folder))
    return ev, mu


@query("fuzzy_membership", f"WITH {_MU} SELECT study_id, theme_id, {R('mu')} AS mu FROM mu WHERE mu > 0")
def fuzzy_membership(spark, folder):
    return rounded(_membership(spark, folder)[1], "mu")


@query("fuzzy_measures", f"""WITH {_MU}, e AS (SELECT theme_id, sum(mu) AS cardinality, count(*) FILTER (mu > 0.5) AS core, count(*) FILTER (mu > 0) AS support,
 count(*) FILTER (mu >= 0.3) AS alpha_cut, least(1, greatest(0, -sum(CASE WHEN mu > 0 AND mu < 1 THEN mu * ln(mu) + (1 - mu) * ln(1 - mu) ELSE 0 END) / (count(*) * ln(2)))) AS entropy FROM mu GROUP BY 1)
SELECT theme_id, {R('cardinality')} AS cardinality, core, support, alpha_cut, {R('entropy')} AS entropy, {R('1 - entropy')} AS sharpness FROM e""")
def fuzzy_measures(spark, folder):
    return rounded(fuzzy.theme_measures(*_membership(spark, folder)), "cardinality", "entropy", "sharpness")


@query("fuzzy_similarity", f"""WITH {_MU} SELECT x.theme_id AS a, y.theme_id AS b, {R('sum(least(x.mu, y.mu)) / sum(greatest(x.mu, y.mu))')} AS jaccard,
 {R('sum(x.mu * y.mu) / (sqrt(sum(x.mu * x.mu)) * sqrt(sum(y.mu * y.mu)))')} AS cosine FROM mu x JOIN mu y ON x.study_id = y.study_id AND x.theme_id < y.theme_id GROUP BY 1, 2""")
def fuzzy_similarity(spark, folder):
    ev, mu = _membership(spark, folder)
    return rounded(fuzzy.fuzzy_similarity(ev, cut(mu)), "jaccard", "cosine")


@query("dominant_theme", f"""WITH {_MU} SELECT study_id, theme_id FROM (SELECT study_id, mu.theme_id, row_number() OVER (PARTITION BY study_id ORDER BY mu DESC, ord) AS rn
 FROM mu JOIN th ON th.theme_id = mu.theme_id) WHERE rn = 1""")
def dominant_theme(spark, folder):
    return fuzzy.dominant_themes(*_membership(spark, folder))


@query("alpha_cut", f"WITH {_MU} SELECT theme_id, study_id FROM mu WHERE mu >= 0.3")
def alpha_cut(spark, folder):
    return fuzzy.members(_membership(spark, folder)[1], 0.3)


# --- retrieval ----------------------------------------------------------------

_W = "CASE quality WHEN 'high' THEN 1.0::DOUBLE WHEN 'moderate' THEN 0.7 WHEN 'low' THEN 0.4 ELSE 0.5 END"
_PR = f"""{ORDERS}, p AS (SELECT th.theme_id, coalesce(avg({_W}) FILTER (st.study_id IS NOT NULL), 0) AS p,
 least(count(ts.study_id) / (SELECT count(*) FROM st)::DOUBLE, 1) AS r FROM th LEFT JOIN ts ON ts.theme_id = th.theme_id LEFT JOIN st ON st.study_id = ts.study_id GROUP BY 1)"""


@query("ir_precision_recall_f1", f"WITH {_PR} SELECT theme_id, {R('p')} AS precision, {R('r')} AS recall, {R('2 * p * r / (p + r)')} AS f1 FROM p")
def ir_precision_recall_f1(spark, folder):
    return rounded(retrieval.precision_recall(tables.orders_evidence(spark, folder)), "precision", "recall", "f1")


@query("map_score", f"WITH {_PR} SELECT {R('avg(p)')} AS map_score FROM p")
def map_score(spark, folder):
    return rounded(retrieval.mean_precision(retrieval.precision_recall(tables.orders_evidence(spark, folder))), "map_score")


_NDCG = """r AS (SELECT theme_id, w, row_number() OVER (PARTITION BY theme_id ORDER BY mu DESC, study_id) AS r,
  row_number() OVER (PARTITION BY theme_id ORDER BY w DESC, study_id) AS i FROM a)
SELECT theme_id, (round(sum(w / log2(r + 1)) / sum(w / log2(i + 1)), 6) + 0.0::DOUBLE) AS ndcg FROM r GROUP BY 1"""


@query("ndcg", f"WITH {ORDERS}, a AS (SELECT theme_id, ts.study_id, {_W} AS w, 1.0 AS mu FROM ts JOIN st ON st.study_id = ts.study_id), {_NDCG}")
def ndcg(spark, folder):
    return rounded(retrieval.ndcg(tables.orders_evidence(spark, folder)), "ndcg")


@query("ndcg_by_membership", f"WITH {_MU}, a AS (SELECT theme_id, mu.study_id, {_W} AS w, mu FROM mu JOIN st ON st.study_id = mu.study_id WHERE a), {_NDCG}")
def ndcg_by_membership(spark, folder):
    ev, mu = _membership(spark, folder)
    return rounded(retrieval.ndcg(ev, cut(mu)), "ndcg")


@query("auc", f"""WITH {_MU}, r AS (SELECT theme_id, a, rank() OVER (PARTITION BY theme_id ORDER BY mu) + (count(*) OVER (PARTITION BY theme_id, mu) - 1) / 2.0::DOUBLE AS r FROM mu),
s AS (SELECT theme_id, sum(r) FILTER (a) AS r1, count(*) FILTER (a) AS p, count(*) FILTER (NOT a) AS q FROM r GROUP BY 1)
SELECT theme_id, {R('(r1 - p * (p + 1) / 2.0::DOUBLE) / (p * q)')} AS auc FROM s""")
def auc(spark, folder):
    ev, mu = _membership(spark, folder)
    return rounded(retrieval.auc(ev, cut(mu)), "auc")


# --- depth --------------------------------------------------------------------

_CASES = f"""CASE
 WHEN list_has_any(w, [{quoted(depth.ABSTRACTION_WORDS[4])}]) THEN 4 WHEN list_has_any(w, [{quoted(depth.ABSTRACTION_WORDS[3])}]) THEN 3
 WHEN list_has_any(w, [{quoted(depth.ABSTRACTION_WORDS[2])}]) THEN 2 WHEN list_has_any(w, [{quoted(depth.ABSTRACTION_WORDS[1])}]) THEN 1
 WHEN level = 'analytical' THEN 3 WHEN level = 'interpretive' THEN 2 ELSE 1 END"""
_LEVELS = f"""{DOCS}, lv AS (SELECT theme_id, {_CASES} AS abstraction FROM (SELECT theme_id, level, {_clean("label")} AS w FROM th)),
sl AS (SELECT st.study_id, any_value(year) AS year, any_value(ord) AS ord, round(coalesce(avg(abstraction), 1.0), 12) AS v FROM st
  LEFT JOIN ts ON ts.study_id = st.study_id LEFT JOIN lv ON lv.theme_id = ts.theme_id GROUP BY 1)"""
NEGATIONS = ["no", "not", "lest", "der"]
_DEPTH = f"""{_LEVELS},
up(theme_id, tip, d) AS (SELECT theme_id, parent_id, 0 FROM th UNION ALL SELECT up.theme_id, th.parent_id, d + 1 FROM up JOIN th ON th.theme_id = up.tip),
hd AS (SELECT theme_id, max(d) AS depth FROM up GROUP BY 1),
cd AS (SELECT avg(coalesce(c, 0) / greatest(len(string_split(text, chr(10))), 1)::DOUBLE) AS v FROM st LEFT JOIN
  (SELECT study_id, count(DISTINCT quote_id) AS c FROM quotes WHERE quote_id IN (SELECT quote_id FROM tq) GROUP BY 1) x ON x.study_id = st.study_id),
cr AS (SELECT avg(n) / (SELECT count(*) FROM st) AS v FROM (SELECT concept, count(DISTINCT study_id) AS n FROM
  (SELECT theme_id, unnest(concepts) AS concept FROM th) c LEFT JOIN ts ON ts.theme_id = c.theme_id GROUP BY 1)),
dlw AS (SELECT DISTINCT theme_id, w FROM (SELECT theme_id, unnest({_clean("label")}) AS w FROM th) WHERE length(w) > 2),
neg AS (SELECT study_id, lower(text) AS l FROM lines WHERE list_has_any({_clean("text")}, [{quoted(NEGATIONS)}])),
rt AS (SELECT DISTINCT theme_id FROM (SELECT DISTINCT study_id, theme_id FROM neg JOIN dlw ON contains(l, w)) h
  WHERE NOT EXISTS (SELECT 1 FROM ts WHERE ts.study_id = h.study_id AND ts.theme_id = h.theme_id)),
comp AS (SELECT (SELECT avg(abstraction) FROM lv) AS ma, (SELECT avg((abstraction >= 3)::INT) FROM lv) AS tr, (SELECT max(depth) FROM hd) AS hd,
  (SELECT v FROM cd) AS cd, (SELECT v FROM cr) AS cr, (SELECT count(*) FROM rt) / (SELECT count(*) FROM th)::DOUBLE AS ri)"""


def _findings(ev):
    return ev.studies.select("study_id", F.explode("findings").alias("text"))


_SAID = [w for level in sorted(depth.ABSTRACTION_WORDS) for w in sorted(depth.ABSTRACTION_WORDS[level])] + ["support", "people"]
_EVENT_THEMES = f"""th AS (SELECT DISTINCT event_type || '-' || user_id || '-' || k AS theme_id, event_type || ' ' || [{quoted(_SAID)}][k % {len(_SAID)} + 1] AS label,
  CASE user_id % 3 WHEN 0 THEN 'analytical' WHEN 1 THEN 'interpretive' ELSE 'descriptive' END AS level
 FROM (SELECT event_type, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
lv AS (SELECT theme_id, {_CASES} AS abstraction FROM (SELECT theme_id, level, {_clean("label")} AS w FROM th))"""


def _event_themes(spark, folder):
    """A theme for each kind of event, user and payload, labelled by a word that the payload picks."""
    k = F.get_json_object("props", "$.k").cast("int")
    word = F.element_at(F.array(*[F.lit(w) for w in _SAID]), k % len(_SAID) + 1)
    level = F.when(F.col("user_id") % 3 == 0, "analytical").when(F.col("user_id") % 3 == 1, "interpretive").otherwise("descriptive")
    return tables.table(spark, folder, "events").select(
        F.concat_ws("-", "event_type", "user_id", k).alias("theme_id"), F.concat_ws(" ", "event_type", word).alias("label"),
        level.alias("level")).distinct()


@query("abstraction_levels", f"WITH {_EVENT_THEMES} SELECT * FROM lv")
def abstraction_levels(spark, folder):
    return depth.abstraction_levels(_event_themes(spark, folder))


@query("level_stats", f"""WITH {_EVENT_THEMES} SELECT count(*) FILTER (abstraction = 1) AS level_1, count(*) FILTER (abstraction = 2) AS level_2,
 count(*) FILTER (abstraction = 3) AS level_3, count(*) FILTER (abstraction = 4) AS level_4, {R('avg(abstraction)')} AS mean_abstraction,
 {R('avg((abstraction >= 3)::INT)')} AS theoretical_reach FROM lv""")
def level_stats(spark, folder):
    """Counts per level, mean level and theoretical reach over the event themes."""
    return rounded(depth.level_stats(depth.abstraction_levels(_event_themes(spark, folder))), "mean_abstraction", "theoretical_reach")


@query("hierarchy_depth", f"""WITH RECURSIVE {CUSTOMERS}, up(theme_id, tip, d) AS (SELECT theme_id, parent_id, 0 FROM th
 UNION ALL SELECT up.theme_id, th.parent_id, d + 1 FROM up JOIN th ON th.theme_id = up.tip) SELECT theme_id, max(d) AS depth FROM up GROUP BY 1""")
def hierarchy_depth(spark, folder):
    return depth.hierarchy_depths(tables.customers_evidence(spark, folder).themes)


@query("refuted_themes", f"WITH RECURSIVE {_DEPTH} SELECT theme_id FROM rt")
def refuted_themes(spark, folder):
    ev = tables.documents_evidence(spark, folder)
    return depth.refuted_themes(ev, _findings(ev), NEGATIONS)


@query("depth_index", f"""WITH RECURSIVE {_DEPTH} SELECT {R('ma')} AS mean_abstraction, {R('tr')} AS theoretical_reach, hd AS hierarchy_depth, {R('cd')} AS coding_density,
 {R('cr')} AS concept_recurrence, {R('ri')} AS refutational_integration,
 {R('0.3 * ma / 4 + 0.2 * least(hd / 4.0, 1) + 0.2 * least(cd, 1) + 0.15 * least(cr, 1) + 0.15 * least(ri, 1)')} AS depth_index FROM comp""")
def depth_index(spark, folder):
    ev = tables.documents_evidence(spark, folder)
    out = depth.depth_index(ev, tables.document_quotes(spark, folder), _findings(ev), NEGATIONS)
    return rounded(out, *[c for c in out.columns if c != "hierarchy_depth"])


@query("development_correlation", f"""WITH {_LEVELS}, r AS (SELECT row_number() OVER (ORDER BY year, ord) AS rx, {_RANK.format(x="v")} AS ry FROM sl)
SELECT {R('covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry))')} AS correlation FROM r""")
def development_correlation(spark, folder):
    ev = tables.documents_evidence(spark, folder)
    return rounded(depth.development_correlation(ev, depth.abstraction_levels(ev.themes)), "correlation")


# --- time ---------------------------------------------------------------------

_Y = f"{ORDERS}, y AS (SELECT theme_id, year, count(*) AS n FROM ts JOIN st ON st.study_id = ts.study_id GROUP BY 1, 2)"


@query("emergence", f"WITH {_Y} SELECT th.theme_id, min(year) AS year FROM th LEFT JOIN y ON y.theme_id = th.theme_id GROUP BY 1")
def emergence(spark, folder):
    return temporal.emergence(tables.orders_evidence(spark, folder))


@query("growth_curve", f"""WITH {_Y}, g AS (SELECT theme_id, unnest(range(min(year), max(year) + 1)) AS year FROM y GROUP BY 1)
SELECT g.theme_id, g.year, sum(coalesce(n, 0)) OVER (PARTITION BY g.theme_id ORDER BY g.year)::BIGINT AS cumulative FROM g LEFT JOIN y ON y.theme_id = g.theme_id AND y.year = g.year""")
def growth_curve(spark, folder):
    return temporal.growth_curves(tables.orders_evidence(spark, folder))


_TD = f"{_Y}, d AS (SELECT year, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM y GROUP BY 1)"


@query("temporal_diversity", f"WITH {_TD} SELECT year, {R('entropy')} AS entropy FROM d")
def temporal_diversity(spark, folder):
    return rounded(temporal.temporal_diversity(tables.orders_evidence(spark, folder)), "entropy")


@query("innovation_rate", f"""WITH {CUSTOMERS}, b AS (SELECT theme_id, min(year) AS year FROM ts JOIN st ON st.study_id = ts.study_id GROUP BY 1),
yy AS (SELECT DISTINCT year FROM st) SELECT yy.year, {R('count(theme_id) / (SELECT count(*) FROM th)::DOUBLE')} AS rate FROM yy LEFT JOIN b ON b.year = yy.year GROUP BY 1""")
def innovation_rate(spark, folder):
    return rounded(temporal.innovation_rate(tables.customers_evidence(spark, folder)), "rate")


@query("paradigm_shifts", f"""WITH {_TD}, l AS (SELECT year, entropy, lag(entropy) OVER (ORDER BY year) AS before FROM d)
SELECT year FROM l WHERE before > 0 AND (before - entropy) / before > 0.0001""")
def paradigm_shifts(spark, folder):
    return temporal.paradigm_shifts(temporal.temporal_diversity(tables.orders_evidence(spark, folder)), 0.0001)


@query("influence_degree", f"""WITH {ORDERS}, i AS (SELECT theme_id, ts.study_id, year FROM ts JOIN st ON st.study_id = ts.study_id),
p AS (SELECT DISTINCT a.study_id, b.study_id AS t FROM i a JOIN i b ON a.theme_id = b.theme_id AND a.year < b.year)
SELECT st.study_id, count(t) AS degree FROM st LEFT JOIN p ON p.study_id = st.study_id GROUP BY 1""")
def influence_degree(spark, folder):
    return temporal.influence_degree(tables.orders_evidence(spark, folder))


@query("co_evolution", f"""WITH {_Y}, yy AS (SELECT DISTINCT year FROM st), c AS (SELECT th.theme_id, ord, yy.year, coalesce(sum(n), 0) AS c FROM th JOIN yy ON true
 LEFT JOIN y ON y.theme_id = th.theme_id AND y.year <= yy.year GROUP BY 1, 2, 3)
SELECT a.theme_id AS a, b.theme_id AS b, {R('corr(a.c, b.c)')} AS correlation FROM c a JOIN c b ON a.year = b.year AND a.ord < b.ord GROUP BY 1, 2""")
def co_evolution(spark, folder):
    return rounded(temporal.co_evolution(tables.orders_evidence(spark, folder)), "correlation")
