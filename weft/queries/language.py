"""Queries over sentences: sentiment, arguments, causal claims. The word lists are
frequent words of the corpus, since the default English lists hardly occur in it."""

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import argument, causal, sentiment
from ..plans.lineage import cut
from ..sources import tables
from .registry import query
from .views import DOCS, quoted, raw_tokens
from .views import r6 as R

LEXICON = sentiment.SentimentLexicon(
    positive=["tion", "er", "que", "ther", "erin", "elle"], negative=["st", "re", "les", "thon", "ly", "der"],
    intensifiers=["the", "de", "ou"], negators=["no", "la", "of", "ne", "in"])
EMOTIONS = {"joy": ["tion", "ble"], "sadness": ["que"], "fear": ["der", "die"], "anger": ["zzz"]}
_L = LEXICON

_SENT = f"""{DOCS},
sl AS (SELECT study_id, part, list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
   lambda s: length(trim(s)) > 0) AS s FROM parts),
sent AS (SELECT study_id, part, unnest(s) AS text, unnest(range(len(s))) AS sent FROM sl)"""
_SCORE = f"""{_SENT},
tk AS (SELECT study_id, part, sent, {raw_tokens("text")} AS t FROM sent),
w AS (SELECT study_id, part, sent, unnest(t) AS w, unnest(range(len(t))) AS p FROM tk),
k AS (SELECT *, CASE WHEN w IN ({quoted(_L.negators)}) THEN 4 WHEN w IN ({quoted(_L.intensifiers)}) THEN 3
   WHEN w IN ({quoted(_L.positive)}) THEN 1 WHEN w IN ({quoted(_L.negative)}) THEN 2 ELSE 0 END AS kind FROM w),
g AS (SELECT *, sum((kind = 4)::INT) OVER x AS grp, lead(kind) OVER x AS nxt,
   max((kind = 4)::INT) OVER (PARTITION BY study_id, part, sent ORDER BY p ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS near
   FROM k WINDOW x AS (PARTITION BY study_id, part, sent ORDER BY p)),
n AS (SELECT *, grp > 0 AND sum((kind < 3)::INT) OVER (PARTITION BY study_id, part, sent, grp ORDER BY p) <= 3 AS neg FROM g),
sc AS (SELECT study_id, part, sent, sum(CASE WHEN kind IN (1, 2) THEN (CASE kind WHEN 1 THEN 1 ELSE -1 END) * (CASE WHEN neg THEN -1 ELSE 1 END) ELSE 0 END
   + CASE WHEN kind = 3 AND nxt IN (1, 2) THEN 0.5::DOUBLE * (CASE nxt WHEN 1 THEN 1 ELSE -1 END) * (CASE WHEN near = 1 THEN -1 ELSE 1 END) ELSE 0 END)
   / nullif(count(*) FILTER (kind IN (1, 2)), 0)::DOUBLE AS s FROM n GROUP BY 1, 2, 3),
ss AS (SELECT sent.study_id, sent.part, sent.sent, coalesce(s, 0)::DOUBLE AS sentiment FROM sent LEFT JOIN sc
   ON sc.study_id = sent.study_id AND sc.part = sent.part AND sc.sent = sent.sent),
sts AS (SELECT st.study_id, any_value(year) AS year, coalesce(avg(sentiment), 0) AS sentiment FROM st LEFT JOIN ss ON ss.study_id = st.study_id GROUP BY 1),
tse AS (SELECT th.theme_id, coalesce(avg(sentiment), 0) AS sentiment, count(sts.study_id) AS n FROM th LEFT JOIN ts ON ts.theme_id = th.theme_id LEFT JOIN sts ON sts.study_id = ts.study_id GROUP BY 1)"""


def _per_study(spark, folder):
    ev = tables.documents_evidence(spark, folder)
    return ev, sentiment.study_sentiment(ev.studies, tables.document_parts(spark, folder), LEXICON)


@query("sentence_sentiment", f"WITH {_SCORE} SELECT study_id, part, sent, {R('sentiment')} AS sentiment FROM ss")
def sentence_sentiment(spark, folder):
    return sentiment.sentence_sentiment(tables.document_parts(spark, folder), LEXICON).withColumn("sentiment", r6("sentiment"))


@query("study_sentiment", f"WITH {_SCORE} SELECT study_id, {R('sentiment')} AS sentiment FROM sts")
def study_sentiment(spark, folder):
    return _per_study(spark, folder)[1].withColumn("sentiment", r6("sentiment"))


@query("theme_sentiment", f"WITH {_SCORE} SELECT theme_id, {R('sentiment')} AS sentiment FROM tse")
def theme_sentiment(spark, folder):
    return sentiment.theme_sentiment(*_per_study(spark, folder)).withColumn("sentiment", r6("sentiment"))


@query("overall_sentiment", f"WITH {_SCORE} SELECT {R('avg(sentiment)')} AS sentiment FROM sts")
def overall_sentiment(spark, folder):
    return sentiment.overall_sentiment(_per_study(spark, folder)[1]).withColumn("sentiment", r6("sentiment"))


@query("sentiment_trajectory", f"WITH {_SCORE} SELECT year, {R('avg(sentiment)')} AS sentiment FROM sts GROUP BY year")
def sentiment_trajectory(spark, folder):
    ev, per_study = _per_study(spark, folder)
    return sentiment.trajectory(ev.studies, per_study).withColumn("sentiment", r6("sentiment"))


@query("emotion_profile", f"WITH {_SENT}, t AS (SELECT {raw_tokens('text')} AS t FROM sent) " + " UNION ALL ".join(
    f"SELECT '{e}' AS emotion, count(*) FILTER (list_has_any(t, [{quoted(k)}])) AS n_sentences FROM t" for e, k in EMOTIONS.items()))
def emotion_profile(spark, folder):
    return sentiment.emotion_profile(tables.document_parts(spark, folder), EMOTIONS)


_RANK = "rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE"


@query("sentiment_saturation_correlation", f"""WITH {_SCORE}, v AS (SELECT round(sentiment, 12) AS x, n AS y FROM tse),
r AS (SELECT {_RANK.format(x="x")} AS rx, {_RANK.format(x="y")} AS ry FROM v)
SELECT {R("covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry))")} AS correlation FROM r""")
def sentiment_saturation_correlation(spark, folder):
    ev, per_study = _per_study(spark, folder)
    per_theme = cut(sentiment.theme_sentiment(ev, per_study))
    return sentiment.sentiment_saturation_correlation(ev, per_theme).withColumn("correlation", r6("correlation"))


# --- arguments ----------------------------------------------------------------

ARGUMENTS = argument.ArgumentLexicon(
    claim=(["the", "les", "que", "den"], ["tion th", "la "]), evidence=(["of", "de", "er", "und"], ["the th", "ing "]),
    reasoning=(["and", "to", "des", "st"], ["is the", "en de"]), negations=["no", "in", "on", "la", "der"])
_A = ARGUMENTS
_STRIP = """regexp_replace({w}, '^[.,;:!?"''()\\-]+|[.,;:!?"''()\\-]+$', '', 'g')"""


def _clean(text):
    return (f"list_transform(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda z: length(z) > 0), "
            f"lambda z: {_STRIP.format(w='z')})")


def _count(kind):
    words, phrases = kind
    return (f"len(list_filter(w, lambda z: z IN ({quoted(words)})))"
            + "".join(f" + contains(l, '{p}')::INT" for p in phrases))


_UNITS = f"""{DOCS},
asl AS (SELECT study_id, part, list_filter(list_transform(string_split(regexp_replace(text, '([.?!]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)),
   lambda s: length(s) > 0) AS s FROM parts),
ase AS (SELECT study_id, part, unnest(s) AS text, unnest(range(len(s))) AS i FROM asl),
aw AS (SELECT *, lower(text) AS l, {_clean("text")} AS w FROM ase),
ac AS (SELECT study_id, part, i, text, {_count(_A.claim)} AS c, {_count(_A.evidence)} AS e, {_count(_A.reasoning)} AS r FROM aw),
atp AS (SELECT study_id, part, i, text, CASE WHEN c >= e AND c >= r THEN 'claim' WHEN e >= r THEN 'evidence' ELSE 'reasoning' END AS type FROM ac),
al AS (SELECT *, (type IS DISTINCT FROM lag(type) OVER (PARTITION BY study_id, part ORDER BY i))::INT AS new FROM atp),
ag AS (SELECT *, sum(new) OVER (PARTITION BY study_id, part ORDER BY i) - 1 AS unit FROM al),
u AS (SELECT study_id, part, unit::INT AS unit, any_value(type) AS type, string_agg(text, ' ' ORDER BY i) AS text FROM ag GROUP BY 1, 2, 3)"""
_MENTION = f"""{_UNITS},
lw AS (SELECT DISTINCT theme_id, w AS word FROM (SELECT theme_id, unnest({_clean("label")}) AS w FROM th) WHERE length(w) > 2),
kw AS (SELECT * FROM lw UNION SELECT theme_id, lower(unnest(concepts)) FROM th),
men AS (SELECT DISTINCT study_id, part, unit, type, theme_id FROM u JOIN kw ON contains(lower(text), word)),
ut AS (SELECT * FROM men UNION SELECT u.study_id, part, unit, type, theme_id FROM u JOIN ts ON ts.study_id = u.study_id)"""


def _units(spark, folder):
    return argument.argument_units(tables.document_parts(spark, folder), ARGUMENTS)


@query("argument_units", f"WITH {_UNITS} SELECT * FROM u")
def argument_units(spark, folder):
    return _units(spark, folder)


@query("argument_totals", f"WITH {_UNITS} SELECT type, count(*) AS n FROM u GROUP BY type")
def argument_totals(spark, folder):
    return _units(spark, folder).groupBy("type").agg(F.count("*").alias("n"))


@query("unit_themes", f"WITH {_MENTION} SELECT * FROM ut")
def unit_themes(spark, folder):
    return argument.unit_themes(tables.documents_evidence(spark, folder), _units(spark, folder))


@query("argument_strength", f"""WITH {_MENTION}, n AS (SELECT th.theme_id, count(*) FILTER (type = 'claim') AS claims, count(*) FILTER (type = 'evidence') AS evidence,
  count(*) FILTER (type = 'reasoning') AS reasoning FROM th LEFT JOIN ut ON ut.theme_id = th.theme_id GROUP BY 1)
SELECT *, {R('(evidence + reasoning) / greatest(claims, 1)::DOUBLE')} AS strength FROM n""")
def argument_strength(spark, folder):
    ev = tables.documents_evidence(spark, folder)
    return argument.argument_strength(ev, argument.unit_themes(ev, _units(spark, folder))).withColumn("strength", r6("strength"))


@query("argument_relations", f"""WITH {_MENTION},
un AS (SELECT ut.*, ord, part::BIGINT * 1000000 + unit AS seq FROM ut JOIN th ON th.theme_id = ut.theme_id),
fc AS (SELECT study_id, theme_id, ord, min(seq) AS seq FROM un WHERE type = 'claim' GROUP BY 1, 2, 3),
fe AS (SELECT study_id, theme_id, ord, min(seq) AS seq FROM un WHERE type = 'evidence' GROUP BY 1, 2, 3),
hit AS (SELECT c.theme_id AS source, e.theme_id AS target, least(c.theme_id, e.theme_id) AS x, greatest(c.theme_id, e.theme_id) AS y, c.study_id, c.seq,
  row_number() OVER (PARTITION BY least(c.theme_id, e.theme_id), greatest(c.theme_id, e.theme_id) ORDER BY c.study_id, c.seq, c.ord, e.seq, e.ord) AS rn
  FROM fc c JOIN fe e ON c.study_id = e.study_id AND c.theme_id <> e.theme_id),
f AS (SELECT source, target, {_clean("text")} AS w FROM hit JOIN u ON u.study_id = hit.study_id AND u.part::BIGINT * 1000000 + u.unit = hit.seq WHERE rn = 1),
p AS (SELECT source, target, unnest(w) AS w, unnest(range(len(w))) AS p FROM f),
ng AS (SELECT DISTINCT a.source, a.target FROM p a JOIN lw ON lw.theme_id = a.target AND lw.word = a.w
  JOIN p b ON b.source = a.source AND b.target = a.target AND abs(a.p - b.p) <= 5 AND b.w IN ({quoted(_A.negations)}))
SELECT f.source, f.target, CASE WHEN ng.source IS NULL THEN 'supports' ELSE 'refutes' END AS type FROM f
LEFT JOIN ng ON ng.source = f.source AND ng.target = f.target""")
def argument_relations(spark, folder):
    return argument.argument_relations(tables.documents_evidence(spark, folder), cut(_units(spark, folder)), ARGUMENTS)


# --- causal claims ------------------------------------------------------------

WORDS = [("que", "+"), ("and", "+"), ("thth", "-"), ("der", "-"), ("with", "+")]
PATTERNS = [(rf"\b{w}\b", s) for w, s in WORDS]
_B = "[^\\p{L}\\p{N}_]"
_CLAIM = " UNION ALL ".join(
    f"SELECT study_id, part, sent, {i} AS pattern, '{s}' AS direction, text, {len(w)} AS n, "
    f"regexp_extract(text, '(?is)^(|.*?{_B}){w}(?:$|{_B})', 1) AS b FROM sent WHERE regexp_matches(text, '(?is)(^|{_B}){w}($|{_B})')"
    for i, (w, s) in enumerate(WORDS))
_EDGES = f"""{_SENT}, m AS ({_CLAIM}),
cl AS (SELECT study_id, part, sent, pattern, direction, trim(b) AS cause, trim(substr(text, length(b) + n + 1)) AS effect FROM m),
claims AS (SELECT * FROM cl WHERE cause <> '' AND effect <> ''),
bk AS (SELECT theme_id, ord, list_distinct({raw_tokens("label || ' ' || array_to_string(concepts, ' ')")}) AS t FROM th),
ph AS (SELECT DISTINCT p, list_distinct({raw_tokens("p")}) AS t FROM (SELECT cause AS p FROM claims UNION SELECT effect FROM claims)),
bs AS (SELECT p, theme_id FROM (SELECT p, theme_id, row_number() OVER (PARTITION BY p ORDER BY len(list_intersect(ph.t, bk.t)) DESC, ord) AS rn
   FROM ph, bk WHERE len(list_intersect(ph.t, bk.t)) > 0) WHERE rn = 1),
ct AS (SELECT claims.*, a.theme_id AS cause_theme, b.theme_id AS effect_theme FROM claims JOIN bs a ON a.p = cause JOIN bs b ON b.p = effect),
e AS (SELECT cause_theme, effect_theme, arg_max(direction, (study_id, part, sent, pattern)) AS direction, count(*) AS count FROM ct
   WHERE cause_theme <> effect_theme GROUP BY 1, 2)"""


def _claims(spark, folder):
    return causal.causal_claims(tables.document_parts(spark, folder), PATTERNS)


def _edges(spark, folder):
    ev = tables.documents_evidence(spark, folder)
    return cut(causal.causal_edges(ev, causal.claim_themes(ev, _claims(spark, folder))))


@query("causal_claims", f"WITH {_EDGES} SELECT * FROM claims")
def causal_claims(spark, folder):
    return _claims(spark, folder)


@query("causal_edges", f"WITH {_EDGES} SELECT * FROM e")
def causal_edges(spark, folder):
    return _edges(spark, folder)


@query("causal_density", f"""WITH {_EDGES}, c AS (SELECT (SELECT count(*) FROM claims) AS n_claims, (SELECT count(*) FROM sent) AS n_sentences)
SELECT *, {R('n_claims / n_sentences::DOUBLE')} AS density FROM c""")
def causal_density(spark, folder):
    return causal.causal_density(tables.document_parts(spark, folder), _claims(spark, folder)).withColumn("density", r6("density"))


@query("leverage_themes", f"""WITH {_EDGES}, d AS (SELECT cause_theme AS theme_id, 1 AS o, 0 AS i FROM e UNION ALL SELECT effect_theme, 0, 1 FROM e)
SELECT theme_id, {R('sum(o) / greatest(sum(i), 1)::DOUBLE')} AS score FROM d GROUP BY 1""")
def leverage_themes(spark, folder):
    return causal.leverage_themes(_edges(spark, folder)).withColumn("score", r6("score"))


_LOOPS = f"""{_EDGES}, pt(path, tip, minus) AS (SELECT [cause_theme, effect_theme], effect_theme, (direction = '-')::INT FROM e WHERE cause_theme < effect_theme
 UNION ALL SELECT list_append(path, effect_theme), effect_theme, minus + (direction = '-')::INT FROM pt JOIN e ON cause_theme = tip
   WHERE effect_theme > path[1] AND NOT list_contains(path, effect_theme)),
lp AS (SELECT path, minus + (direction = '-')::INT AS minus FROM pt JOIN e ON cause_theme = tip AND effect_theme = path[1])"""


@query("feedback_loops", f"""WITH RECURSIVE {_LOOPS} SELECT array_to_string(path, ',') AS themes,
  CASE WHEN minus % 2 = 0 THEN 'reinforcing' ELSE 'balancing' END AS type FROM lp""")
def feedback_loops(spark, folder):
    return causal.feedback_loops(_edges(spark, folder)).withColumn("themes", F.array_join("themes", ","))


@query("system_archetypes", f"""WITH RECURSIVE {_LOOPS} SELECT 'Reinforcing loop (>=3 nodes)' AS archetype WHERE EXISTS (SELECT 1 FROM lp WHERE minus % 2 = 0 AND len(path) >= 3)
UNION ALL SELECT 'Fixes that fail' WHERE EXISTS (SELECT 1 FROM lp WHERE minus % 2 = 0 AND len(path) = 3)
UNION ALL SELECT 'Shifting the burden' WHERE EXISTS (SELECT 1 FROM e a JOIN e b ON a.effect_theme = b.cause_theme JOIN e c ON c.cause_theme = a.cause_theme AND c.effect_theme = b.effect_theme)""")
def system_archetypes(spark, folder):
    edges = _edges(spark, folder)
    return causal.system_archetypes(edges, causal.feedback_loops(edges))
