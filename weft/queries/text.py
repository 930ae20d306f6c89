"""Queries over document text: vectors, similarity, co-occurrence, n-gram models."""

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import ngram, text
from ..sources import tables
from .registry import query
from .views import DOCS, tokens
from .views import r6 as R

_TOK = f"""tk AS (SELECT doc_id AS study_id, {tokens("text")} AS t FROM documents),
tok AS (SELECT study_id, unnest(t) AS term, len(t) AS n FROM tk),
df AS (SELECT term, count(DISTINCT study_id) AS df FROM tok GROUP BY term),
w AS (SELECT study_id, tok.term, any_value(df) AS df, count(*) AS tf,
   count(*) / any_value(n)::DOUBLE * ln((SELECT count(*) FROM documents) / (1.0 + any_value(df))) AS weight
   FROM tok JOIN df ON df.term = tok.term GROUP BY study_id, tok.term)"""


@query("document_frequency", f"WITH {_TOK} SELECT term, df FROM df")
def document_frequency(spark, folder):
    return text.document_frequency(tables.document_texts(spark, folder))


@query("tfidf", f"WITH {_TOK} SELECT study_id, term, tf, {R('weight')} AS weight FROM w")
def tfidf(spark, folder):
    return text.tfidf(tables.document_texts(spark, folder)).select(
        "study_id", "term", "tf", r6("weight").alias("weight"))


@query("tfidf_top_terms", f"""WITH {_TOK}, r AS (SELECT *, row_number() OVER (PARTITION BY study_id
  ORDER BY round(weight, 12) DESC, term) AS rank FROM w) SELECT study_id, term, rank, {R('weight')} AS weight FROM r WHERE rank <= 3""")
def tfidf_top_terms(spark, folder):
    return text.top_terms(tables.document_texts(spark, folder)).select(
        "study_id", "term", "rank", r6("weight").alias("weight"))


_COPIES = f"""{_TOK},
bag AS (SELECT study_id, min(study_id) OVER (PARTITION BY array_to_string(list_sort(t), ' ')) AS rep FROM tk)"""
_PAIRS = f"""{_COPIES},
u AS (SELECT study_id, term, weight / sqrt(sum(weight * weight) OVER (PARTITION BY study_id)) AS w FROM w
      WHERE study_id IN (SELECT rep FROM bag)),
sim AS (SELECT x.study_id AS a, y.study_id AS b, sum(x.w * y.w) AS similarity FROM u x JOIN u y
   ON x.term = y.term AND x.study_id < y.study_id GROUP BY 1, 2 HAVING sum(x.w * y.w) > {{t}})"""
THRESHOLD = 0.3


@query("copies", f"WITH {_COPIES} SELECT study_id, rep FROM bag")
def copies(spark, folder):
    return text.copies(text.read_once(tables.document_texts(spark, folder)))


@query("cosine_pairs", f"WITH {_PAIRS.format(t=THRESHOLD)} SELECT a, b, {R('similarity')} AS similarity FROM sim")
def cosine_pairs(spark, folder):
    return text.similar_pairs(tables.document_texts(spark, folder), THRESHOLD).select(
        "a", "b", r6("similarity").alias("similarity"))


_CLUSTERS = f"""{_PAIRS.format(t=THRESHOLD)},
e AS (SELECT a, b FROM sim UNION SELECT b, a FROM sim),
reach(a, b) AS (SELECT rep, rep FROM bag UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
comp AS (SELECT a AS rep, min(b) AS cluster FROM reach GROUP BY a),
cl AS (SELECT study_id, cluster FROM bag JOIN comp ON comp.rep = bag.rep)"""


@query("study_clusters", f"WITH RECURSIVE {_CLUSTERS} SELECT study_id, cluster FROM cl")
def study_clusters(spark, folder):
    return text.study_clusters(tables.document_texts(spark, folder), THRESHOLD)


@query("cluster_labels", f"""WITH RECURSIVE {_CLUSTERS}, s AS (SELECT cluster, term, sum(weight) AS weight FROM w JOIN cl
  ON cl.study_id = w.study_id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster
  ORDER BY round(weight, 12) DESC, term) AS rank FROM s)
SELECT cluster, rank, term, {R('weight')} AS weight FROM r WHERE rank <= 3""")
def cluster_labels(spark, folder):
    texts = tables.document_texts(spark, folder)
    return text.cluster_labels(texts, text.study_clusters(texts, THRESHOLD)).select(
        "cluster", "rank", "term", r6("weight").alias("weight"))


_COOC = f"""{_TOK}, v AS (SELECT term FROM df WHERE df >= 2),
pos AS (SELECT study_id, unnest(t) AS term, unnest(range(len(t))) AS p FROM tk),
x AS (SELECT least(a.term, b.term) AS w1, greatest(a.term, b.term) AS w2, count(*) AS n FROM
  (SELECT *, unnest(range(1, 6)) AS k FROM pos) a JOIN pos b ON b.study_id = a.study_id AND b.p = a.p + a.k
  WHERE a.term IN (SELECT term FROM v) AND b.term IN (SELECT term FROM v) GROUP BY 1, 2)"""


@query("cooccurrence", f"WITH {_COOC} SELECT w1, w2, n FROM x")
def cooccurrence(spark, folder):
    return text.cooccurrence(tables.document_texts(spark, folder))


@query("ppmi", f"""WITH {_COOC}, c AS (SELECT term, count(*) AS n FROM tok WHERE term IN (SELECT term FROM v) GROUP BY 1),
tp AS (SELECT sum(n)::DOUBLE AS t FROM x), tw AS (SELECT sum(n)::DOUBLE AS t FROM c),
y AS (SELECT w1, w2, x.n, log2(x.n / tp.t / (c1.n / tw.t * c2.n / tw.t)) AS ppmi FROM x JOIN c c1 ON c1.term = w1
  JOIN c c2 ON c2.term = w2, tp, tw WHERE w1 < w2)
SELECT w1, w2, n, {R('ppmi')} AS ppmi FROM y WHERE ppmi > 0""")
def ppmi(spark, folder):
    return text.ppmi(tables.document_texts(spark, folder)).select("w1", "w2", "n", r6("ppmi").alias("ppmi"))


# --- n-gram models ------------------------------------------------------------

_SEQ = f"""{DOCS},
sq AS (SELECT study_id, part, CASE WHEN regexp_matches(rtrim(text), '[.!?]$') THEN list_append({tokens("text")}, '<END>')
        ELSE {tokens("text")} END AS t FROM parts),
ps AS (SELECT study_id, part, unnest(t) AS w, unnest(range(len(t))) AS p, len(t) AS n FROM sq),
g AS (SELECT study_id, w AS w1, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3, n FROM ps WINDOW s AS (PARTITION BY study_id, part ORDER BY p)),
b AS (SELECT w1, w2, count(*) AS count FROM g WHERE w2 IS NOT NULL GROUP BY 1, 2),
bm AS (SELECT *, count / sum(count) OVER (PARTITION BY w1)::DOUBLE AS p FROM b),
um AS (SELECT w1 AS word, count(*) AS count, count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM g WHERE n >= 2 GROUP BY 1)"""


@query("bigram_model", f"WITH {_SEQ} SELECT w1, w2, count, {R('p')} AS p FROM bm")
def bigram_model(spark, folder):
    return ngram.bigram_model(tables.document_parts(spark, folder)).withColumn("p", r6("p"))


@query("trigram_model", f"""WITH {_SEQ}, t AS (SELECT w1, w2, w3, count(*) AS count FROM g WHERE w3 IS NOT NULL GROUP BY 1, 2, 3)
SELECT w1, w2, w3, count, {R('count / sum(count) OVER (PARTITION BY w1, w2)::DOUBLE')} AS p FROM t""")
def trigram_model(spark, folder):
    return ngram.trigram_model(tables.document_parts(spark, folder)).withColumn("p", r6("p"))


@query("unigram_model", f"WITH {_SEQ} SELECT word, count, {R('p')} AS p FROM um")
def unigram_model(spark, folder):
    return ngram.unigram_model(tables.document_parts(spark, folder)).withColumn("p", r6("p"))


@query("bigram_perplexity", f"""WITH {_SEQ}, s AS (SELECT w1, w2, count(*) AS c FROM (SELECT unnest(t) AS w1,
    unnest(list_append(t[2:], NULL)) AS w2 FROM (SELECT CASE WHEN regexp_matches(rtrim(text), '[.!?]$')
    THEN list_append({tokens("text")}, '<END>') ELSE {tokens("text")} END AS t FROM benchmark) WHERE len(t) > 1)
  WHERE w2 IS NOT NULL GROUP BY 1, 2),
p AS (SELECT c, coalesce(bm.p, um.p * 0.1, 1.0 / ((SELECT count(*) FROM um) + 1)) AS p FROM s
  LEFT JOIN bm ON bm.w1 = s.w1 AND bm.w2 = s.w2 LEFT JOIN um ON um.word = s.w2)
SELECT sum(c)::BIGINT AS n_tokens, {R('exp(-sum(c * ln(p)) / sum(c))')} AS perplexity FROM p""")
def bigram_perplexity(spark, folder):
    parts = tables.document_parts(spark, folder)
    scored = tables.table(spark, folder, "benchmark").select("text")
    return ngram.perplexity(ngram.bigram_model(parts), ngram.unigram_model(parts), scored).withColumn(
        "perplexity", r6("perplexity"))


@query("bigram_coherence", f"""WITH {_SEQ}, k AS (SELECT item_id AS study_id, {tokens("text")} AS t FROM benchmark),
s AS (SELECT study_id, unnest(t) AS w1, unnest(list_append(t[2:], NULL)) AS w2 FROM k),
f AS (SELECT s.study_id, s.w2, bm.w1 AS hit FROM s LEFT JOIN bm ON bm.w1 = s.w1 AND bm.w2 = s.w2)
SELECT study_id, count(w2) AS n_bigrams, {R('CASE WHEN count(w2) > 0 THEN count(hit) / count(w2)::DOUBLE ELSE 0 END')} AS coherence
FROM f GROUP BY study_id""")
def bigram_coherence(spark, folder):
    texts = tables.table(spark, folder, "benchmark").select(F.col("item_id").alias("study_id"), "text")
    model = ngram.bigram_model(tables.document_parts(spark, folder))
    return ngram.coherence(model, texts).withColumn("coherence", r6("coherence"))


@query("theme_bigram_model", f"""WITH {_SEQ}, t AS (SELECT theme_id, w1, w2, count(*) AS count FROM g JOIN ts
  ON ts.study_id = g.study_id WHERE w2 IS NOT NULL GROUP BY 1, 2, 3)
SELECT theme_id, w1, w2, count, {R('count / sum(count) OVER (PARTITION BY theme_id, w1)::DOUBLE')} AS p FROM t""")
def theme_bigram_model(spark, folder):
    ev = tables.documents_evidence(spark, folder)
    return ngram.theme_bigram_model(tables.document_parts(spark, folder), ev.theme_studies).withColumn("p", r6("p"))


@query("model_sizes", f"""WITH {_SEQ} SELECT (SELECT count(DISTINCT w1) FROM b) AS bigram_contexts,
  (SELECT count(*) FROM (SELECT DISTINCT w1, w2 FROM g WHERE w3 IS NOT NULL)) AS trigram_contexts""")
def model_sizes(spark, folder):
    parts = tables.document_parts(spark, folder)
    return ngram.model_sizes(ngram.ngram_counts(parts, 2), ngram.ngram_counts(parts, 3))


@query("next_words", f"""WITH {_SEQ}, r AS (SELECT *, row_number() OVER (PARTITION BY w1 ORDER BY count DESC, w2) AS rank FROM bm)
SELECT w1, w2, rank, count, {R('p')} AS p FROM r WHERE rank <= 3""")
def next_words(spark, folder):
    return ngram.next_words(ngram.bigram_model(tables.document_parts(spark, folder))).withColumn("p", r6("p"))
