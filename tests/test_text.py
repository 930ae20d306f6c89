"""Text operators against plain Python on a handful of short texts."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import one, rows

from weft.functions.lexicons import STOPWORDS
from weft.operators import argument, causal, depth, dialectic, factor, grounded, kernels, narrative, ngram, sentiment, text
from weft.plans.blocks import paired_within
from weft.plans.components import connected_components

WORDS = "amber birch cedar delta ember fjord grove haven inlet".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    data = {i: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(3, 9))) for i in range(24)}
    data[24], data[25], data[26] = data[0], " ".join(reversed(data[0].split())), "the a 1"
    return data, spark.createDataFrame(list(data.items()), "study_id bigint, text string")


def tokens(t):
    return [w for w in re.split("[^a-zA-Z]+", t.lower()) if len(w) > 1 and w not in STOPWORDS]


def weights(data):
    df = Counter(w for t in data.values() for w in set(tokens(t)))
    out = {}
    for i, t in data.items():
        ws = tokens(t)
        out[i] = {w: c / len(ws) * math.log(len(data) / (1 + df[w])) for w, c in Counter(ws).items()}
    return out


def cosine(a, b):
    na, nb = (math.sqrt(sum(x * x for x in v.values())) for v in (a, b))
    return sum(a[w] * b[w] for w in a if w in b) / (na * nb) if na and nb else 0.0


def test_tfidf(corpus):
    data, df = corpus
    got = {(s, t): w for s, t, w in rows(text.tfidf(df), "study_id", "term", "weight")}
    want = {(i, t): w for i, v in weights(data).items() for t, w in v.items()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("slack", [0.25, 1.0])
def test_similar_pairs(corpus, slack):
    data, df = corpus
    v = weights(data)
    reps = {r for _, r in rows(text.copies(text.read_once(df)))}
    assert 24 not in reps and 25 not in reps
    want = {(a, b): cosine(v[a], v[b]) for a, b in itertools.combinations(sorted(reps), 2) if cosine(v[a], v[b]) > 0.5}
    got = {(a, b): s for a, b, s in rows(text.similar_pairs(df, 0.5, slack))}
    assert got == pytest.approx(want)


def test_clusters(corpus):
    data, df = corpus
    v = weights(data)
    label = {i: i for i in data}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(data, 2):
            if cosine(v[a], v[b]) > 0.8 or (tokens(data[a]) and sorted(tokens(data[a])) == sorted(tokens(data[b]))):
                low = min(label[a], label[b])
                changed |= label[a] != low or label[b] != low
                label[a] = label[b] = low
    assert dict(rows(text.study_clusters(df, 0.8))) == label


def test_blocks_pair_everything_once(spark):
    df = spark.createDataFrame([("k", i) for i in range(37)] + [("m", 1)], "k string, x int")
    got = rows(paired_within(df, "k", "x", block=5), "a", "b")
    assert got == list(itertools.combinations(range(37), 2))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in range(1, 53)], "node int")
    got = dict(rows(connected_components(nodes, edges)))
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: i for i in range(41, 51)}, 51: 50, 52: 52}


def test_cooccurrence(corpus):
    data, df = corpus
    seen = Counter(w for t in data.values() for w in set(tokens(t)))
    want = Counter()
    for t in data.values():
        ws = tokens(t)
        for i, j in itertools.combinations(range(len(ws)), 2):
            if j - i <= 2 and seen[ws[i]] > 1 and seen[ws[j]] > 1:
                want[tuple(sorted((ws[i], ws[j])))] += 1
    assert {(a, b): n for a, b, n in rows(text.cooccurrence(df, 2))} == dict(want)


def test_lsa_matches_numpy(corpus):
    data, df = corpus
    v = weights(data)
    terms = sorted({t for x in v.values() for t in x})
    m = np.array([[x.get(t, 0.0) for t in terms] for x in v.values()])
    s = np.linalg.svd(m, compute_uv=False)
    got = [e for _, e in rows(factor.lsa(df)["concepts"])]
    assert got == pytest.approx(list(s[:3] ** 2 / (s ** 2).sum()))


def test_nearest_words(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(30, 4))
    df = spark.createDataFrame([(f"w{i:02d}", [float(y) for y in r]) for i, r in enumerate(x)], "word string, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T - 3 * np.eye(30)
    old, factor.BLOCK = factor.BLOCK, 7
    try:
        got = factor.nearest_words(df, 5).collect()
    finally:
        factor.BLOCK = old
    for r in got:
        assert r["other"] == f"w{np.argsort(-sim[int(r['word'][1:])])[r['rank'] - 1]:02d}"
    assert len(got) == 150


def score(sentence, lex):
    """The countdown rule, token by token."""
    ts = [t for t in re.split("[^a-zA-Z]+", sentence.lower()) if t]
    total = scored = window = 0
    for t in ts:
        if t in lex.negators:
            window = 3
        elif t not in lex.intensifiers:
            if t in lex.positive or t in lex.negative:
                scored += 1
                sign = 1 if t in lex.positive else -1
                total += -sign if window else sign
            window = max(0, window - 1)
    for i, t in enumerate(ts[:-1]):
        if t in lex.intensifiers and (ts[i + 1] in lex.positive or ts[i + 1] in lex.negative):
            sign = 1 if ts[i + 1] in lex.positive else -1
            total += 0.5 * (-sign if any(x in lex.negators for x in ts[max(0, i - 3):i]) else sign)
    return total / scored if scored else 0.0


def test_sentence_scores(spark):
    lex = sentiment.SentimentLexicon()
    rnd = random.Random(5)
    pool = ["happy", "sad", "very", "not", "never", "joy", "fear", "x", "y", "highly"]
    data = [(i, 0, " ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12)))) for i in range(300)] + [(300, 0, "very happy")]
    got = dict(rows(sentiment.sentence_sentiment(spark.createDataFrame(data, "study_id int, part int, text string")), "study_id", "sentiment"))
    assert got == pytest.approx({i: score(t, lex) for i, _, t in data})
    assert got[300] == 1.5


def test_argument_units(spark):
    df = spark.createDataFrame([(1, 0, "Results suggest gain. Several participants stated it. They described it! Therefore it holds.")],
                               "study_id int, part int, text string")
    got = rows(argument.argument_units(df), "unit", "type", "text")
    assert got == [(0, "claim", "Results suggest gain."), (1, "evidence", "Several participants stated it. They described it!"),
                   (2, "reasoning", "Therefore it holds.")]


def test_causal_claims(spark):
    df = spark.createDataFrame([(1, 0, "Stress leads to fatigue. Support reduces stress."), (2, 0, "because of it")],
                               "study_id int, part int, text string")
    assert rows(causal.causal_claims(df), "direction", "cause", "effect") == [("+", "Stress", "fatigue."), ("-", "Support", "stress.")]


def test_causal_phrases_are_whole(spark):
    far = "stress " + "and more " * 20 + "heat"
    df = spark.createDataFrame([(1, 0, f"{far} leads to {far[::-1]}")], "study_id int, part int, text string")
    assert rows(causal.causal_claims(df), "cause", "effect") == [(far, far[::-1])]
    assert [len(x) for x in rows(causal.causal_claims(df, phrase_length=120), "cause", "effect")[0]] == [120, 120]


def test_feedback_loops(spark):
    e = spark.createDataFrame([("A", "B", "+", 1), ("B", "A", "-", 1), ("B", "C", "-", 1), ("C", "A", "-", 1)],
                              "cause_theme string, effect_theme string, direction string, count int")
    loops = causal.feedback_loops(e)
    assert rows(loops) == [(["A", "B"], "balancing"), (["A", "B", "C"], "reinforcing")]
    assert len(rows(causal.system_archetypes(e, loops))) == 3


def test_bigram_model(spark):
    parts = spark.createDataFrame([("amber birch amber birch.",), ("cedar",)], "text string")
    two, uni = ngram.bigram_model(parts), ngram.unigram_model(parts)
    assert {(a, b): p for a, b, p in rows(two, "w1", "w2", "p")} == {
        ("amber", "birch"): 1.0, ("birch", "amber"): 0.5, ("birch", "<END>"): 0.5}
    assert dict(rows(uni, "word", "count")) == {"amber": 2, "birch": 2, "<END>": 1}
    assert one(ngram.perplexity(two, uni, parts))["perplexity"] == pytest.approx(math.exp(-(2 * math.log(0.5)) / 4))


def test_axial_categories(spark):
    held = {"a b": [1, 2, 3], "b c": [1, 2], "d e": [7, 8], "e f": [8, 9, 10]}
    m = spark.createDataFrame([(k, len(v), s) for k, v in held.items() for s in v], "label string, frequency int, study_id int")
    got = {l: c for l, c, _ in rows(grounded.axial_categories(m))}
    assert got == {"a b": "a b", "b c": "a b", "d e": "e f", "e f": "e f"}


def test_axial_merges_by_recounting(spark):
    """Rounds of mutually best pairs, with all shared studies counted anew in each."""
    import random
    rng = random.Random(4)
    held = {f"c{i:02d} x": set(rng.sample(range(14), rng.randint(2, 6))) for i in range(26)}
    order = {k: n for n, k in enumerate(sorted(held, key=lambda k: (-len(held[k]), k)))}
    groups, names, rounds = {order[k]: set(s) for k, s in held.items()}, {order[k]: [k] for k in held}, 0
    while True:
        keys = {(a, b): (-len(groups[a] & groups[b]) / max(len(groups[a]), len(groups[b])), a, b) for a in groups for b in groups if a < b}
        best = {c: min((k for p, k in keys.items() if c in p and -k[0] >= 0.45), default=None) for c in groups}
        mutual = [k for k in set(best.values()) if k is not None and best[k[1]] == best[k[2]]]
        if not mutual:
            break
        rounds += 1
        for _, a, b in mutual:
            groups[a] |= groups.pop(b)
            names[a] += names.pop(b)
    first = {n: k for k, n in order.items()}
    want = {k: first[n] for n, ks in names.items() for k in ks}
    assert rounds > 2 and 1 < len(groups) < 20
    m = spark.createDataFrame([(k, len(v), s) for k, v in held.items() for s in v], "label string, frequency int, study_id int")
    assert {l: c for l, c, _ in rows(grounded.axial_categories(m, 0.45))} == want


def test_dialectic(make):
    ev = make({"P": ["s1", "s3"], "N": ["s2", "s3"], "B": ["s1", "s2"]}, ["s1", "s2", "s3"],
              texts={"s1": ["a helpful benefit"], "s2": ["a barrier and a burden"], "s3": []})
    lines = ev.studies.selectExpr("study_id", "explode(findings) AS text")
    pol = dialectic.theme_polarity(ev, lines)
    assert dict(rows(pol)) == {"P": 1.0, "N": -1.0, "B": 0.0}
    pairs = dialectic.antithetical_pairs(ev, pol)
    found = dialectic.syntheses(ev, pairs)
    assert rows(pairs) == [("P", "N", 1.0)] and rows(found) == [("P", "N", "B", 0.6667)]
    assert one(dialectic.dialectic_scores(ev, pairs, found)) == pytest.approx({"dialectical_depth": 1.0, "resolution_score": 2 / 3})


def test_storylines(make):
    ev = make({"A": ["s1"], "B": [], "C": ["s1"]}, ["s1", "s2"], labels={"A": "alpha", "B": "beta", "C": "gamma"},
              texts={"s1": ["beta first", "then alpha"], "s2": ["beta", "alpha"]})
    stories = narrative.storylines(ev)
    assert dict(rows(stories)) == {"s1": ["B", "A", "C"], "s2": ["B", "A"]}
    sim = rows(narrative.storyline_similarity(ev, narrative.storyline_classes(stories)), "similarity")
    assert sim == [(pytest.approx(2 / 3),)]
    assert dict(rows(narrative.traditions(ev, stories))) == {"s1": "s1", "s2": "s1"}


def test_kernels(make, spark):
    ev = make({"A": ["s1", "s2"], "B": ["s1", "s2", "s3"], "C": ["s2"]}, ["s1", "s2", "s3"])
    k = {(a, b): v for a, b, v in rows(kernels.wl_kernel(ev), "a", "b", "kernel")}
    assert k["A\x01B", "A\x01B"] == 8 and k["A\x01B\x01C", "A\x01B\x01C"] == 12 and k["B", "B"] == 4
    assert k["A\x01B", "A\x01B\x01C"] == 2
    nodes = ev.theme_studies.selectExpr("study_id AS graph", "theme_id AS node", "theme_id AS label")
    edges = nodes.selectExpr("graph", "node AS src").join(nodes.selectExpr("graph", "node AS dst"), "graph").filter("src <> dst")
    general = {(a, b): v for a, b, v in rows(kernels.histogram_kernel(kernels.wl_histogram(nodes, edges)))}
    assert general == {("s1", "s1"): 8, ("s2", "s2"): 12, ("s3", "s3"): 4, ("s1", "s2"): 2, ("s1", "s3"): 1, ("s2", "s3"): 1}
    rw = {(a, b): v for a, b, v in rows(kernels.rw_kernel(ev), "ka", "kb", "kernel")}
    assert rw[2, 2] == pytest.approx(0.444) and rw[3, 3] == pytest.approx(9 * (0.4 + 0.16 + 0.064))


def test_depth(make):
    ev = make({"A": ["s1"], "B": [], "C": []}, ["s1", "s2"], labels={"A": "coping framework", "B": "daily meaning", "C": "plain"},
              levels={"C": "analytical"}, parents={"A": "B", "B": "A"}, texts={"s2": ["framework is not seen"], "s1": []})
    assert dict(rows(depth.abstraction_levels(ev.themes))) == {"A": 4, "B": 2, "C": 3}
    assert dict(rows(depth.hierarchy_depths(ev.themes))) == {"A": 2, "B": 2, "C": 0}
    lines = ev.studies.selectExpr("study_id", "explode(findings) AS text")
    assert rows(depth.refuted_themes(ev, lines)) == [("A",)]
