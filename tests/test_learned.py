"""Fitted operators: against numpy where the result is determined, invariants elsewhere."""

import numpy as np
import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from weft.operators import classify, factor, kernels, temporal, topics
from weft.operators.text import vocabulary


@pytest.fixture(scope="module")
def texts(spark):
    words = {0: "care family support nurse", 1: "market price trade money", 2: "river forest water stone"}
    made = [(f"S{i:02d}", " ".join((words[i % 3] + " ") * 4 + words[(i + 1) % 3].split()[i % 4] for _ in range(2))) for i in range(30)]
    return spark.createDataFrame(made, "study_id string, text string")


def test_kernel_pca_against_numpy(make):
    assigned = {"A": ["S0", "S1", "S2", "S3", "S4"], "B": ["S0", "S1", "S5"], "C": ["S2", "S5", "S6", "S7"], "D": ["S1", "S7"]}
    studies = [f"S{i}" for i in range(9)]
    ev = make(assigned, studies)
    sets = [frozenset(t for t, ss in assigned.items() if s in ss) for s in studies]
    kernel = np.array([[float(len(a & b)) * (4 if a == b else 1) for b in sets] for a in sets])
    middle = np.eye(9) - 1 / 9
    values, vectors = np.linalg.eigh(middle @ kernel @ middle)
    want = (vectors[:, ::-1][:, :2] * np.sqrt(values[::-1][:2]))
    got = np.array([[r["x"], r["y"]] for r in kernels.kernel_pca(ev).orderBy("study_id").collect()])
    for c in range(2):
        assert np.allclose(np.abs(got[:, c]), np.abs(want[:, c]), atol=1e-4)
        assert got[np.abs(got[:, c]).argmax(), c] > 0


def test_topics_are_distributions(texts):
    report = topics.topic_report(texts, k=3)
    model = topics.fit_topics(texts, k=3)
    for r in model.words.groupBy("topic").agg(F.sum("weight").alias("s")).collect():
        assert r["s"] == pytest.approx(1.0)
    for r in model.mix.groupBy("study_id").agg(F.sum("share").alias("s"), F.count("*").alias("n")).collect():
        assert r["s"] == pytest.approx(1.0) and r["n"] == 3
    n = vocabulary(texts, 1).count()
    assert 1.0 < one(report["perplexity"])["perplexity"] < n
    assert {r["topic"] for r in report["coherence"].collect()} == {0, 1, 2}
    tops = {r["topic"]: r["term"] for r in topics.top_words(model, 1).collect()}
    assert len(tops) == 3


def training(spark, texts):
    labels = texts.select("study_id", F.concat(F.lit("L"), (F.substring("study_id", 2, 2).cast("int") % 3).cast("string")).alias("label"))
    features = classify.top_features(texts)
    return classify.feature_values(texts, features).cache(), labels, features.cache()


def test_trees_learn_what_separates(spark, texts):
    made = training(spark, texts)
    said = classify.tree_predictions(*made).collect()
    assert len(said) == 30 and all(r["label"] == r["predicted"] for r in said)
    weights = classify.forest_importance(*made).collect()
    assert weights and all(a["importance"] >= b["importance"] >= 0 for a, b in zip(weights, weights[1:]))
    accuracy = one(classify.fold_accuracy(*made))
    assert accuracy["n"] == 30 and accuracy["accuracy"] > 0.8


def test_absent_labels_are_errors(spark, texts):
    values, labels, features = training(spark, texts)
    lone = labels.withColumn("label", F.when(F.col("study_id") == "S00", "only").otherwise(F.lit("rest")))
    folds = one(classify.fold_accuracy(values, lone, features))
    assert folds["n"] == 30 and folds["accuracy"] <= 29 / 30
    drawn = {(r["tree"], r["study_id"]): r["draws"] for r in classify.forest(values, lone, features, trees=6)[0].collect()}
    voted = {s for (_, s), d in drawn.items() if d == 0}
    error = one(classify.out_of_bag_error(values, lone, features, trees=6))
    assert len(drawn) == 180 and error["n"] == len(voted)
    assert "S00" not in voted or error["oob_error"] >= 1 / len(voted) - 1e-12


def by_recursion(values, samples, features, depth=0):
    """A tree as nested tuples; samples: (study, label, draws), values: {(study, term): value}."""
    counts = {}
    for _, label, d in samples:
        counts[label] = counts.get(label, 0) + d
    most = min(counts, key=lambda x: (-counts[x], x))

    def bits(rows):
        n, per = sum(d for *_, d in rows), {}
        for _, label, d in rows:
            per[label] = per.get(label, 0) + d
        return -sum(c / n * np.log2(c / n) for c in per.values())
    n = sum(counts.values())
    best = None
    if len(counts) > 1 and depth < classify.DEPTH and n >= classify.LEAST:
        for term in sorted(features):
            spread = sorted(values.get((s, term), 0.0) for s, _, d in samples for _ in range(d))
            low = [x for x in samples if values.get((x[0], term), 0.0) <= spread[n // 2]]
            high = [x for x in samples if values.get((x[0], term), 0.0) > spread[n // 2]]
            if low and high:
                gain = bits(samples) - sum(sum(d for *_, d in x) / n * bits(x) for x in (low, high))
                if round(gain, 12) > 0 and (best is None or round(gain, 12) > round(best[0], 12)):
                    best = gain, term, spread[n // 2], low, high
    if best is None:
        return most
    _, term, threshold, low, high = best
    rest = [f for f in features if f != term]
    return term, threshold, by_recursion(values, low, rest, depth + 1), by_recursion(values, high, rest, depth + 1)


def said_by(tree, values, study):
    while isinstance(tree, tuple):
        tree = tree[3] if values.get((study, tree[0]), 0.0) > tree[1] else tree[2]
    return tree


def test_trees_against_recursion(spark):
    rng = np.random.default_rng(3)
    studies, terms = [f"S{i:03d}" for i in range(80)], [f"t{i}" for i in range(9)]
    cells = {(s, t): round(float(rng.choice([0.1, 0.2, -0.3, 0.7])), 12) for s in studies for t in terms if rng.random() < 0.6}
    label = {s: str(rng.choice(["x", "y", "z"])) if cells.get((s, "t3"), 0) < 0.5 else "x" for s in studies}
    values = spark.createDataFrame([(s, t, v) for (s, t), v in cells.items()], "study_id string, term string, value double")
    labels = spark.createDataFrame(list(label.items()), "study_id string, label string")
    features = spark.createDataFrame([(t,) for t in terms], "term string")
    tree = by_recursion(cells, [(s, label[s], 1) for s in studies], terms)
    assert isinstance(tree, tuple) and isinstance(tree[2], tuple)
    got = {r["study_id"]: r["predicted"] for r in classify.tree_predictions(values, labels, features).collect()}
    assert got == {s: said_by(tree, cells, s) for s in studies}
    said, splits = classify.forest(values, labels, features, trees=4)
    drawn, used = {}, {}
    for r in said.collect():
        drawn.setdefault(r["tree"], []).append((r["study_id"], r["draws"], r["predicted"]))
    for r in splits.collect():
        used.setdefault(r["tree"], set()).add(r["term"])
    assert all(len(x) <= 3 for x in used.values())
    whole = classify.grow(values, said.drop("predicted"), spark.createDataFrame([(i, t) for i in range(4) for t in terms], "tree int, term string"))[0]
    for r in whole.collect():
        drawn.setdefault((r["tree"], "all"), {})[r["study_id"]] = r["predicted"]
    for t in range(4):
        bag = [(s, label[s], d) for s, d, _ in drawn[t] if d > 0]
        tree = by_recursion(cells, bag, terms)
        assert drawn[t, "all"] == {s: said_by(tree, cells, s) for s in studies}


def test_votes(spark):
    votes = spark.createDataFrame([("a", "x", "x"), ("a", "x", "y"), ("b", "x", "y"), ("b", "x", "y"), ("b", "x", "x")], "study_id string, label string, predicted string")
    assert tuple(one(classify.vote_error(votes)).values()) == (2, 0.5)


def test_lsa_against_numpy(texts):
    from weft.operators.text import tfidf
    cells = tfidf(texts).collect()
    studies, terms = sorted({r["study_id"] for r in cells}), sorted({r["term"] for r in cells})
    a = np.zeros((len(studies), len(terms)))
    for r in cells:
        a[studies.index(r["study_id"]), terms.index(r["term"])] = r["weight"]
    s = np.linalg.svd(a, compute_uv=False)
    got = {r["concept"]: r["variance_explained"] for r in factor.lsa(texts)["concepts"].collect()}
    assert [got[k] for k in (1, 2, 3)] == pytest.approx((s[:3] ** 2 / (s ** 2).sum()).tolist(), rel=1e-6)


def test_word_vectors_and_clusters(texts):
    report = factor.embedding_report(texts, dim=4)
    words = rows(report["vectors"], "word")
    assert words == rows(vocabulary(texts, 2), "term")
    assert all(len(r["v"]) == 4 for r in report["vectors"].collect())
    clusters = {r["word"]: r["cluster"] for r in report["clusters"].collect()}
    assert set(clusters) == {w[0] for w in words} and set(clusters.values()) <= set(range(min(5, max(1, len(words) // 3))))
    near = report["neighbours"].collect()
    assert all(r["word"] != r["other"] and 1 <= r["rank"] <= 5 and -1 <= r["similarity"] <= 1 for r in near)


def test_wide_studies_meet_theme_by_theme(make):
    themes = {f"T{i:02d}": ["W"] + (["A"] if i == 3 else []) + (["B"] if i in (3, 19) else []) for i in range(20)}
    ev = make(themes, ["A", "W", "B", "C"], years={"A": 2000, "W": 2001, "B": 2002, "C": 2003})
    assert dict(rows(temporal.influence_degree(ev))) == {"A": 2, "W": 1, "B": 0, "C": 0}
