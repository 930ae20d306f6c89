"""Values worked out by hand on small theme tables."""

import math

import pytest
from conftest import one, rows

from weft.operators import category, concepts, network, order, saturation, synthesis, temporal
from weft.plans.pairs import theme_pairs

POSET = {"T1": ["s1", "s2", "s3", "s4"], "T2": ["s1", "s2"], "T3": ["s3"], "T4": ["s1"]}
STUDIES = ["s1", "s2", "s3", "s4", "s5"]


def test_grading_rules(spark):
    f = spark.createDataFrame([
        ("a", "t", "no", "no", "no", "no", "", ["x"]), ("b", "t", "minor", "no", "no", "no", "", []),
        ("c", "t", "minor", "minor", "minor", "no", "", []), ("d", "t", "moderate", "no", "no", "no", "", []),
        ("e", "t", "serious", "no", "no", "no", "", []), ("f", "t", "odd", "no", "no", "no", "", [])],
        "finding_id string, finding_text string, methodological_limitations string, coherence string, adequacy string, "
        "relevance string, explanation string, contributing_studies array<string>")
    got = dict(rows(synthesis.findings_table(synthesis.assess_findings(f)), "finding_id", "confidence"))
    assert got == {"a": "High", "b": "Moderate", "c": "Low", "d": "Low", "e": "Very Low", "f": "High"}


def test_merge_and_create_themes(spark, make):
    ev = make({"A": ["s2", "s1"], "B": ["s1", "s3"]}, STUDIES, concepts={"A": ["x", "y"], "B": ["y", "z"]})
    mapping = spark.createDataFrame([("A", "M", 0), ("B", "M", 1)], "old_id string, new_id string, ord bigint")
    labels = spark.createDataFrame([("M", "merged")], "new_id string, label string")
    got = one(synthesis.merge_themes(ev.themes, mapping, labels))
    assert (got["theme_id"], got["label"], got["level"], got["concepts"]) == ("M", "merged", "descriptive", ["x", "y", "z"])
    links = synthesis.merge_links(ev.theme_studies, mapping, "study_id").orderBy("theme_ord", "pos")
    assert [r["study_id"] for r in links.collect()] == ["s2", "s1", "s3"]
    new = spark.createDataFrame([("A", 9, "dup"), ("C", 10, "new")], "theme_id string, ord bigint, label string")
    assert rows(synthesis.create_themes(ev.themes, new), "theme_id", "label", "level")[-1] == ("C", "new", "descriptive")
    assert synthesis.create_themes(ev.themes, new).count() == 3


@pytest.mark.parametrize("n_studies,n_themes,expected", [(1, 1, "REJECT"), (2, 0, "WARN"), (2, 1, "PASS")])
def test_certificate(spark, n_studies, n_themes, expected):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(n_studies, n_themes, 0)], "s int, t int, f int")
    assert one(df.select(synthesis.certification(F.col("s"), F.col("t"), F.col("f")).alias("c")))["c"] == expected


def test_richness(make):
    ev = make({"A": ["s1", "s2", "s3", "s4", "s5"], "B": ["s1", "s2", "s3"], "C": ["s1", "s2"], "D": ["s1"], "E": ["s2"]}, STUDIES)
    got = one(saturation.richness(ev))
    assert (got["observed"], got["singletons"], got["doubletons"], got["assignments"]) == (5, 2, 1, 12)
    assert got["chao1"] == 7 and got["unseen"] == 2
    assert got["p_new"] == pytest.approx(1 / 6) and got["coverage"] == pytest.approx(5 / 6)
    curve = rows(saturation.rarefaction_curve(ev))
    want = [5 - sum(math.comb(5 - a, m) / math.comb(5, m) for a in (5, 3, 2, 1, 1)) for m in range(1, 6)]
    assert [m for m, _ in curve] == [1, 2, 3, 4, 5] and [x for _, x in curve] == pytest.approx(want)
    assert [m for m, _ in rows(saturation.extrapolation_curve(ev))] == [6, 7, 8, 9, 10]


def test_entropy_curve_is_the_entropy_of_each_prefix(make):
    assigned = {"A": ["s1", "s3", "s4"], "B": ["s2", "s3"], "C": ["s5"]}
    ev = make(assigned, STUDIES)
    got = [(i, h) for _, i, h in sorted(rows(saturation.saturation_curve(ev), "study_id", "idx", "entropy"), key=lambda r: r[1])]
    for i, h in got:
        counts = [sum(s in STUDIES[:i + 1] for s in ss) for ss in assigned.values()]
        t = sum(counts)
        assert h == pytest.approx(-sum(c / t * math.log2(c / t) for c in counts if c) + 0.0, abs=1e-12)


def test_order(make):
    ev = make(POSET, STUDIES)
    o = order.build_order(ev)
    assert rows(order.hasse_edges(o)) == [("T1", "T2"), ("T1", "T3"), ("T2", "T4")]
    counts = order.chains(o)
    mu = {(x, y): v for x, y, v in rows(order.moebius(o, counts))}
    assert (mu["T4", "T2"], mu["T3", "T1"], mu["T2", "T1"], mu["T4", "T1"], mu["T1", "T1"]) == (-1, -1, -1, 0, 1)
    s = one(order.order_summary(o, counts))
    assert (s["zeta1"], s["zeta2"], s["zeta3"], s["height"], s["width"], s["is_lattice"]) == (4, 8, 13, 2, 2, False)
    assert s["density"] == pytest.approx(2 / 3)


def test_equal_sets_fold_in_the_order(make):
    o = order.build_order(make({"A": ["s1"], "B": ["s1"], "C": ["s1", "s2"]}, STUDIES))
    assert rows(o.classes) == [("A", "A"), ("B", "A"), ("C", "C")]
    assert rows(order.hasse_edges(o)) == [("C", "A")]


def test_category(make):
    ev = make({"A": ["s1", "s2", "s3"], "B": ["s1", "s2"], "C": ["s3"], "D": ["s1", "s2"], "E": []}, STUDIES)
    arrows = rows(category.morphisms(ev))
    assert ("E", "A") in arrows and ("B", "D") in arrows and ("D", "B") in arrows and ("A", "B") not in arrows
    assert len(arrows) == 5 + 4 + 2 + 3  # identities, from the empty theme, B = D, into A
    assert rows(category.products(ev)) == [("A", "B", 2), ("A", "C", 1), ("A", "D", 2), ("B", "D", 2)]
    assert len(rows(category.coproducts(ev))) == 10
    assert dict(rows(category.isomorphism_classes(ev)))["D"] == "B"
    assert one(category.universal_objects(ev)) == {"terminal": "A", "initial": "E"}
    assert one(category.adjunction_score(ev))["adjunction_score"] == pytest.approx(0.8)


NET = {"A": ["s1", "s2"], "B": ["s1", "s3"], "C": ["s2", "s3"], "D": ["s4"], "E": ["s4", "s5"], "F": ["s5"]}


def test_network(make):
    ev = make({"A": ["s1"], "B": ["s1", "s2"], "C": ["s2"], "D": ["s3"]}, STUDIES)  # path A - B - C, D alone
    edges = network.adjacency(network.theme_incidence(ev))
    paths = network.shortest_paths(ev.themes, edges)
    assert ("A", "C", 2, 1.0) in rows(paths)
    assert dict(rows(network.closeness_centrality(ev.themes, paths))) == pytest.approx({"A": 2 / 3, "B": 1, "C": 2 / 3, "D": 0})
    assert dict(rows(network.betweenness_centrality(ev.themes, edges, paths))) == pytest.approx({"A": 0, "B": 1 / 3, "C": 0, "D": 0})


def test_communities(make):
    ev = make(NET, STUDIES)
    edges = network.adjacency(network.theme_incidence(ev))
    groups = network.communities(ev.themes, edges, newman=True)
    assert dict(rows(groups)) == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "D", "F": "D"}
    q = one(network.modularity(edges, groups))
    # triangle A B C (3 edges), path D - E - F (2 edges)
    assert q["modularity_newman"] == pytest.approx(3 / 5 - 0.36 + 2 / 5 - 0.16)
    assert q["modularity"] == pytest.approx(6 / 5 - 0.36 + 4 / 5 - 0.16)


def greedy(themes, half, weight):
    """One merge after the other: the pair with the largest gain, ties by name, while a gain is positive."""
    m, label = len(half), {t: t for t in themes}
    while True:
        share, links = {}, {}
        for a, b in half:
            for t in (a, b):
                share[label[t]] = share.get(label[t], 0) + 1 / (2 * m)
            pair = tuple(sorted((label[a], label[b])))
            if pair[0] != pair[1]:
                links[pair] = links.get(pair, 0) + 1
        gains = sorted((-round(weight * n / m - 2 * share[x] * share[y], 12), x, y) for (x, y), n in links.items())
        if not gains or gains[0][0] >= -1e-12:
            return label
        _, x, y = gains[0]
        label = {t: x if c == y else c for t, c in label.items()}


@pytest.mark.parametrize("newman", [False, True])
def test_communities_against_greedy_merges(make, newman):
    ev = make({"A": ["s1", "s2"], "B": ["s1", "s3"], "C": ["s2", "s3", "s4"], "D": ["s4", "s5", "s6"], "E": ["s5", "s7"], "F": ["s6", "s7"], "G": ["s8"]},
              [f"s{i}" for i in range(1, 9)])
    edges = network.adjacency(network.theme_incidence(ev))
    half = sorted({tuple(sorted((r["src"], r["dst"]))) for r in edges.collect()})
    assert dict(rows(network.communities(ev.themes, edges, newman=newman))) == greedy("ABCDEFG", half, 1.0 if newman else 2.0)


def test_formal_concepts_against_brute_force(make):
    assigned = {"A": ["s1", "s2"], "B": ["s2", "s3"], "C": ["s1", "s2", "s3"], "D": ["s4"]}
    ev = make(assigned, STUDIES)
    of = {s: frozenset(t for t, ss in assigned.items() if s in ss) for s in STUDIES}
    want = set()
    for mask in range(16):
        b = {t for i, t in enumerate(assigned) if mask >> i & 1}
        extent = [s for s in STUDIES if b <= of[s]]
        want.add((tuple(sorted(frozenset(assigned).intersection(*[of[s] for s in extent]))), len(extent)))
    got = {(tuple(i), n) for i, n in rows(concepts.formal_concepts(ev), "intent", "n_studies")}
    assert got == want


def test_implications(make):
    ev = make({"A": ["s1"], "B": ["s1", "s2"]}, STUDIES)
    assert rows(concepts.implications(ev)) == [(["A"], "B", 1)]


def test_implications_of_any_size(make):
    sets = {t: [f"s{k}" for k in range(6) if k != i] + ["s6"] for i, t in enumerate("ABCDE")} | {"F": ["s6"]}
    got = rows(concepts.implications(make(sets, [f"s{k}" for k in range(7)]), max_size=None))
    assert (["F"], "A", 1) in got and (list("BCDEF"), "A", 1) in got
    assert max(len(a) for a, _, _ in got) == 5


def test_influence_counts_match_edges(make):
    ev = make({"A": ["s1", "s2", "s4"], "B": ["s2", "s3", "s5"], "C": ["s1", "s5"]}, STUDIES,
              years={"s1": 2000, "s2": 2000, "s3": 2001, "s4": 2002, "s5": 2003})
    want = {s: 0 for s in STUDIES}
    for s, _ in rows(temporal.influence_edges(ev)):
        want[s] += 1
    assert dict(rows(temporal.influence_degree(ev))) == want
    assert dict(rows(temporal.influence_degree(ev, narrow=0))) == want


def test_growth_and_shift(make):
    ev = make({"A": ["s1", "s3"]}, STUDIES, years={"s1": 2000, "s2": 2001, "s3": 2002, "s4": 2002, "s5": 2005})
    assert rows(temporal.growth_curves(ev)) == [("A", 2000, 1), ("A", 2001, 1), ("A", 2002, 2)]


def test_theme_pairs_are_complete(make):
    ev = make({t: [] for t in "ABCDE"}, STUDIES)
    assert len(rows(theme_pairs(ev.themes))) == 10


def _ordered(spark, pairs, n):
    from weft.operators.order import Order
    below = spark.createDataFrame(pairs, "x string, y string") if pairs else spark.createDataFrame([], "x string, y string")
    elements = spark.createDataFrame([(f"e{i}",) for i in range(n)], "rep string")
    return Order(elements.select("rep", "rep").toDF("theme_id", "rep"), below, elements)


@pytest.mark.parametrize("seed, n, share", [(1, 9, 0.25), (2, 10, 0.5), (3, 8, 0.0), (4, 11, 0.15)])
def test_width_against_all_antichains(spark, seed, n, share):
    import random
    from itertools import combinations
    rng = random.Random(seed)
    lt = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < share}
    while True:
        more = {(a, d) for a, b in lt for c, d in lt if b == c} - lt
        if not more:
            break
        lt |= more
    best = max(k for k in range(1, n + 1) if any(all((a, b) not in lt for a, b in combinations(s, 2)) for s in combinations(range(n), k)))
    assert one(order.width(_ordered(spark, [(f"e{a}", f"e{b}") for a, b in lt], n)))["width"] == best


def test_covers_and_closures_by_brute_force(spark, make):
    import random
    from itertools import combinations
    rng = random.Random(9)
    names, studies = [f"T{i}" for i in range(10)], [f"S{i:02d}" for i in range(14)]
    held = {s: {t for t in names if rng.random() < 0.55} for s in studies}
    ev = make({t: [s for s in studies if t in held[s]] for t in names}, studies)

    def closed(themes):
        own = [held[s] for s in studies if set(themes) <= held[s]]
        return (tuple(sorted(set.intersection(*own))) if own else tuple(names)), len(own)
    intents = {closed(c)[0] for k in range(11) for c in combinations(names, k)}
    above = {(p, c) for p in intents for c in intents if set(p) < set(c)}
    covers = {(p, c) for p, c in above if not any((p, m) in above and (m, c) in above for m in intents)}
    found, edges = concepts._lattice(ev)
    by = {r["concept"]: tuple(r["intent"]) for r in found.collect()}
    assert set(by.values()) == intents and len(by) == len(intents)
    assert {(by[p], by[c]) for p, c in rows(edges, "parent", "child")} == covers
    given = [(str(k), rng.sample(names, k % 5)) for k in range(25)] + [("all", names)]
    got = {r["set_id"]: (tuple(r["closure"]), r["n_studies"]) for r in concepts.closures(
        ev, spark.createDataFrame(given, "set_id string, themes array<string>")).collect()}
    assert got == {k: closed(t) for k, t in given}
