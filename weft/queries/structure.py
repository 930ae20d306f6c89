"""Queries over the theme network, the subsumption order, concepts and arrows."""

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import category, concepts, network, order
from ..plans.lineage import cut
from ..plans.pairs import theme_pairs
from ..sources import tables
from .registry import query
from .views import CUSTOMERS, EVENTS, ORDERS
from .views import r6 as R

_OV = """ov AS (SELECT x.theme_id AS a, y.theme_id AS b, count(*) AS inter FROM ts x JOIN ts y ON x.study_id = y.study_id
  AND x.theme_id <> y.theme_id GROUP BY 1, 2),
sz AS (SELECT theme_id, count(*) AS n FROM ts GROUP BY 1)"""


@query("theme_cooccurrence", f"""WITH {ORDERS} SELECT x.theme_id AS a, y.theme_id AS b, count(*) AS shared
FROM ts x JOIN ts y ON x.study_id = y.study_id AND x.theme_id <= y.theme_id GROUP BY 1, 2""")
def theme_cooccurrence(spark, folder):
    return network.cooccurrence(network.theme_incidence(tables.orders_evidence(spark, folder)))


_PATHS = f"""{CUSTOMERS}, {_OV}, e AS (SELECT a AS src, b AS dst FROM ov),
walk(s, v, d) AS (SELECT theme_id, theme_id, 0 FROM th UNION SELECT s, dst, d + 1 FROM walk JOIN e ON src = v WHERE d < 4),
dist AS (SELECT s, v, min(d) AS d FROM walk GROUP BY 1, 2),
sp(s, v, d) AS (SELECT theme_id, theme_id, 0 FROM th UNION ALL SELECT sp.s, dst, sp.d + 1 FROM sp JOIN e ON src = sp.v
  JOIN dist ON dist.s = sp.s AND dist.v = dst AND dist.d = sp.d + 1),
sigma AS (SELECT s, v, d, count(*)::DOUBLE AS n FROM sp GROUP BY 1, 2, 3),
k AS (SELECT count(*)::DOUBLE AS k FROM th),
deg AS (SELECT theme_id, count(dst) AS degree, count(dst) / (any_value(k.k) - 1) AS centrality FROM th LEFT JOIN e ON src = theme_id, k GROUP BY 1),
bt AS (SELECT th.theme_id, coalesce(sum(a.n * b.n / c.n), 0) / ((any_value(k.k) - 1) * (any_value(k.k) - 2)) AS betweenness FROM k, th LEFT JOIN
  (sigma a JOIN sigma b ON a.v = b.s AND a.s <> a.v AND b.s <> b.v AND a.s <> b.v JOIN sigma c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d)
  ON a.v = th.theme_id GROUP BY 1)"""


def _graph(spark, folder):
    ev = tables.customers_evidence(spark, folder)
    return ev, cut(network.adjacency(network.theme_incidence(ev)))


@query("degree_centrality", f"WITH RECURSIVE {_PATHS} SELECT theme_id, degree, {R('centrality')} AS centrality FROM deg")
def degree_centrality(spark, folder):
    ev, edges = _graph(spark, folder)
    return network.degree_centrality(ev.themes, edges).withColumn("centrality", r6("centrality"))


@query("hop_distances", f"WITH RECURSIVE {_PATHS} SELECT s AS source, v AS node, d AS dist, n::BIGINT AS paths FROM sigma")
def hop_distances(spark, folder):
    ev, edges = _graph(spark, folder)
    return network.shortest_paths(ev.themes, edges).select("source", "node", "dist", F.col("sigma").cast("bigint").alias("paths"))


@query("closeness_centrality", f"""WITH RECURSIVE {_PATHS} SELECT th.theme_id, {R('coalesce(1 / avg(d) FILTER (d > 0), 0)')} AS closeness
FROM th LEFT JOIN dist ON s = theme_id GROUP BY 1""")
def closeness_centrality(spark, folder):
    ev, edges = _graph(spark, folder)
    return network.closeness_centrality(ev.themes, network.shortest_paths(ev.themes, edges)).withColumn("closeness", r6("closeness"))


@query("betweenness_centrality", f"WITH RECURSIVE {_PATHS} SELECT theme_id, {R('betweenness')} AS betweenness FROM bt")
def betweenness_centrality(spark, folder):
    ev, edges = _graph(spark, folder)
    paths = network.shortest_paths(ev.themes, edges)
    return network.betweenness_centrality(ev.themes, edges, paths).withColumn("betweenness", r6("betweenness"))


@query("bridging_themes", f"""WITH RECURSIVE {_PATHS}, m AS (SELECT list_sort(list(round(betweenness, 12)))[CAST(floor(count(*) / 2) AS INT) + 1] AS b FROM bt),
d AS (SELECT list_sort(list(round(centrality, 12)))[CAST(floor(count(*) / 2) AS INT) + 1] AS c FROM deg)
SELECT bt.theme_id FROM bt JOIN deg ON deg.theme_id = bt.theme_id, m, d WHERE round(betweenness, 12) > b AND round(centrality, 12) <= c""")
def bridging_themes(spark, folder):
    ev, edges = _graph(spark, folder)
    paths = network.shortest_paths(ev.themes, edges)
    return network.bridging_themes(network.degree_centrality(ev.themes, edges),
                                   network.betweenness_centrality(ev.themes, edges, paths))


@query("modularity", f"""WITH {CUSTOMERS}, {_OV}, c AS (SELECT theme_id, coalesce(CASE WHEN parent_id = 'WORLD' THEN theme_id ELSE parent_id END, theme_id) AS c FROM th),
h AS (SELECT x.c AS x, y.c AS y FROM ov JOIN c x ON x.theme_id = a JOIN c y ON y.theme_id = b WHERE a < b),
m AS (SELECT count(*)::DOUBLE AS m FROM h),
p AS (SELECT c, count(*) AS ends, sum(i) / 2 AS l FROM (SELECT x AS c, (x = y)::INT AS i FROM h UNION ALL SELECT y, (x = y)::INT FROM h) GROUP BY 1)
SELECT {R('sum(2 * l / m - (ends / (2 * m)) ** 2)')} AS modularity, {R('sum(l / m - (ends / (2 * m)) ** 2)')} AS modularity_newman FROM p, m""")
def modularity(spark, folder):
    ev, edges = _graph(spark, folder)
    parent = F.when(F.col("parent_id") == "WORLD", F.col("theme_id")).otherwise(F.col("parent_id"))
    groups = ev.themes.select("theme_id", F.coalesce(parent, "theme_id").alias("community"))
    return network.modularity(edges, groups).select(*[r6(c).alias(c) for c in ("modularity", "modularity_newman")])


@query("communities")
def communities(spark, folder):
    ev, edges = _graph(spark, folder)
    return network.communities(ev.themes, edges)


# --- order --------------------------------------------------------------------

_SUBS = f"""{CUSTOMERS}, {_OV}, sub AS (SELECT a AS child, b AS parent FROM ov JOIN sz ON theme_id = a WHERE inter = n),
rep AS (SELECT th.theme_id, coalesce((SELECT arg_min(t2.theme_id, t2.ord) FROM th t2 WHERE t2.theme_id = th.theme_id OR
   ((th.theme_id, t2.theme_id) IN (SELECT child, parent FROM sub) AND (t2.theme_id, th.theme_id) IN (SELECT child, parent FROM sub))), th.theme_id) AS rep FROM th),
el AS (SELECT DISTINCT rep FROM rep),
lt AS (SELECT child AS x, parent AS y FROM sub WHERE child IN (SELECT rep FROM el) AND parent IN (SELECT rep FROM el)
  AND (parent, child) NOT IN (SELECT child, parent FROM sub)),
leq AS (SELECT x, y FROM lt UNION ALL SELECT rep, rep FROM el),
ch(x, y, k) AS (SELECT x, y, 1 FROM lt UNION ALL SELECT ch.x, lt.y, k + 1 FROM ch JOIN lt ON lt.x = ch.y)"""


@query("subsumption", f"WITH {CUSTOMERS}, {_OV} SELECT a AS child, b AS parent FROM ov JOIN sz ON theme_id = a WHERE inter = n")
def subsumption(spark, folder):
    return order.subsumption(tables.customers_evidence(spark, folder))


@query("hasse_edges", f"""WITH RECURSIVE {_SUBS} SELECT y AS parent, x AS child FROM lt WHERE NOT EXISTS
  (SELECT 1 FROM lt p JOIN lt q ON p.y = q.x WHERE p.x = lt.x AND q.y = lt.y)""")
def hasse_edges(spark, folder):
    return order.hasse_edges(order.build_order(tables.customers_evidence(spark, folder)))


@query("moebius", f"""WITH RECURSIVE {_SUBS} SELECT x, y, sum(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS mu FROM ch GROUP BY 1, 2
  UNION ALL SELECT rep, rep, 1 FROM el""")
def moebius(spark, folder):
    o = order.build_order(tables.customers_evidence(spark, folder))
    return order.moebius(o, order.chains(o))


@query("order_ranks", f"WITH RECURSIVE {_SUBS} SELECT rep AS theme_id, coalesce(max(k), 0) AS rank FROM el LEFT JOIN ch ON y = rep GROUP BY rep")
def order_ranks(spark, folder):
    o = order.build_order(tables.customers_evidence(spark, folder))
    return order.ranks(o, order.chains(o))


_BOUNDS = """up AS (SELECT p.x AS a, q.x AS b, p.y AS u FROM leq p JOIN leq q ON p.y = q.y WHERE p.x < q.x),
least AS (SELECT a, b FROM up s WHERE NOT EXISTS (SELECT 1 FROM up o WHERE o.a = s.a AND o.b = s.b AND (s.u, o.u) NOT IN (SELECT x, y FROM leq))),
down AS (SELECT p.y AS a, q.y AS b, p.x AS u FROM leq p JOIN leq q ON p.x = q.x WHERE p.y < q.y),
greatest AS (SELECT a, b FROM down s WHERE NOT EXISTS (SELECT 1 FROM down o WHERE o.a = s.a AND o.b = s.b AND (o.u, s.u) NOT IN (SELECT x, y FROM leq)))"""


@query("zeta_values", f"""WITH RECURSIVE {_SUBS}, {_BOUNDS}, n AS (SELECT count(*) AS n FROM el), r AS (SELECT rep, coalesce(max(k), 0) AS r FROM el LEFT JOIN ch ON y = rep GROUP BY rep)
SELECT n AS zeta1, (SELECT count(*) FROM leq) AS zeta2, (SELECT count(*) FROM leq p JOIN leq q ON p.y = q.x) AS zeta3,
 (SELECT count(*) FROM lt) AS comparable_pairs, {R('(SELECT count(*) FROM lt) / (n * (n - 1) / 2.0::DOUBLE)')} AS density,
 (SELECT max(k) FROM ch)::BIGINT AS height, (SELECT max(c) FROM (SELECT count(*) AS c FROM r GROUP BY r.r)) AS width,
 (SELECT count(*) = 0 FROM el a JOIN el b ON a.rep < b.rep WHERE
   (a.rep, b.rep) NOT IN (SELECT a, b FROM least) OR (a.rep, b.rep) NOT IN (SELECT a, b FROM greatest)) AS is_lattice FROM n""")
def zeta_values(spark, folder):
    o = order.build_order(tables.customers_evidence(spark, folder))
    return order.order_summary(o, order.chains(o)).withColumn("density", r6("density"))


# --- concepts -----------------------------------------------------------------

_MASKS = f"""{EVENTS}, bits AS (SELECT theme_id, 1 << (row_number() OVER (ORDER BY theme_id) - 1)::INT AS bit FROM th),
obj AS (SELECT st.study_id, coalesce(sum(bit), 0)::INT AS mask FROM st LEFT JOIN ts ON ts.study_id = st.study_id LEFT JOIN bits ON bits.theme_id = ts.theme_id GROUP BY 1),
cls AS (SELECT mask, count(*) AS n FROM obj GROUP BY 1),
sub AS (SELECT s, bit_and(mask) AS intent, sum(n) AS n FROM (SELECT mask, n, unnest(range(4096))::INT AS s FROM cls) WHERE mask & s = s GROUP BY s),
con AS (SELECT DISTINCT intent, n FROM sub UNION SELECT 4095, 0 WHERE NOT EXISTS (SELECT 1 FROM cls WHERE mask = 4095))"""


@query("formal_concepts", f"""WITH {_MASKS} SELECT coalesce((SELECT string_agg(theme_id, ',' ORDER BY theme_id) FROM bits WHERE bit & intent = bit), '') AS intent,
  n::BIGINT AS n_studies FROM con""")
def formal_concepts(spark, folder):
    return concepts.formal_concepts(tables.events_evidence(spark, folder)).select(
        F.array_join("intent", ",").alias("intent"), "n_studies")


@query("concept_lattice", f"""WITH RECURSIVE {_MASKS}, lt AS (SELECT x.intent AS x, y.intent AS y FROM con x JOIN con y ON x.intent <> y.intent AND x.intent & y.intent = y.intent),
cov AS (SELECT x, y FROM lt WHERE NOT EXISTS (SELECT 1 FROM lt p JOIN lt q ON p.y = q.x WHERE p.x = lt.x AND q.y = lt.y)),
ch(y, k) AS (SELECT y, 1 FROM cov UNION SELECT cov.y, k + 1 FROM ch JOIN cov ON cov.x = ch.y),
r AS (SELECT intent, coalesce(max(k), 0) AS r FROM con LEFT JOIN ch ON ch.y = con.intent GROUP BY 1)
SELECT (SELECT count(*) FROM con) AS n_concepts, (SELECT max(r) FROM r)::BIGINT AS height,
 (SELECT max(c) FROM (SELECT count(*) AS c FROM r GROUP BY r)) AS width, (SELECT count(*) FROM cov) AS n_edges""")
def concept_lattice(spark, folder):
    report = concepts.concept_report(tables.events_evidence(spark, folder))
    edges = report["edges"].agg(F.count("*")).scalar()
    return report["summary"].select("n_concepts", F.col("height").cast("bigint").alias("height"), "width",
                                    edges.alias("n_edges"))


@query("closure_of", f"""WITH {_MASKS}, g AS (SELECT 0::INT AS s, '' AS given UNION ALL SELECT bit, theme_id FROM bits
  UNION ALL SELECT x.bit | y.bit, x.theme_id || ',' || y.theme_id FROM bits x JOIN bits y ON x.theme_id < y.theme_id)
SELECT given, coalesce((SELECT string_agg(theme_id, ',' ORDER BY theme_id) FROM bits WHERE bit & coalesce(sub.intent, 4095) = bit), '') AS closure,
  coalesce(sub.n, 0)::BIGINT AS n_studies FROM g LEFT JOIN sub ON sub.s = g.s""")
def closure_of(spark, folder):
    """The closures of the empty set, of every theme and of every two themes."""
    ev = tables.events_evidence(spark, folder)
    two = theme_pairs(ev.themes).select(F.array_sort(F.array("a", "b")).alias("themes"))
    one = ev.themes.select(F.array("theme_id").alias("themes"))
    given = two.unionByName(one).unionByName(one.select(F.slice("themes", 1, 0).alias("themes")).distinct()).select(
        F.array_join("themes", ",").alias("set_id"), "themes")
    return concepts.closures(ev, given).select(F.col("set_id").alias("given"), F.array_join("closure", ",").alias("closure"), "n_studies")


@query("concept_covers", f"""WITH {_MASKS}, lt AS (SELECT x.intent AS x, y.intent AS y FROM con x JOIN con y ON x.intent <> y.intent AND x.intent & y.intent = y.intent),
cov AS (SELECT x, y FROM lt WHERE NOT EXISTS (SELECT 1 FROM lt p JOIN lt q ON p.y = q.x WHERE p.x = lt.x AND q.y = lt.y)),
nm AS (SELECT intent, coalesce((SELECT string_agg(theme_id, ',' ORDER BY theme_id) FROM bits WHERE bit & intent = bit), '') AS name FROM con)
SELECT p.name AS parent, c.name AS child FROM cov JOIN nm p ON p.intent = y JOIN nm c ON c.intent = x""")
def concept_covers(spark, folder):
    """The intents of neighbouring concepts."""
    report = concepts.concept_report(tables.events_evidence(spark, folder))
    names = report["concepts"].select("concept", F.array_join("intent", ",").alias("name"))
    return report["edges"].join(names.toDF("parent", "p"), "parent").join(names.toDF("child", "c"), "child").select(
        F.col("p").alias("parent"), F.col("c").alias("child"))


@query("implications", f"""WITH {_MASKS}, a AS (SELECT s, intent, n FROM sub WHERE s > 0)
SELECT (SELECT string_agg(theme_id, ',' ORDER BY theme_id) FROM bits b2 WHERE b2.bit & s = b2.bit) AS antecedent,
 bits.theme_id AS consequent, n::BIGINT AS support FROM a JOIN bits ON bit & intent = bit AND bit & s = 0""")
def implications(spark, folder):
    return concepts.implications(tables.events_evidence(spark, folder), None).select(
        F.array_join("antecedent", ",").alias("antecedent"), "consequent", "support")


# --- arrows -------------------------------------------------------------------

@query("morphisms", f"""WITH {CUSTOMERS}, {_OV} SELECT theme_id AS source, theme_id AS target FROM th
 UNION ALL SELECT a, b FROM ov JOIN sz ON theme_id = a WHERE inter = n
 UNION ALL SELECT x.theme_id, y.theme_id FROM th x JOIN th y ON x.theme_id <> y.theme_id WHERE x.theme_id NOT IN (SELECT theme_id FROM sz)""")
def morphisms(spark, folder):
    return category.morphisms(tables.customers_evidence(spark, folder))


@query("products", f"""WITH {ORDERS}, {_OV} SELECT a, b, inter AS n_studies FROM ov JOIN th x ON x.theme_id = a JOIN th y ON y.theme_id = b WHERE x.ord < y.ord""")
def products(spark, folder):
    return category.products(tables.orders_evidence(spark, folder))


@query("product_members", f"""WITH {ORDERS} SELECT p.theme_id AS a, q.theme_id AS b, p.study_id FROM ts p JOIN ts q ON p.study_id = q.study_id
  JOIN th x ON x.theme_id = p.theme_id JOIN th y ON y.theme_id = q.theme_id WHERE x.ord < y.ord""")
def product_members(spark, folder):
    return category.product_members(tables.orders_evidence(spark, folder))


@query("coproducts", f"""WITH {CUSTOMERS}, {_OV}, s AS (SELECT th.theme_id, ord, coalesce(n, 0) AS n FROM th LEFT JOIN sz ON sz.theme_id = th.theme_id)
SELECT x.theme_id AS a, y.theme_id AS b, x.n + y.n - coalesce(inter, 0) AS n_studies FROM s x JOIN s y ON x.ord < y.ord
LEFT JOIN ov ON a = x.theme_id AND b = y.theme_id""")
def coproducts(spark, folder):
    return category.coproducts(tables.customers_evidence(spark, folder))


@query("coproduct_members", f"""WITH {CUSTOMERS}, p AS (SELECT x.theme_id AS a, y.theme_id AS b FROM th x JOIN th y ON x.ord < y.ord)
SELECT a, b, study_id FROM p JOIN ts ON ts.theme_id = a UNION SELECT a, b, study_id FROM p JOIN ts ON ts.theme_id = b""")
def coproduct_members(spark, folder):
    return category.coproduct_members(tables.customers_evidence(spark, folder))


@query("iso_classes", f"""WITH {CUSTOMERS}, s AS (SELECT th.theme_id, ord, list_sort(list(study_id)) AS l FROM th LEFT JOIN ts ON ts.theme_id = th.theme_id GROUP BY 1, 2)
SELECT theme_id, arg_min(theme_id, ord) OVER (PARTITION BY l) AS representative FROM s""")
def iso_classes(spark, folder):
    return category.isomorphism_classes(tables.customers_evidence(spark, folder))


@query("universal_objects", f"""WITH {CUSTOMERS}, {_OV}, m AS (SELECT theme_id AS s FROM th UNION ALL SELECT a FROM ov JOIN sz ON theme_id = a WHERE inter = n),
u AS (SELECT s, count(*) AS c FROM m GROUP BY s)
SELECT (SELECT arg_min(th.theme_id, ord) FROM th JOIN sz ON sz.theme_id = th.theme_id WHERE n = (SELECT count(DISTINCT study_id) FROM ts)) AS terminal,
 (SELECT arg_min(theme_id, ord) FROM th JOIN u ON s = theme_id WHERE c = (SELECT count(*) FROM th)) AS initial""")
def universal_objects(spark, folder):
    return category.universal_objects(tables.customers_evidence(spark, folder))


@query("adjunction_score", f"WITH {CUSTOMERS} SELECT {R('(SELECT count(DISTINCT theme_id) FROM ts) / (SELECT count(*) FROM th)::DOUBLE')} AS adjunction_score")
def adjunction_score(spark, folder):
    return category.adjunction_score(tables.customers_evidence(spark, folder)).select(
        r6("adjunction_score").alias("adjunction_score"))
