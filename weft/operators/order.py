"""The subsumption order of themes: x below y when the studies of x are all in y."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..plans.lineage import cut
from ..plans.pairs import incidence, ordered_overlaps
from ..sources.documents import Evidence


def subsumption(ev: Evidence) -> DataFrame:
    """child, parent: the child's study set is non-empty and inside the parent's."""
    o = ordered_overlaps(incidence(ev.theme_studies), ev.themes)
    return (o.filter("inter = n_a").select(F.col("a").alias("child"), F.col("b").alias("parent"))
            .unionByName(o.filter("inter = n_b").select(F.col("b").alias("child"), F.col("a").alias("parent"))))


@dataclass
class Order:
    """classes: theme_id, rep (themes with equal non-empty study sets share the first
    theme by order); below: x, y strict pairs of reps; elements: rep."""

    classes: DataFrame
    below: DataFrame
    elements: DataFrame


def build_order(ev: Evidence) -> Order:
    subs = cut(subsumption(ev))
    equal = subs.join(subs.select(F.col("child").alias("parent"), F.col("parent").alias("child")), ["child", "parent"])
    ords = ev.themes.select(F.col("theme_id").alias("parent"), F.col("ord").alias("po"))
    first = (equal.join(ords, "parent").groupBy(F.col("child").alias("theme_id"))
             .agg(F.min(F.struct("po", "parent")).alias("m")))
    classes = cut(ev.themes.select("theme_id", "ord").join(first, "theme_id", "left").select(
        "theme_id", F.when(F.col("m.po") < F.col("ord"), F.col("m.parent")).otherwise(F.col("theme_id")).alias("rep")))
    elements = classes.filter("theme_id = rep").select("rep")
    below = (subs.join(elements.select(F.col("rep").alias("child")), "child", "left_semi")
             .join(elements.select(F.col("rep").alias("parent")), "parent", "left_semi")
             .join(equal.select("child", "parent"), ["child", "parent"], "left_anti"))
    return Order(classes, cut(below.select(F.col("child").alias("x"), F.col("parent").alias("y"))), elements)


def hasse_edges(order: Order) -> DataFrame:
    """parent, child without an element between."""
    lt = order.below
    through = lt.select("x", F.col("y").alias("z")).join(lt.select(F.col("x").alias("z"), "y"), "z").select("x", "y").distinct()
    return lt.join(through, ["x", "y"], "left_anti").select(F.col("y").alias("parent"), F.col("x").alias("child"))


def chains(order: Order, max_rounds: int = 10000) -> DataFrame:
    """x, y, k, n: number of strict chains of k steps from x up to y. One join per
    length; the longest length is the height."""
    level = cut(order.below.select("x", "y", F.lit(1).alias("k"), F.lit(1).cast("bigint").alias("n")))
    out = level
    for k in range(2, max_rounds + 1):
        if level.isEmpty():
            return out
        level = cut(level.select("x", F.col("y").alias("z"), "n")
                    .join(order.below.select(F.col("x").alias("z"), "y"), "z")
                    .groupBy("x", "y").agg(F.sum("n").alias("n")).select("x", "y", F.lit(k).alias("k"), "n"))
        out = out.unionByName(level)
    raise RuntimeError("order is higher than max_rounds")


def moebius(order: Order, chain_counts: DataFrame) -> DataFrame:
    """x, y, mu for x <= y: the alternating sum of chain counts by length."""
    sign = F.when(F.col("k") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    strict = chain_counts.groupBy("x", "y").agg(F.sum(sign * F.col("n")).alias("mu"))
    return strict.unionByName(order.elements.select(F.col("rep").alias("x"), F.col("rep").alias("y"),
                                                    F.lit(1).cast("bigint").alias("mu")))


def ranks(order: Order, chain_counts: DataFrame) -> DataFrame:
    """theme_id, rank: length of the longest chain below."""
    up = chain_counts.groupBy(F.col("y").alias("rep")).agg(F.max("k").alias("rank"))
    return order.elements.join(up, "rep", "left").select(
        F.col("rep").alias("theme_id"), F.coalesce("rank", F.lit(0)).alias("rank"))


def _least_bounds(leq: DataFrame, low: str, high: str) -> DataFrame:
    """Pairs a < b that have a least common bound above (or the greatest one below,
    with the roles swapped)."""
    r = leq.select(F.col(low).alias("e"), F.col(high).alias("u"))
    bounds = r.select(F.col("e").alias("a"), "u").join(r.select(F.col("e").alias("b"), "u"), "u").filter("a < b")
    total = bounds.groupBy("a", "b").agg(F.count("*").alias("total"))
    met = (bounds.join(r.select(F.col("e").alias("u"), F.col("u").alias("v")), "u")
           .join(bounds.select("a", "b", F.col("u").alias("v")), ["a", "b", "v"])
           .groupBy("a", "b", "u").agg(F.count("*").alias("n")))
    return met.join(total, ["a", "b"]).filter("n = total").select("a", "b").distinct()


def _paths(edges: DataFrame, match: DataFrame, free: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees of alternating paths from all free left elements at once, up to the first layer that meets free
    right ones: ``steps`` (r, l, root), each right element in one tree, and ``ends`` (root, r)."""
    front, steps = free.select("l", F.col("l").alias("root")), None
    while True:
        met = front.join(edges, "l")
        met = met if steps is None else met.join(steps.select("r"), "r", "left_anti")
        layer = cut(met.groupBy("r").agg(F.min(F.struct("root", "l")).alias("m")).select("r", "m.l", "m.root"))
        steps = layer if steps is None else steps.unionByName(layer)
        if layer.isEmpty():
            return steps, layer.select("root", "r")
        ends = cut(layer.join(match.select("r"), "r", "left_anti").groupBy("root").agg(F.min("r").alias("r")))
        if not ends.isEmpty():
            return steps, ends
        front = layer.select("r", "root").join(match, "r").select("l", "root")


def width(order: Order) -> DataFrame:
    """One row, width: the exact size of the largest set of incomparable elements.

    It is the least number of chains that cover the order (Dilworth), which is the elements less
    a largest matching of the order as a bipartite graph (lower side, upper side). The matching grows
    in rounds: from all unmatched lower elements alternating paths grow at once, every upper
    element in one tree, and each tree that meets an unmatched upper element turns one path around.
    A round without such an element ends it."""
    edges = cut(order.below.select(F.col("x").alias("l"), F.col("y").alias("r")))
    match = cut(edges.limit(0))
    while True:
        free = edges.select("l").distinct().join(match.select("l"), "l", "left_anti")
        steps, ends = _paths(edges, match, free)
        if ends.isEmpty():
            return order.elements.agg((F.count("*") - match.count()).alias("width"))
        at, added, dropped = ends, None, None
        while not at.isEmpty():
            new = cut(at.join(steps, ["root", "r"]).select("root", "l", "r"))
            old = new.filter("l <> root").select("root", "l").join(match, "l").select("root", "l", "r")
            added = new if added is None else added.unionByName(new)
            dropped = old if dropped is None else dropped.unionByName(old)
            at = cut(old.select("root", "r"))
        match = cut(match.join(dropped.select("l", "r"), ["l", "r"], "left_anti").unionByName(added.select("l", "r")))


def order_summary(order: Order, chain_counts: DataFrame) -> DataFrame:
    """One row: elements, comparable pairs, density, height, exact width (largest antichain),
    whether it is a lattice, multichain counts 1 to 3."""
    leq = order.below.unionByName(order.elements.select(F.col("rep").alias("x"), F.col("rep").alias("y")))
    n = order.elements.count()
    pairs = n * (n - 1) // 2
    joins = _least_bounds(leq, "x", "y").agg(F.count("*")).scalar()
    meets = _least_bounds(leq, "y", "x").agg(F.count("*")).scalar()
    zeta3 = leq.select("x", F.col("y").alias("z")).join(leq.select(F.col("x").alias("z"), "y"), "z").agg(F.count("*")).scalar()
    level = width(order).scalar()
    height = chain_counts.agg(F.coalesce(F.max("k"), F.lit(0))).scalar()
    return order.below.agg(F.count("*").alias("comparable_pairs")).select(
        F.lit(n).cast("bigint").alias("zeta1"), (F.col("comparable_pairs") + n).alias("zeta2"),
        zeta3.alias("zeta3"), "comparable_pairs",
        safe_div("comparable_pairs", F.lit(pairs)).alias("density"),
        height.cast("bigint").alias("height"), level.alias("width"),
        ((joins == pairs) & (meets == pairs)).alias("is_lattice"))


def order_report(ev: Evidence) -> dict[str, DataFrame]:
    order = build_order(ev)
    counts = chains(order)
    return {"classes": order.classes, "hasse_edges": hasse_edges(order), "moebius": moebius(order, counts),
            "ranks": ranks(order, counts), "summary": order_summary(order, counts)}
