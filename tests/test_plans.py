"""Running sums and pairs under outliers and heavy values."""

import random

from conftest import rows
from pyspark.sql import functions as F

from weft.operators.network import communities
from weft.plans.blocks import paired_within
from weft.plans.components import star_roots
from weft.plans.prefix import numbered, running_sums


def test_running_sums_with_an_outlier_and_a_heavy_value(spark):
    rng = random.Random(3)
    made = [(i, 10 ** 15 if i == 7 else 5 if rng.random() < 0.9 else rng.randint(0, 50), rng.randint(1, 9)) for i in range(3000)]
    df = spark.createDataFrame(made, "id bigint, o bigint, v bigint").repartition(7)
    total, want = 0, {}
    for i, _, v in sorted(made, key=lambda r: (r[1], r[0])):
        total += v
        want[i] = total
    assert dict(rows(running_sums(df, "o", {"s": F.col("v")}, tie=["id"]), "id", "s")) == want
    places = numbered(df, "o", "p", tie=["id"])
    assert [r[0] for r in sorted(rows(places, "id", "p"), key=lambda r: r[1])] == [r[0] for r in sorted(made, key=lambda r: (r[1], r[0]))]
    assert rows(numbered(df, "o", "p", by=["v"], tie=["id"]).groupBy("v").agg(F.max("p").alias("m")), "v", "m") == sorted(
        (v, sum(r[2] == v for r in made)) for v in {r[2] for r in made})


def test_pairs_of_a_key_over_several_blocks(spark):
    items = [("hot", i) for i in range(60)] + [("cold", i) for i in (1, 5, 9)]
    got = rows(paired_within(spark.createDataFrame(items, "k string, i bigint"), "k", "i", block=7), "k", "a", "b")
    want = [("hot", a, b) for a in range(60) for b in range(a + 1, 60)] + [("cold", 1, 5), ("cold", 1, 9), ("cold", 5, 9)]
    assert got == sorted(want)


def estimate(df):
    """The planner's idea of a table's bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_rounds_start_from_tables_of_their_own_size(spark):
    """A round that starts from the last one's estimate has an estimate of three times as many digits: a chain of merges ends the driver."""
    names = spark.createDataFrame([(f"t{i}",) for i in range(7)], "theme_id string")
    hub = spark.createDataFrame([x for i in range(1, 7) for x in [("t0", f"t{i}"), (f"t{i}", "t0")]], "src string, dst string")
    groups = communities(names, hub)
    assert estimate(groups) < 10 ** 6
    assert dict(rows(groups)) == {f"t{i}": "t0" for i in range(7)}
    roots = star_roots(spark.range(40).select((F.col("id") + 1).alias("a"), F.col("id").alias("b")))
    assert estimate(roots) < 10 ** 6
    assert rows(roots, "node", "root") == [(i, 0) for i in range(41)]
