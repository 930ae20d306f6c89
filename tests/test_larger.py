"""What shows only in larger tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from check_oracle import TABLES, compare
from weft.functions.columns import log_factorial
from weft.operators.argument import unit_themes
from weft.operators.temporal import influence_degree
from weft.plans.codebook import containing, shared_words
from weft.queries import learned

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def late_events(tmp_path_factory):
    """Tables with events in the last half second of a day, which large tables have a few of."""
    folder = tmp_path_factory.mktemp("late")
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN date_trunc('day', ts) + INTERVAL '86399.7 seconds'
        WHEN event_id % 7 = 1 THEN date_trunc('day', ts) + INTERVAL '86399.4 seconds' ELSE ts END AS ts)
        FROM '{SMALL}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)""")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder if t == 'events' else SMALL}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["closure_of", "rarefaction", "formal_concepts"])
def test_days_of_events_as_in_sql(spark, late_events, name):
    folder, con = late_events
    assert compare(spark, con, name, folder)[0].startswith("ok")


def test_log_factorials_as_in_c(spark):
    """Bit for bit, since a million studies leave only ten digits of a difference of these."""
    ours = spark.range(1, 3_000_000, 9_973).select("id", log_factorial(F.col("id")).alias("l")).collect()
    con = duckdb.connect()
    wrong = [r for r in ours if r["id"] >= 32 and con.execute("SELECT lgamma(?::DOUBLE)", [r["id"] + 1.0]).fetchone()[0] != r["l"]]
    assert not wrong


def test_mentions_leave_their_texts(spark, make):
    """A text is not shuffled to tell its mentions apart, and a theme of both the study and the text comes once."""
    ev = make({"A": ["s1"], "B": []}, ["s1", "s2"], labels={"A": "alpha", "B": "beta"})
    units = spark.createDataFrame([("s1", 0, 0, "claim", "Alpha beta alpha"), ("s2", 0, 0, "evidence", "ALPHA"), ("s2", 0, 1, "claim", "none")],
                                  "study_id string, part int, unit int, type string, text string")
    words = spark.createDataFrame([("A", "alpha"), ("A", "alph"), ("B", "beta")], "theme_id string, word string")
    met = containing(units, words)
    assert "text" not in met.columns
    assert sorted(tuple(r) for r in met.collect()) == [("s1", 0, 0, "claim", "A"), ("s1", 0, 0, "claim", "B"), ("s2", 0, 0, "evidence", "A")]
    assert sorted(tuple(r) for r in unit_themes(ev, units).collect()) == [
        ("s1", 0, 0, "claim", "A"), ("s1", 0, 0, "claim", "B"), ("s2", 0, 0, "evidence", "A")]


def test_equal_cliques_are_relabelled_once(spark, monkeypatch, tmp_path):
    """Orders of one set of brands hand one graph to the relabelling, and each has its row."""
    spark.createDataFrame([(k, f"Brand#{k}") for k in range(1, 5)], "p_partkey bigint, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(o, p) for o in range(30) for p in ((1, 2, 3, 3) if o % 3 else (4, 2))],
                          "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS o_orderkey, DATE'2020-01-01' AS o_orderdate, '1' AS o_orderpriority FROM range(30)").write.parquet(f"{tmp_path}/orders.parquet")
    seen, whole = [], learned.kernels.wl_histogram
    monkeypatch.setattr(learned.kernels, "wl_histogram", lambda nodes, edges: seen.append((nodes.count(), edges.count())) or whole(nodes, edges))
    got = sorted(tuple(r) for r in learned.wl_histogram(spark, str(tmp_path)).select("graph", "labels", "total").collect())
    assert got == [(o, 4 * k, 4 * k) for o in range(30) for k in [3 if o % 3 else 2]]
    assert seen == [(5, 8)]


def test_words_of_texts_are_not_shuffled_to_meet_a_short_book(spark):
    """A short book is sent to the texts, wherever its rows came from."""
    said = spark.createDataFrame([("s1", ["alpha", "beta", "alpha"]), ("s2", ["gamma"])], "study_id string, words array<string>")
    book = spark.createDataFrame([("A", "alpha"), ("B", "beta")], "theme_id string, word string")
    met = shared_words(said, "words", book)
    assert "SortMergeJoin" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in met.collect()) == [("s1", "A"), ("s1", "B")]


def test_influence_over_many_years_and_none(spark, make):
    """More years than are summed at once, and studies without a year, which are neither earlier nor later."""
    names = [f"s{i}" for i in range(60)]
    years = {s: None if i % 9 == 4 else 1990 + i * 7 % 40 for i, s in enumerate(names)}
    held = {f"T{k}": [s for i, s in enumerate(names) if (i * i + 3 * k) % (k + 2) == 0] for k in range(7)}
    ev = make(held, names, years=years)
    of = {s: {t for t, ss in held.items() if s in ss} for s in names}
    want = {s: sum(years[s] is not None and years[o] is not None and years[s] < years[o] and bool(of[s] & of[o]) for o in names) for s in names}
    for narrow in (12, 3):
        assert {r["study_id"]: r["degree"] for r in influence_degree(ev, narrow).collect()} == want
