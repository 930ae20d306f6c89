"""Nulls, empty tables, repeated rows, long texts and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from weft.llm import (alignment, chunk_dedup, collocation, forest, language, line_crf, line_rules, mixing, packing, secret_scan,
                      sharding, simhash, substring_dedup)

LONG = "\n".join(f"line {i} of a very long text, with word{i % 700} and token = \"k{i:06d}x\"" for i in range(6000))
ROWS = [(1, "one two three four five six\nseven eight nine", "en", "a", 3, 9, "x"), (2, None, "en", "a", None, 8, None), (3, "", None, None, 0, 7, "y"),
        (None, "one two three four five six\nseven eight nine", None, "b", 1, None, "z"), (None, None, None, None, None, None, None),
        (5, " \n\t ", "fr", "", 4, 1, "w"), (6, LONG, "en", "b", len(LONG), 2, "v"), (7, "same", "fr", "b", 4, 3, "u"), (7, "same", "fr", "b", 4, 3, "u")]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, row string"


def of_language(docs):
    return language.labelled(docs, language.learned(docs.filter(~language.held_out(F.col("doc_id")))))


def of_quality(docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return line_crf.scored(docs, line_crf.learned(docs, labels))


PER_ROW = {"secrets": secret_scan.scanned, "shards": sharding.interleaved, "mix": mixing.rates, "rules": line_rules.judged,
           "chunks": chunk_dedup.deduplicated, "simhash": simhash.near_duplicates, "language": of_language, "quality": of_quality,
           "alignment": alignment.alignment, "substrings": substring_dedup.deduplicated}
PER_TABLE = {"packing": packing.packed, "cleaned": line_rules.cleaned, "mixed": mixing.mixed,
             "without_repeats": chunk_dedup.without_repeats, "one_of_each": simhash.one_of_each,
             "collocations": collocation.collocations}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_document(docs, name):
    ids = sorted((r["doc_id"] for r in PER_ROW[name](docs).select("doc_id").collect()), key=str)
    assert ids == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", PER_ROW | PER_TABLE)
def test_empty_table(docs, name):
    got = (PER_ROW | PER_TABLE)[name](docs.filter("false"))
    assert got.collect() == [] and got.columns


@pytest.mark.parametrize("name", ["cleaned", "mixed", "without_repeats", "one_of_each"])
def test_stages_keep_the_columns(docs, name):
    got = PER_TABLE[name](docs)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} <= {r[0] for r in ROWS}


def test_vectors(spark):
    v = [0.3, 0.4, 0.5]
    rows = [(1, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [float("nan"), 1.0, 0.0], 1), (7, [None, 1.0, 2.0], 1),
            (8, [], 1), (9, [0.3, 0.4], 1), (10, v, 2), (None, v, 1), (11, [1e308, 1e308, 0.0], 3), (12, [1.0, 1.0, 0.0], 3), (2, v, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in forest.near_duplicates(df).collect()), key=str)
    lone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)]
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (None, 3, 1, False), (11, 1, 11, True), (12, 1, 11, False), *lone]
    assert got == sorted(want, key=str)
    assert forest.near_duplicates(df.filter("false")).collect() == []


MEGA = 1_000_000
RUNS = ["ab-" * (MEGA // 3), "1-" * (MEGA // 2), "=" * MEGA, "a1-" * (MEGA // 3), "A/" * (MEGA // 2) + "9", "z" * MEGA, "0" * MEGA, "f0" * (MEGA // 2)]


def test_unbroken_runs(spark):
    """Runs of a megabyte of every class: a pattern that recurses would end the executor."""
    docs = spark.createDataFrame(list(enumerate(RUNS)), "doc_id bigint, text string").repartition(8)
    got = {r["doc_id"]: (r["base"], r["extra"]) for r in secret_scan.scanned(docs).collect()}
    assert [len(got[i][0]) for i in range(len(RUNS))] == [0, 0, 0, 0, 0, 0, 1, 1]
    assert all(not got[i][1] for i in range(len(RUNS)))
    assert len(packing.packed(docs).filter("piece = 0").collect()) == len(RUNS)
    assert len(substring_dedup.deduplicated(docs).collect()) == len(RUNS)


def test_letters_of_all_planes(spark):
    texts = ["\U000E0100" * 5, "\U000F0000", "\U0010FFFD x", "𐐨𐐨 𐐨", "1234 !?", "plain words of some text"]
    learned_from = [(10 + i, "plain words of some text " * 3, "en") for i in range(20)] + [(40 + i, "einige deutsche Wörter und Sätze " * 3, "de") for i in range(20)]
    model = language.learned(spark.createDataFrame(learned_from, "doc_id bigint, text string, lang string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.labelled(docs, model).collect()}
    assert got[0] == got[1] == got[4] == "und" and got[2] != "und" and got[3] != "und" and got[5] == "en"
