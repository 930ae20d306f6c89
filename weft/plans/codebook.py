"""Texts against a codebook of keywords, by equi-joins: the codebook is a table, of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from .lineage import stored_at

GRAM = 3


def containing(rows: DataFrame, keywords: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` without their text and with ``theme_id``, once for each theme with a keyword inside the
    lower-cased text; rows are told apart by their other columns. keywords: theme_id, word.

    A keyword is indexed by its first three characters (all of them if it is shorter), a text
    meets the keywords of its own three-character runs, and the whole keyword is then looked
    for. So the work grows with the texts and with what they hold, not with texts x themes.
    Keywords are joined, not gathered: whether their index is sent to the texts or both are
    shuffled is left to Spark's size check, which sees the size of their file."""
    keywords, _ = stored_at(keywords)
    index = keywords.select("word").distinct().withColumn("_gram", F.substring("word", 1, GRAM))
    sizes = [r["n"] for r in index.select(F.length("_gram").alias("n")).distinct().collect()]  # 0 to 3
    none = F.array().cast("array<string>")

    def runs(t, n):
        if n == 0:
            return F.array(F.lit(""))
        starts = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(t, i, F.lit(n)))

    def grams(t):
        return F.array_distinct(F.concat(*[runs(t, n) for n in sizes])) if sizes else none
    lower = F.lower(F.col(text))
    met = rows.withColumn("_gram", F.explode(let(lower, grams))).join(index, "_gram").filter(F.contains(lower, F.col("word")))
    return met.drop("_gram", text).join(keywords, "word").drop("word").distinct()


def shared_words(rows: DataFrame, words: str, book: DataFrame) -> DataFrame:
    """``rows`` (whose array column ``words`` is dropped) and the columns of ``book``, once per word of
    the array, which is taken as a set, that is a ``word`` of ``book``. The book is stored first: rows from the driver
    have no size that Spark knows, and all words of all texts would be shuffled to meet a few."""
    book, _ = stored_at(book)
    return rows.withColumn("word", F.explode(F.array_distinct(words))).drop(words).join(book, "word").drop("word")
