"""Quality rules: word counts of a text, and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WORD, filled, let, stored, words_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
#: A line may stand in this many different texts of a host, whatever the size of the host.
MOST_TEXTS = 30
#: A document that keeps less than this share of its words is depleted.
LEAST_LEFT = 0.5
LEAST_WORDS, MOST_REPEATED = 50, 0.5


def _no(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text has twice or more.

    Windows are hashed, sorted with their places, and equal neighbours are the repeated
    ones; a repeated window adds the words that the one before it did not reach. All in
    the row: n log n for n words. A text without repeats stops after the hashes."""
    none = F.array().cast("array<bigint>")

    def windows(w):
        return F.when(F.size(w) > 2, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(
            F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))).otherwise(none)

    def covered(h):
        def of_sorted(s):
            def same(p, at):
                return F.coalesce(p["h"] == F.get(s, at)["h"], F.lit(False))
            again = F.filter(s, lambda p, k: same(p, k - 1) | same(p, k + 1))
            places = F.sort_array(F.transform(again, lambda p: p["i"]))
            return F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
                               lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
                               lambda a: a["n"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted))
    return let(let(words, windows), covered)


def normalised(line: Column) -> Column:
    """A line in lower case (A-Z only), runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), WHITE, " "))


def _key(line: Column) -> Column:
    """128 bits of a normalised line."""
    return F.struct(F.xxhash64(line).alias("p"), F.xxhash64(F.lit(1), line).alias("q"))


def judged(docs: DataFrame, most_texts: int = MOST_TEXTS, most_share: float | None = None,
           least_left: float = LEAST_LEFT, keep: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_removed_words, kept for every row; with ``keep`` also ``row`` (the whole input row)
    and ``frequent`` (hash keys of its lines above the limit).

    A line is above the limit in a host (``source``) if it stands in more than ``most_texts``
    different texts of that host; copies of one text count once. (With ``most_share`` it must also stand
    in more than that share of them, so that the limit grows with the host.) A document fails if it
    has too few or too many repeated words, or if its lines below the limit hold less than
    ``least_left`` of its words.

    A row goes through one pass over its text; what moves after that is 128 bits and a word
    count per line, pre-counted per task. A line of a third of all documents is one key of
    the count and, in the join back, a skewed one that Spark splits.

    A null text is empty: no words, failed. A null source is a host of its own. Equal rows
    are judged alike, each with its own row. An empty table gives no rows."""
    text, lines = filled("text"), F.split(filled("text"), "\n")
    with_words = F.filter(lines, lambda x: x.rlike(WORD))
    words = words_of(text)
    first = docs.select(
        *([F.struct("*").alias("row")] if keep else []), F.col("doc_id").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("host"), F.xxhash64(text).alias("text_key"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("bigint").alias("word_chars"),
        _no(text, SYMBOLS).cast("bigint").alias("n_symbols"),
        let(with_words, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        F.transform(with_words, lambda x: let(normalised(x), lambda n: F.struct(
            _key(n).alias("key"), F.size(F.split(n, " ")).alias("words")))).alias("lines"),
        F.monotonically_increasing_id().alias("row_id"))
    first = stored(first)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * int(100 * MOST_REPEATED))
    first = first.withColumn("base_failed", failed)

    texts = first.groupBy("host", "text_key").agg(F.min("row_id").alias("row_id"))
    once = first.select("row_id", "host", F.array_distinct(F.col("lines.key")).alias("keys")).join(
        texts.select("row_id"), "row_id", "left_semi")
    counts = once.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    often = counts.filter(F.col("n") > most_texts)
    if most_share is not None:
        n_texts = texts.groupBy("host").agg(F.count("*").alias("n_texts"))
        often = often.join(n_texts, "host").filter(F.col("n") > F.col("n_texts") * most_share)
    often = stored(often.select("host", "key"))
    line = first.select("row_id", "host", F.explode("lines").alias("line")).select(
        "row_id", "host", F.col("line.key").alias("key"), F.col("line.words").alias("words"))
    hit = line.join(often, ["host", "key"]).groupBy("row_id").agg(
        F.sum("words").cast("bigint").alias("n_removed_words"), *([F.collect_set("key").alias("frequent")] if keep else []))
    out = first.drop("lines").join(hit, "row_id", "left").withColumn(
        "n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("bigint")))
    left = F.col("n_words") - F.col("n_removed_words") >= F.col("n_words") * least_left
    return out.withColumn("kept", ~F.col("base_failed") & left).drop("host", "text_key", "row_id")


def cleaned(docs: DataFrame, **limits) -> DataFrame:
    """The kept documents, without their lines above the limits; n_chars follows the text."""
    rows = judged(docs, keep=True, **limits).filter("kept")

    def rest(frequent):
        return F.array_join(F.filter(F.split(F.col("row.text"), "\n"), lambda x: ~F.array_contains(
            frequent, _key(normalised(x)))), "\n")
    text = F.when(F.col("frequent").isNull(), F.col("row.text")).otherwise(let(F.col("frequent"), rest))
    rows = rows.withColumn("row", F.col("row").withField("text", text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("row", F.col("row").withField("n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType)))
    return rows.select("row.*")
