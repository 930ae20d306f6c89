"""Bigram and trigram models over text parts (each part is one sequence).

Sequences are cut inside the row; counts are summed per task before the shuffle.
``by`` adds a key, e.g. one model per theme."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div, strip_space, tokenise
from ..plans.pairs import top_k

END = "<END>"


def sequences(parts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Token array of each part, closed by an end mark where the text ends in . ! ?"""
    closed = strip_space("text").rlike(r"[.!?]$")
    marks = F.when(closed, F.array(F.lit(END))).otherwise(F.array().cast("array<string>"))
    return parts.select(*by, F.concat(tokenise("text"), marks).alias("t"))


def _shifted(n: int):
    t, size = F.col("t"), F.size("t")
    return F.arrays_zip(*[F.slice(t, F.lit(i + 1), F.greatest(size - (n - 1), F.lit(0))).alias(f"w{i + 1}")
                          for i in range(n)])


def ngram_counts(parts: DataFrame, n: int, by: list[str] = ()) -> DataFrame:
    """w1 .. wn, count over all parts with at least n tokens."""
    words = [f"w{i + 1}" for i in range(n)]
    return (sequences(parts, by).select(*by, F.explode(_shifted(n)).alias("g")).select(*by, "g.*")
            .groupBy(*by, *words).agg(F.count("*").alias("count")))


def transition_model(counts: DataFrame, n: int, by: list[str] = ()) -> DataFrame:
    """P(wn | w1 .. wn-1) next to the counts."""
    context = [*by, *[f"w{i + 1}" for i in range(n - 1)]]
    total = F.sum("count").over(Window.partitionBy(*context))
    return counts.withColumn("p", F.col("count") / total)


def bigram_model(parts: DataFrame, by: list[str] = ()) -> DataFrame:
    return transition_model(ngram_counts(parts, 2, by), 2, by)


def trigram_model(parts: DataFrame, by: list[str] = ()) -> DataFrame:
    return transition_model(ngram_counts(parts, 3, by), 3, by)


def unigram_model(parts: DataFrame) -> DataFrame:
    """word, count, p over the parts with at least two tokens."""
    counts = (sequences(parts).filter(F.size("t") >= 2).select(F.explode("t").alias("word"))
              .groupBy("word").agg(F.count("*").alias("count")))
    total = counts.agg(F.sum("count").cast("double")).scalar()
    return counts.withColumn("p", F.col("count") / total)


def perplexity(bigrams: DataFrame, unigrams: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: n_tokens, perplexity of the parts ``scored`` under the model: bigram,
    else a tenth of the unigram, else 1 / (V + 1). Equal bigrams are scored once."""
    v = unigrams.agg(F.count("*")).scalar()
    counts = ngram_counts(scored, 2)
    rows = (counts.join(bigrams.select("w1", "w2", F.col("p").alias("p2")), ["w1", "w2"], "left")
            .join(unigrams.select(F.col("word").alias("w2"), F.col("p").alias("p1")), "w2", "left"))
    p = F.coalesce("p2", F.col("p1") * 0.1, 1.0 / (v + 1))
    return rows.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_tokens"),
                    F.sum(F.col("count") * F.log(p)).alias("lp")).select(
        "n_tokens", F.when(F.col("n_tokens") > 0, F.exp(-safe_div("lp", "n_tokens")))
        .otherwise(F.lit(float("inf"))).alias("perplexity"))


def coherence(bigrams: DataFrame, texts: DataFrame) -> DataFrame:
    """study_id, n_bigrams, coherence: share of a text's bigrams the model has seen."""
    t, size = F.col("t"), F.size("t")
    pairs = texts.select("study_id", tokenise("text").alias("t")).select("study_id", F.explode_outer(
        F.arrays_zip(F.slice(t, F.lit(1), F.greatest(size - 1, F.lit(0))).alias("w1"),
                     F.slice(t, F.lit(2), F.greatest(size - 1, F.lit(0))).alias("w2"))).alias("g")
    ).select("study_id", "g.*")
    counted = pairs.groupBy("study_id", "w1", "w2").agg(F.count("w1").alias("n"))
    seen = counted.join(bigrams.select("w1", "w2", F.lit(1).alias("seen")), ["w1", "w2"], "left")
    return seen.groupBy("study_id").agg(
        F.sum("n").alias("n_bigrams"),
        safe_div(F.sum(F.when(F.col("seen") == 1, F.col("n")).otherwise(F.lit(0))), F.sum("n")).alias("coherence"))


def theme_bigram_model(parts: DataFrame, theme_studies: DataFrame) -> DataFrame:
    """One bigram model per theme, from the parts of its studies."""
    links = theme_studies.select("theme_id", "study_id").distinct()
    return bigram_model(parts.join(links, "study_id"), ["theme_id"])


def theme_trigram_model(parts: DataFrame, theme_studies: DataFrame) -> DataFrame:
    links = theme_studies.select("theme_id", "study_id").distinct()
    return trigram_model(parts.join(links, "study_id"), ["theme_id"])


def model_sizes(bigrams: DataFrame, trigrams: DataFrame) -> DataFrame:
    """One row: number of bigram and trigram contexts."""
    n3 = trigrams.select("w1", "w2").distinct().agg(F.count("*")).scalar()
    return bigrams.select("w1").distinct().agg(F.count("*").alias("bigram_contexts")).withColumn(
        "trigram_contexts", n3)


def next_words(bigrams: DataFrame, k: int = 3) -> DataFrame:
    """The k most likely followers of each word."""
    return top_k(bigrams, ["w1"], [F.desc("count"), F.asc("w2")], k)


def ngram_report(parts: DataFrame, theme_studies: DataFrame | None = None) -> dict[str, DataFrame]:
    two, three, one = bigram_model(parts), trigram_model(parts), unigram_model(parts)
    out = {"bigrams": two, "trigrams": three, "unigrams": one, "sizes": model_sizes(two, three),
           "perplexity": perplexity(two, one, parts), "next_words": next_words(two)}
    if theme_studies is not None:
        out["theme_bigrams"] = theme_bigram_model(parts, theme_studies)
        out["theme_trigrams"] = theme_trigram_model(parts, theme_studies)
    return out
