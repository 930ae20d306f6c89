"""Lexicon sentiment of sentences, studies and themes; emotion counts.

A sentence is scored inside its row: each token becomes a small code, and one pass
over the codes carries the state of the negation window."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions.columns import raw_words, sentences
from ..plans.pairs import incidence
from ..plans.ranks import spearman
from ..sources.documents import Evidence
from .synthesis import theme_saturation

POSITIVE, NEGATIVE, INTENSIFIER, NEGATOR = 1, 2, 3, 4


@dataclass
class SentimentLexicon:
    """Word lists; a word of several lists counts as negator, then intensifier, then
    positive, then negative."""

    positive: list[str] = field(default_factory=lambda: lex.POSITIVE_WORDS)
    negative: list[str] = field(default_factory=lambda: lex.NEGATIVE_WORDS)
    intensifiers: list[str] = field(default_factory=lambda: lex.INTENSIFIERS)
    negators: list[str] = field(default_factory=lambda: lex.NEGATORS)

    def code(self, word: Column) -> Column:
        return (F.when(word.isin(self.negators), NEGATOR).when(word.isin(self.intensifiers), INTENSIFIER)
                .when(word.isin(self.positive), POSITIVE).when(word.isin(self.negative), NEGATIVE).otherwise(0))


def score_codes(codes: Column) -> Column:
    """(positive - negative) / scored words of a code array.

    A negator flips the next three counted words (intensifiers are not counted). An
    intensifier right before a scored word adds a half, flipped when one of the three
    tokens before the intensifier is a negator; the half is not in the divisor."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("scored"), F.lit(0).alias("window"),
                     F.lit(99).alias("since"), F.lit(0).alias("previous"))

    def step(s, c):
        word = (c == POSITIVE) | (c == NEGATIVE)
        sign = F.when(c == POSITIVE, 1.0).when(c == NEGATIVE, -1.0).otherwise(0.0)
        base = F.when(s["window"] > 0, -sign).otherwise(sign)
        near = (s["since"] >= 1) & (s["since"] <= 3)
        half = F.when(word & (s["previous"] == INTENSIFIER), F.when(near, -sign).otherwise(sign) * 0.5).otherwise(0.0)
        return F.struct(
            (s["sum"] + base + half).alias("sum"), (s["scored"] + word.cast("int")).alias("scored"),
            F.when(c == NEGATOR, 3).when(c == INTENSIFIER, s["window"])
            .otherwise(F.greatest(s["window"] - 1, F.lit(0))).alias("window"),
            F.when(c == NEGATOR, 0).otherwise(s["since"] + 1).alias("since"), c.alias("previous"))
    scored = F.aggregate(codes, start, step, lambda s: F.when(s["scored"] > 0, s["sum"] / F.greatest(s["scored"], F.lit(1))).otherwise(0.0))
    return F.when(F.exists(codes, lambda c: (c == POSITIVE) | (c == NEGATIVE)), scored).otherwise(F.lit(0.0))


def sentence_rows(parts: DataFrame) -> DataFrame:
    """study_id, part, sent, text."""
    return parts.select("study_id", "part", F.posexplode(sentences("text")).alias("sent", "text"))


def sentence_sentiment(parts: DataFrame, lexicon: SentimentLexicon | None = None) -> DataFrame:
    lexicon = lexicon or SentimentLexicon()
    codes = sentence_rows(parts).select("study_id", "part", "sent",
                                        F.transform(raw_words("text"), lexicon.code).alias("codes"))
    return codes.select("study_id", "part", "sent", score_codes(F.col("codes")).alias("sentiment"))


def study_sentiment(studies: DataFrame, parts: DataFrame, lexicon: SentimentLexicon | None = None) -> DataFrame:
    """study_id, sentiment: mean over sentences, 0 without any."""
    mean = sentence_sentiment(parts, lexicon).groupBy("study_id").agg(F.avg("sentiment").alias("s"))
    return studies.select("study_id").join(mean, "study_id", "left").select(
        "study_id", F.coalesce("s", F.lit(0.0)).alias("sentiment"))


def theme_sentiment(ev: Evidence, per_study: DataFrame) -> DataFrame:
    mean = incidence(ev.theme_studies).join(per_study, "study_id").groupBy("theme_id").agg(F.avg("sentiment").alias("s"))
    return ev.themes.select("theme_id").join(mean, "theme_id", "left").select(
        "theme_id", F.coalesce("s", F.lit(0.0)).alias("sentiment"))


def overall_sentiment(per_study: DataFrame) -> DataFrame:
    return per_study.agg(F.coalesce(F.avg("sentiment"), F.lit(0.0)).alias("sentiment"))


def trajectory(studies: DataFrame, per_study: DataFrame) -> DataFrame:
    return studies.select("study_id", "year").join(per_study, "study_id").groupBy("year").agg(
        F.avg("sentiment").alias("sentiment"))


def emotion_profile(parts: DataFrame, emotions: dict[str, list[str]] = lex.EMOTIONS) -> DataFrame:
    """emotion, n_sentences: sentences with at least one keyword, zeros kept."""
    words = sentence_rows(parts).select(raw_words("text").alias("w"))

    def has_any(keys):
        return F.exists("w", lambda t: t.isin(list(keys)))
    one = words.agg(*[F.count_if(has_any(keys)).alias(name) for name, keys in emotions.items()])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("emotion"), F.col(name).alias("n_sentences")) for name in emotions])).alias("e")
    ).select("e.*")


def sentiment_saturation_correlation(ev: Evidence, per_theme: DataFrame) -> DataFrame:
    rows = per_theme.join(theme_saturation(ev), "theme_id").select(
        F.round("sentiment", 12).alias("sentiment"), "saturation")
    return spearman(rows, "sentiment", "saturation")


def sentiment_report(ev: Evidence, parts: DataFrame, lexicon: SentimentLexicon | None = None,
                     emotions: dict[str, list[str]] = lex.EMOTIONS) -> dict[str, DataFrame]:
    per_study = study_sentiment(ev.studies, parts, lexicon)
    per_theme = theme_sentiment(ev, per_study)
    return {"studies": per_study, "themes": per_theme, "overall": overall_sentiment(per_study),
            "trajectory": trajectory(ev.studies, per_study), "emotions": emotion_profile(parts, emotions),
            "correlation": sentiment_saturation_correlation(ev, per_theme)}
