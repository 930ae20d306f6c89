"""Reading synthesis documents (one JSON object per file) into base tables, and
writing result tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut

#: More than the studies, themes or findings of one document.
IN_A_DOCUMENT = 1 << 32
S, I = T.StringType(), T.IntegerType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


QUOTE = _struct(quote_id=S, text=S, participant_id=S, page=S, context=S)
STUDY = _struct(study_id=S, title=S, authors=S, year=I, methodology=S, setting=S, participants=S,
                sample_size=I, quality_tool=S, quality_score=S, key_findings=T.ArrayType(S),
                quotes=T.ArrayType(QUOTE))
THEME = _struct(theme_id=S, label=S, level=S, description=S, parent_id=S,
                assigned_quotes=T.ArrayType(S), assigned_studies=T.ArrayType(S),
                concepts=T.ArrayType(S))
GRADED_FINDING = _struct(finding_id=S, finding_text=S, methodological_limitations=S, coherence=S,
                         adequacy=S, relevance=S, overall_confidence=S, explanation=S,
                         contributing_studies=T.ArrayType(S))
DOCUMENT = _struct(name=S, synthesis_type=S, studies=T.ArrayType(STUDY), themes=T.ArrayType(THEME),
                   concepts=T.ArrayType(S), cerqual_findings=T.ArrayType(GRADED_FINDING))

STUDY_DEFAULTS = {"methodology": "other", "setting": "", "participants": "", "sample_size": 0,
                  "quality_tool": "CASP", "quality_score": "moderate"}
THEME_DEFAULTS = {"description": "", "level": "descriptive"}
FINDING_DEFAULTS = {"methodological_limitations": "no", "coherence": "no", "adequacy": "no",
                    "relevance": "no", "overall_confidence": "", "explanation": ""}
QUOTE_DEFAULTS = {"participant_id": "", "page": "", "context": ""}


@dataclass
class Evidence:
    """The base tables of one collection. Row order is data, so it is a column.

    studies        study_id, ord, year, quality_score, findings ARRAY<STRING>,
                   quotes ARRAY<STRUCT<quote_id, text, ..>>, ..
    themes         theme_id, ord, label, level, parent_id, concepts ARRAY<STRING>, ..
    theme_studies  theme_id, study_id, pos      (distinct per theme and study)
    theme_quotes   theme_id, quote_id, pos
    """

    studies: DataFrame
    themes: DataFrame
    theme_studies: DataFrame
    theme_quotes: DataFrame | None = None
    findings_assessed: DataFrame | None = None
    concepts: list[str] = field(default_factory=list)


def distinct_links(links: DataFrame, left: str, right: str) -> DataFrame:
    """One row per (left, right), at its first position."""
    return links.groupBy(left, right).agg(F.min("pos").alias("pos"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Raw documents with the fixed schema; a malformed file is an error."""
    return (spark.read.schema(DOCUMENT).option("multiLine", True)
            .option("mode", "FAILFAST").json(path))


def load_evidence(spark: SparkSession, path: str, name: str | None = None) -> Evidence:
    """Base tables of the document(s) at ``path``; ``name`` keeps one document.

    Several documents follow each other in the order of their file paths: a study, theme
    or finding is numbered by its document, then by its place in it."""
    raw = read_documents(spark, path).withColumn("file", F.col("_metadata.file_path")).withColumn("row", F.monotonically_increasing_id())
    if name is not None:
        raw = raw.filter(F.col("name") == name)
    raw = cut(raw)
    # one short row per document
    place = raw.select("row", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("file", "row")) - 1).alias("document"))
    raw = raw.join(place, "row")
    number = F.col("document") * IN_A_DOCUMENT + F.col("ord")
    s = raw.select("document", F.posexplode("studies").alias("ord", "s")).select(number.cast("bigint").alias("ord"), "s.*")
    quotes = F.transform("quotes", lambda q: F.struct(
        q["quote_id"].alias("quote_id"), q["text"].alias("text"),
        *[F.coalesce(q[k], F.lit(v)).alias(k) for k, v in QUOTE_DEFAULTS.items()]))
    studies = s.fillna(STUDY_DEFAULTS).select(
        "study_id", "ord", "title", "authors", "year", "methodology", "setting", "participants",
        "sample_size", "quality_tool", "quality_score",
        F.coalesce("key_findings", F.array().cast("array<string>")).alias("findings"),
        F.coalesce(quotes, F.array().cast(
            "array<struct<quote_id:string,text:string,participant_id:string,page:string,context:string>>"
        )).alias("quotes"))
    t = (raw.select("document", F.posexplode("themes").alias("ord", "t"))
         .select(number.cast("bigint").alias("ord"), "t.*").fillna(THEME_DEFAULTS))
    themes = t.select("theme_id", "ord", "label", "description", "level", "parent_id",
                      F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"))

    def links(column, key):
        rows = t.select("theme_id", F.posexplode(column).alias("pos", key))
        return distinct_links(rows, "theme_id", key)

    assessed = (raw.select("document", F.posexplode("cerqual_findings").alias("ord", "f"))
                .select(number.cast("bigint").alias("ord"), "f.*").fillna(FINDING_DEFAULTS)
                .withColumn("contributing_studies",
                            F.coalesce("contributing_studies", F.array().cast("array<string>"))))
    # a parameter of the translation matrix, whose columns they name: a handful of words, each once
    named = raw.select("document", F.posexplode("concepts").alias("ord", "concept")).groupBy("concept").agg(F.min(number).alias("ord"))
    concepts = [r["concept"] for r in named.orderBy("ord").collect()]
    return Evidence(studies, themes, links("assigned_studies", "study_id"),
                    links("assigned_quotes", "quote_id"), assessed, concepts)


def write_results(results: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """One Parquet table per named result."""
    for name, df in results.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


def parts(studies: DataFrame) -> DataFrame:
    """study_id, part, text: findings in order, then quote texts. No shuffle."""
    texts = F.concat(F.coalesce("findings", F.array().cast("array<string>")),
                     F.coalesce(F.transform("quotes", lambda q: q["text"]),
                                F.array().cast("array<string>")))
    return studies.select("study_id", F.posexplode(texts).alias("part", "text"))


def study_texts(studies: DataFrame) -> DataFrame:
    """study_id, text: the parts of a study joined by blanks, inside its own row."""
    return studies.select(
        "study_id", F.concat_ws(" ", F.col("findings"), F.transform("quotes", lambda q: q["text"]))
        .alias("text"))


def study_quotes(studies: DataFrame) -> DataFrame:
    return studies.select("study_id", F.posexplode("quotes").alias("pos", "q")).select(
        "study_id", "pos", "q.*")


def study_findings(studies: DataFrame) -> DataFrame:
    return studies.select("study_id", F.posexplode("findings").alias("pos", "text"))
