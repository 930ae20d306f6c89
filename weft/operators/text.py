"""Term vectors, cosine similarity and clusters of study texts.

All operators take ``texts``: study_id, text, one row per study. Tokenising and
term counting happen inside the row, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, safe_div, tokenise
from ..functions.lexicons import STOPWORDS
from ..plans.components import connected_components
from ..plans.lineage import removed, stored_at
from ..plans.pairs import top_k
from ..plans.products import block_products, pairs, stars

#: Words whose pairs a task counts at once, and rows that it hands on at once.
TOKENS, ROWS = 1 << 21, 1 << 16


def tokens(texts: DataFrame, stopwords=STOPWORDS) -> DataFrame:
    return texts.select("study_id", tokenise("text", stopwords).alias("tokens"))


def counted(tokens_column) -> Column:
    """ARRAY<STRUCT<term, tf>> of a token array: sort it once, then measure the runs."""
    def runs(s):
        n = F.size(s)
        ends = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
                        lambda i: (i == n) | (F.element_at(s, i) != F.element_at(s, F.least(i + 1, n))))
        return let(ends, lambda e: F.transform(e, lambda end, k: F.struct(
            F.element_at(s, end).alias("term"),
            (end - F.when(k > 0, F.element_at(e, F.greatest(k, F.lit(1)))).otherwise(F.lit(0)))
            .cast("bigint").alias("tf"))))
    return let(F.sort_array(tokens_column), runs)


def term_counts(texts: DataFrame, stopwords=STOPWORDS) -> DataFrame:
    """study_id, n_tokens, term, tf."""
    rows = texts.select("study_id", tokenise("text", stopwords).alias("t"))
    return rows.select("study_id", F.size("t").cast("bigint").alias("n_tokens"),
                       F.explode(counted(F.col("t"))).alias("c")).select("study_id", "n_tokens", "c.term", "c.tf")


def document_frequency(texts: DataFrame, stopwords=STOPWORDS) -> DataFrame:
    """term, df. Each task counts its own studies before the shuffle."""
    return (texts.select(F.explode(F.array_distinct(tokenise("text", stopwords))).alias("term"))
            .groupBy("term").agg(F.count("*").alias("df")))


def vocabulary(texts: DataFrame, min_df: int = 1) -> DataFrame:
    return document_frequency(texts).filter(F.col("df") >= min_df)


def read_once(texts: DataFrame) -> DataFrame:
    """study_id, n_tokens, terms ARRAY<STRUCT<term, tf>>, bag (SHA-256 of the sorted tokens): the texts are
    tokenised here and nowhere else; what follows reads this table, written once."""
    rows = texts.select("study_id", tokenise("text").alias("t"))
    bag = F.sha2(F.array_join(F.sort_array("t"), " "), 256)
    return stored_at(rows.select("study_id", F.size("t").cast("bigint").alias("n_tokens"), counted(F.col("t")).alias("terms"), bag.alias("bag")))[0]


def weighted(read: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """study_id, term, tf, df, weight = tf / n_tokens * ln(N / (1 + df)) over the table of ``read_once``. The weight is
    negative for a term of every study, as the definition says. ``of`` (study_id) narrows the
    studies that get a vector; frequencies always come from all."""
    n = read.agg(F.count("*")).scalar()
    df = read.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    some = read if of is None else read.join(of, "study_id", "left_semi")
    rows = some.select("study_id", "n_tokens", F.explode("terms").alias("c")).select("study_id", "n_tokens", "c.term", "c.tf")
    return rows.join(df, "term").select(
        "study_id", "term", "tf", "df", (F.col("tf") / F.col("n_tokens") * F.log(n / (1.0 + F.col("df")))).alias("weight"))


def tfidf(texts: DataFrame) -> DataFrame:
    """study_id, term, tf, df, weight: ``weighted`` over the texts."""
    return weighted(read_once(texts))


def top_terms(texts: DataFrame, k: int = 3) -> DataFrame:
    return top_k(tfidf(texts), ["study_id"], [F.desc("weight"), F.asc("term")], k)


# --- similarity ---------------------------------------------------------------

def copies(read: DataFrame) -> DataFrame:
    """study_id, rep: studies with the same bag of tokens share the smallest id."""
    rows = read.select("study_id", "bag")
    return rows.join(rows.groupBy("bag").agg(F.min("study_id").alias("rep")), "bag").select("study_id", "rep")


def unit_vectors(read: DataFrame, reps: DataFrame) -> DataFrame:
    """study_id, features (terms), values: unit-length TF-IDF of the representative studies, a row each."""
    rows = weighted(read, reps.select(F.col("rep").alias("study_id")).distinct())
    packed = rows.groupBy("study_id").agg(F.collect_list(F.struct("term", "weight")).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"]))
    return packed.withColumn("norm", norm).filter(F.col("norm") > 0).select(
        "study_id", F.col("c.term").alias("features"), F.transform("c.weight", lambda w: w / F.col("norm")).alias("values"))


def similar_pairs(texts: DataFrame, threshold: float = 0.3, slack: float = 1.0) -> DataFrame:
    """a < b, similarity: every pair of distinct token bags above the threshold (0 or more).

    Copies are folded first (``copies`` maps them back), so a bag held by a third of all
    studies is one row here. Products are added inside the tasks, a pair of blocks of studies each
    (``plans/products.py``): exact, and only pairs above the threshold become rows. ``slack``
    moved work between two steps that are now one; no value changes the result."""
    read = read_once(texts)
    vectors, vectors_at = stored_at(unit_vectors(read, copies(read)))
    kind = dict(vectors.dtypes)["study_id"]
    found = block_products(vectors, "study_id", pairs, f"x {kind}, y {kind}, product double", over=threshold)
    removed(texts.sparkSession, vectors_at)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("product").alias("similarity"))


def study_clusters(texts: DataFrame, threshold: float = 0.3) -> DataFrame:
    """study_id, cluster: single linkage over similarity above the threshold; the cluster
    is its smallest study id.

    Near copies may be a third of all studies, so their pairs are never listed: each pair of blocks
    hands on the links of a forest that joins what its pairs above the threshold join."""
    read = read_once(texts)
    copy_of, _ = stored_at(copies(read))
    vectors, vectors_at = stored_at(unit_vectors(read, copy_of))
    kind = dict(vectors.dtypes)["study_id"]
    links = block_products(vectors, "study_id", stars, f"a {kind}, b {kind}", over=threshold)
    removed(texts.sparkSession, vectors_at)
    nodes = copy_of.select(F.col("rep").alias("study_id")).distinct()
    groups = connected_components(nodes, links, "study_id").toDF("rep", "cluster")
    return copy_of.join(groups, "rep").select("study_id", "cluster")


def cluster_labels(texts: DataFrame, clusters: DataFrame, k: int = 3) -> DataFrame:
    """cluster, rank, term, weight: the k heaviest summed terms of each cluster."""
    read = read_once(texts)
    n = read.agg(F.count("*")).scalar()
    df = read.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # all weights of a term have one factor: shares of a term are summed before they meet it
    shares = read.join(clusters, "study_id").select("cluster", "n_tokens", F.explode("terms").alias("c")).groupBy(
        "cluster", F.col("c.term").alias("term")).agg(F.sum(F.col("c.tf") / F.col("n_tokens")).alias("share"))
    summed = shares.join(df, "term").select("cluster", "term", (F.col("share") * F.log(n / (1.0 + F.col("df")))).alias("weight"))
    # summed floats depend on the order of addition: compare at 12 decimals
    return top_k(summed, ["cluster"], [F.desc(F.round("weight", 12)), F.asc("term")], k)


# --- windowed co-occurrence ---------------------------------------------------

def _kept_words(tokens: DataFrame, min_df: int) -> DataFrame:
    """term, n (occurrences), df of the words of ``min_df`` studies or more; counted inside the row first."""
    each = tokens.select(F.explode(counted(F.col("t"))).alias("c")).groupBy(F.col("c.term").alias("term")).agg(
        F.sum("c.tf").alias("n"), F.count("*").alias("df"))
    return each.filter(F.col("df") >= min_df)


def _pair_counter(window: int):
    """Counts of unordered pairs of words at most ``window`` apart, summed over some texts of a task."""
    def counted_in(texts: pa.ListArray) -> Iterator[pa.RecordBatch]:
        words = texts.flatten().dictionary_encode()
        names = words.dictionary
        if not len(names):
            return
        order = pc.sort_indices(names)
        place = np.empty(len(names), np.int64)
        place[order.to_numpy()] = np.arange(len(names))
        at = place[words.indices.to_numpy()]
        text = np.repeat(np.arange(len(texts)), pc.fill_null(texts.value_lengths(), 0).to_numpy(zero_copy_only=False))
        codes = []
        for k in range(1, window + 1):
            x, y = at[:-k], at[k:]
            near = text[:-k] == text[k:]
            codes.append((np.minimum(x, y) * len(names) + np.maximum(x, y))[near])
        code, n = np.unique(np.concatenate(codes), return_counts=True)
        names = names.take(order)
        for lo in range(0, len(code), ROWS):
            c = code[lo:lo + ROWS]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(c // len(names))), names.take(pa.array(c % len(names))), pa.array(n[lo:lo + ROWS])],
                                             ["w1", "w2", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            texts = batch.column(0)
            ends = np.cumsum(pc.fill_null(texts.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(texts):
                done = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, done + TOKENS - size, side="right")))
                held.append(texts.slice(lo, hi - lo))
                size += int(ends[hi - 1] - done)
                lo = hi
                if size >= TOKENS or lo < len(texts):
                    yield from counted_in(pa.concat_arrays(held))
                    held, size = [], 0
        if held:
            yield from counted_in(pa.concat_arrays(held))
    return run


def _windowed(tokens: DataFrame, words: DataFrame, window: int) -> DataFrame:
    """A task counts a few million words at a time, so a pair is a row once for these, not at each occurrence."""
    pairs = tokens.mapInArrow(_pair_counter(window), "w1 string, w2 string, n bigint").groupBy("w1", "w2").agg(F.sum("n").alias("n"))
    vocab = words.select("term")
    return (pairs.join(vocab.withColumnRenamed("term", "w1"), "w1", "left_semi")
            .join(vocab.withColumnRenamed("term", "w2"), "w2", "left_semi").select("w1", "w2", "n"))


def _token_table(texts: DataFrame) -> tuple[DataFrame, str]:
    return stored_at(texts.select(tokenise("text").alias("t")))


def cooccurrence(texts: DataFrame, window: int = 5, min_df: int = 2) -> DataFrame:
    """w1 <= w2, n: unordered pairs of kept words at most ``window`` token positions
    apart. Distance counts all tokens; counts are summed before the vocabulary join."""
    tokens, _ = _token_table(texts)
    return _windowed(tokens, _kept_words(tokens, min_df), window)


def word_counts(texts: DataFrame, min_df: int = 2) -> DataFrame:
    """term, n: occurrences of the kept vocabulary."""
    return _kept_words(_token_table(texts)[0], min_df).select("term", "n")


def ppmi_tables(texts: DataFrame, window: int = 5, min_df: int = 2) -> tuple[DataFrame, DataFrame, str]:
    """What ``ppmi`` gives, the kept words (term, n), and the folder of the pairs that the first is made from."""
    tokens, tokens_at = _token_table(texts)
    words, _ = stored_at(_kept_words(tokens, min_df).select("term", "n"))
    pairs, pairs_at = stored_at(_windowed(tokens, words, window))
    removed(texts.sparkSession, tokens_at)
    total_pairs = pairs.agg(F.sum("n").cast("double")).scalar()
    total_words = words.agg(F.sum("n").cast("double")).scalar()
    rows = (pairs.filter(F.col("w1") < F.col("w2"))
            .join(words.select(F.col("term").alias("w1"), F.col("n").alias("n1")), "w1")
            .join(words.select(F.col("term").alias("w2"), F.col("n").alias("n2")), "w2"))
    p = safe_div("n", total_pairs) / (F.col("n1") / total_words * F.col("n2") / total_words)
    return rows.select("w1", "w2", "n", F.log2(p).alias("ppmi")).filter(F.col("ppmi") > 0), words, pairs_at


def ppmi(texts: DataFrame, window: int = 5, min_df: int = 2) -> DataFrame:
    """w1 < w2, n, ppmi (the positive entries; all others are 0). The texts are tokenised once."""
    return ppmi_tables(texts, window, min_df)[0]
