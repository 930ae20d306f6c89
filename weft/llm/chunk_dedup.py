"""Line dedup by content-defined chunks of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, filled, let, released, removed, stored, stored_at

#: Lines that a rolling hash covers, and what weighs an earlier line in it.
WINDOW, BASE = 2, 31
#: A line of this many words is a chunk of its own.
LONE = 50
_NONE = "array<int>"


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def chunks(text: Column, window: int = WINDOW, lone: int = LONE) -> Column:
    """Array of (places, compared): the word lines of a text (their numbers from 0) in chunks.

    The rolling hash of a word line is h(k) + 31 h(k-1) + ... over ``window`` word lines (blank ones do
    not count, lines before the first count 0). A chunk ends after a line whose rolling hash is
    lower than that of the line before and not higher than that of the next, so two ends never
    follow each other, and an end depends on the lines next to it only: what is put in before a
    passage moves its chunks and changes none but the first. A line of ``lone`` words or more is a
    chunk of its own. No other chunk has one line, unless it stands alone between such lines or is the
    only word line of its text; of these only the last is compared."""
    def of_lines(lines):
        def of_places(at):
            def of_words(w):
                def of_hashes(r):
                    def edge(k):
                        return F.coalesce(F.get(w, k)["long"], F.lit(True))

                    def ends(k):
                        low = (F.get(r, k) < F.get(r, k - 1)) & (F.get(r, k) <= F.get(r, k + 1))
                        return (k == F.size(w) - 1) | edge(k) | edge(k + 1) | (~edge(k - 1) & ~edge(k + 2) & F.coalesce(low, F.lit(False)))
                    last = F.filter(F.sequence(F.lit(0), F.size(w) - 1), ends)

                    def made(e):
                        def one(end, n):
                            start = F.when(n > 0, F.get(e, n - 1) + 1).otherwise(0)
                            return F.struct(F.slice(at, start + 1, end - start + 1).alias("places"),
                                            ((end > start) | edge(end) | (F.size(w) == 1)).alias("compared"))
                        return F.transform(e, one)
                    return let(last, made)

                def rolling(_, k):
                    total = F.get(w, k)["h"]
                    for back in range(1, window):
                        total = total + F.coalesce(F.get(w, k - back)["h"], F.lit(0).cast("bigint")) * BASE ** back
                    return total
                return let(F.transform(w, rolling), of_hashes)
            words = F.transform(at, lambda i: F.struct(line_hash(F.get(lines, i)).alias("h"), (
                F.regexp_count(F.get(lines, i), F.lit(WORD)) >= lone).alias("long")))
            return F.when(F.size(at) > 0, let(words, of_words)).otherwise(F.array().cast("array<struct<places:array<int>,compared:boolean>>"))
        return let(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORD)), of_places)
    return let(F.split(text, "\n"), of_lines)


def _bytes(lines: Column, places: Column) -> Column:
    """The word lines of a chunk."""
    return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")


def _digest(line: Column) -> Column:
    return F.substring(F.unhex(F.sha2(line.cast("binary"), 256)), 1, 16)


def _equal_ends(own: Column, other: Column, back: bool) -> Column:
    """How many of the digests at the near ends of two lists are equal: at their ends (back) or starts."""
    steps = F.least(F.size(own), F.size(other))

    def step(n, j):
        same = (F.get(own, F.size(own) - j) == F.get(other, F.size(other) - j)) if back else (F.get(own, j - 1) == F.get(other, j - 1))
        return F.when((n == j - 1) & same, j).otherwise(n)
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.when(steps > 0, steps).otherwise(1)), F.lit(0), step)).otherwise(0)


def _removed(marked: DataFrame, window: int, lone: int) -> DataFrame:
    """id, text_key, gone: sorted spans of lines (start, end) of the chunks that an earlier document, or an
    earlier place of the same, has. marked: id, text_key, text. Stored; what its jobs wrote and shuffled, the
    texts among it, is gone before the caller shuffles the texts once more. Joins with the texts sort and
    merge at any size, so a small table is joined as a large one is and its disk foretells that of a large one."""
    key, spark = ["id", "text_key"], marked.sparkSession
    released(spark)

    def hashed(lines):
        return let(chunks(F.col("text"), window, lone), lambda cs: F.transform(cs, lambda c: F.when(c["compared"], F.xxhash64(_bytes(lines, c["places"])))))
    seen, seen_at = stored_at(marked.select(*key, let(F.split("text", "\n"), hashed).alias("hashes")).filter(F.exists("hashes", lambda h: h.isNotNull())).distinct())
    each = seen.select(*key, F.posexplode("hashes").alias("pos", "hash")).filter("hash IS NOT NULL")
    often, often_at = stored_at(each.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    open_ = each.join(often, "hash").groupBy(*key).agg(F.collect_list(F.struct("pos", "hash")).alias("open"))

    def opened(lines):
        def of_chunks(cs):
            def digests(c):
                return F.transform(F.coalesce(c["places"], F.array().cast(_NONE)), lambda i: _digest(F.get(lines, i)))

            def of_one(o):
                c, before, after = (F.get(cs, o["pos"] + k) for k in (0, -1, 1))
                return F.struct(o["pos"].alias("pos"), o["hash"].alias("hash"), _bytes(lines, c["places"]).alias("bytes"), c["places"].alias("places"),
                                before["places"].alias("places_before"), after["places"].alias("places_after"),
                                digests(before).alias("before"), digests(after).alias("after"))
            return F.transform("open", of_one)
        return let(chunks(F.col("text"), window, lone), of_chunks)
    met, met_at = stored_at(marked.select(*key, "text").join(open_.hint("merge"), key).dropDuplicates(key).select(*key, F.explode(let(F.split("text", "\n"), opened)).alias("c")).select(*key, "c.*"))
    for at in (seen_at, often_at):
        removed(spark, at)
    released(spark)
    place = F.struct("id", "text_key", "pos")
    firsts, firsts_at = stored_at(met.groupBy("hash", "bytes").agg(F.min(F.struct("id", "text_key", "pos", "before", "after")).alias("first"), F.count("*").alias("n")).filter(
        "n > 1").drop("n"))
    later = met.join(firsts, ["hash", "bytes"]).filter(place != F.struct("first.id", "first.text_key", "first.pos"))
    lead = _equal_ends(F.col("before"), F.col("first.before"), True)
    trail = _equal_ends(F.col("after"), F.col("first.after"), False)
    grown = later.select(*key, "places", "places_before", "places_after", lead.alias("lead"), trail.alias("trail")).select(
        *key, F.when(F.col("lead") > 0, F.get("places_before", F.size("places_before") - F.col("lead"))).otherwise(F.get("places", F.lit(0))).alias("start"),
        (F.when(F.col("trail") > 0, F.get("places_after", F.col("trail") - 1)).otherwise(F.get("places", F.size("places") - 1)) + 1).alias("end"))
    gone = stored(grown.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("gone")))
    for at in (met_at, firsts_at):
        removed(spark, at)
    released(spark)
    return gone


def _marked(docs: DataFrame, *more) -> DataFrame:
    return docs.select(*more, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")).alias("id"),
                       F.xxhash64(filled("text")).alias("text_key"), filled("text").alias("text"))


def _left(lines: Column) -> Column:
    """Lines outside ``gone``; none if no word line is left."""
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.exists("gone", lambda g: (g["start"] <= i) & (i < g["end"])), x)), lambda x: x.isNotNull())
    return let(kept, lambda k: F.when(F.exists(k, lambda x: x.rlike(WORD)), F.array_join(k, "\n")).otherwise(""))


def deduplicated(docs: DataFrame, window: int = WINDOW, lone: int = LONE) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, removed (start:end of line spans, some may overlap), text.

    Of the chunks with equal bytes (of their word lines) the one with the smallest (doc_id, place) stays,
    all later ones go, with the blank lines inside. A chunk that goes also takes the lines next to it in the
    chunks before and after, as far as they equal (by 128 bits of SHA-256) those next to the chunk that stays; so of a
    repeated passage nothing stays but a chunk at an end that has no whole repeated chunk, and an
    exact copy is emptied. Each line that goes has an equal one at an earlier place, so one of them
    always stays.

    Chunks are first counted by hash; only those with a repeated hash get their bytes, and bytes
    decide. A chunk that a third of all documents share is one pre-summed key, and a skewed side of a
    join that Spark splits.

    A null text has no lines and stays null; a text without word lines stays as it is, one that
    loses all of them is empty. A null doc_id comes after all others. Rows with equal doc_id and
    text are one document and get the same result. An empty table gives no rows; extra columns
    are not read."""
    marked = _marked(docs, F.col("doc_id"), F.col("text").isNull().alias("absent"))
    out = marked.join(_removed(marked, window, lone).hint("merge"), ["id", "text_key"], "left")
    lines = F.split("text", "\n")
    n_gone = F.size(F.array_distinct(F.flatten(F.transform("gone", lambda g: F.sequence(g["start"], g["end"] - 1)))))
    return out.select(
        "doc_id", F.when(F.col("absent"), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(n_gone).cast("bigint").alias("n_removed_lines"),
        F.coalesce(F.array_join(F.transform("gone", lambda g: F.concat_ws(":", g["start"], g["end"])), ","), F.lit("")).alias("removed"),
        F.when(F.col("absent"), F.lit(None).cast("string")).when(F.col("gone").isNull(), F.col("text")).otherwise(let(lines, _left)).alias("text"))


def without_repeats(docs: DataFrame, window: int = WINDOW, lone: int = LONE) -> DataFrame:
    """``docs`` with the texts that ``deduplicated`` leaves; n_chars follows the text. All columns are kept."""
    marked = _marked(docs, F.struct("*").alias("row"))
    out = marked.join(_removed(marked.drop("row"), window, lone).hint("merge"), ["id", "text_key"], "left")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(let(F.split("text", "\n"), _left))
    out = out.select(F.col("row").withField("text", text).alias("row"))
    if "n_chars" in docs.columns:
        out = out.select(F.col("row").withField("n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType)).alias("row"))
    return out.select("row.*")
