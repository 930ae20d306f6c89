"""Secrets in texts: keyword and shape patterns, and windows of high entropy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled, let


def _either(word: str) -> str:
    """A pattern for a word with its letters in either case (A-Z only)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([_either(w) for w in ("password", "passwd", "secret", "token")] + [_either("api") + "_?" + _either("key")])
#: kind, pattern, and the least length of a group of it. The pattern of `hex` and of `access` asks for the
#: least length itself: a run of their characters is one match or none, so nothing else changes.
BASE = (("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
#: kind, alphabet, characters of a window, least bits per character of a window.
CLASSES = (("high_hex", "0123456789abcdefABCDEF", 24, 3.0),
           ("high_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 20, 3.7))
#: A candidate that the first of a pair matches as a whole, and the second (if any) nowhere, is no secret: letters
#: with joints (words, paths), digits with joints (dates, numbers), UUIDs, and words with single joints that end in a
#: number. All loops are over one character class: those over groups take a stack frame a round in Java.
ALLOWED = ((r"[-+/_=]*[A-Za-z][-+/_=A-Za-z]*", ""), (r"[-+/_=]*[0-9][-+/_=0-9]*", ""),
           (r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", ""), (r"[A-Za-z][-_/A-Za-z]*[0-9]{1,4}", r"[-_/]{2}"))
#: Entropies are compared as whole numbers of 2^-20 bits.
SCALE = 1 << 20
_BLOCK = 256


def terms(width: int) -> list[int]:
    """c log2 c for c = 0..width, in whole units."""
    return [round(c * math.log2(c) * SCALE) if c else 0 for c in range(width + 1)]


def most_sum(width: int, bits: float) -> int:
    """A window has ``bits`` per character or more if its terms sum to this at most."""
    return math.floor(width * (math.log2(width) - bits) * SCALE)


def _starts(lengths: Column) -> Column:
    """Sum of the lengths before each one, by blocks, so a long list costs little per item."""
    zero = F.lit(0)

    def total(xs):
        return F.aggregate(xs, zero, lambda a, x: a + x)

    def of(ls):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / _BLOCK).cast("int")),
                             lambda b: total(F.slice(ls, b * _BLOCK + 1, _BLOCK)))
        return let(blocks, lambda bs: F.transform(ls, lambda x, i: total(F.slice(bs, 1, F.floor(i / _BLOCK).cast("int")))
                                                  + total(F.slice(ls, i - i % _BLOCK + 1, i % _BLOCK))))
    return F.when(F.size(lengths) > 0, let(lengths, of)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of the leftmost matches that do not overlap; code points.

    The pieces between the matches say where each starts."""
    def located(found):
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: g + F.length(m))
        return F.zip_with(_starts(steps), F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g"))),
                          lambda s, x: F.when(x["m"].isNotNull(), F.struct((s + x["g"]).alias("start"),
                                              (s + x["g"] + F.length(x["m"])).alias("end"), x["m"].alias("found"))))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) > 0, F.filter(located(found), lambda x: x.isNotNull())).otherwise(none))


def _spans(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def windows(found: Column, alphabet: str, width: int, bits: float) -> Column:
    """(lo, hi) of the runs of windows with ``bits`` per character or more, from 0 in ``found``.

    One pass: the counts of the window's characters and their sum of c log2 c are carried,
    and each step changes them by the character that comes and the one that goes."""
    table = F.array(*[F.lit(t).cast("bigint") for t in terms(width)])
    limit = most_sum(width, bits)
    run = "array<struct<lo:int,hi:int>>"

    def walk(codes):
        zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0).cast("bigint").alias("sum"),
                        F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), F.array().cast(run).alias("done"))

        def step(a, i):
            new, old = F.get(codes, i), F.get(codes, i - width)
            goes = F.coalesce(old, F.lit(0))

            def term(c):
                return F.get(table, c)

            def with_counts(n):
                def number(code):
                    return F.get(n["counts"], code - 1)
                less = F.when(goes > 0, term(number(goes) - 1) - term(number(goes))).otherwise(F.lit(0).cast("bigint"))
                left = F.when(goes == new, number(new) - 1).otherwise(number(new))
                total = n["sum"] + less + term(left + 1) - term(left)
                counts = F.when(goes == new, n["counts"]).otherwise(F.transform(n["counts"], lambda c, j: (
                    c + F.when(j + 1 == new, 1).when(j + 1 == goes, -1).otherwise(0))))
                high = (i >= width - 1) & (total <= limit)
                apart = high & (n["lo"] >= 0) & (i - width + 1 > n["hi"])
                return F.struct(
                    counts.alias("counts"), total.alias("sum"),
                    F.when(high & ((n["lo"] < 0) | apart), i - width + 1).otherwise(n["lo"]).alias("lo"),
                    F.when(high, i + 1).otherwise(n["hi"]).alias("hi"),
                    F.when(apart, F.array_append(n["done"], F.struct(n["lo"].alias("lo"), n["hi"].alias("hi"))))
                    .otherwise(n["done"]).alias("done"))
            return let(a, with_counts)
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda a: F.when(
            a["lo"] >= 0, F.array_append(a["done"], F.struct(a["lo"].alias("lo"), a["hi"].alias("hi")))).otherwise(a["done"]))
    codes = F.transform(F.filter(F.split(found, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c))
    return let(codes, walk)


def scanned(docs: DataFrame, classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """doc_id, base, extra: arrays of (start, end, kind) per row of ``docs``.

    ``base`` holds the matches of the fixed patterns, ``extra`` the parts of long runs of a
    character class whose sliding windows carry many bits per character, unless the run is
    on the allow-list or the part lies within a base span. Positions are code points, end
    exclusive. All in the row: no shuffle, linear in the text.

    A null text is empty. Repeated rows are scanned one by one. No span: empty arrays. An
    empty table gives no rows; other columns are not read."""
    text = filled("text")
    def base(kind, pattern, group, least):
        found = matches(text, pattern)
        return _spans(kind, F.filter(found, lambda m: F.length(F.regexp_extract(m["found"], pattern, group)) >= least)
                      if group else found)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.concat(*[base(*b) for b in BASE]).alias("base"), *[
        matches(text, "[" + alphabet.replace("-", "") + ("-" if "-" in alphabet else "") + "]{%d,}" % width).alias(f"c{i}")
        for i, (_, alphabet, width, _) in enumerate(classes)])

    def high(i, kind, alphabet, width, bits):
        def known(text):
            out = F.lit(False)
            for whole, never in allowed:
                out = out | (text.rlike(f"^(?:{whole})$") & (~text.rlike(never) if never else F.lit(True)))
            return out
        free = F.filter(F.col(f"c{i}"), lambda m: ~known(m["found"]))
        return F.flatten(F.transform(free, lambda m: F.transform(windows(m["found"], alphabet, width, bits), lambda w: F.struct(
            (m["start"] + w["lo"]).alias("start"), (m["start"] + w["hi"]).alias("end"), F.lit(kind).alias("kind")))))
    extra = F.concat(*[high(i, *c) for i, c in enumerate(classes)])
    return rows.select("doc_id", "base", F.filter(extra, lambda s: ~F.exists("base", lambda b: (
        b["start"] <= s["start"]) & (s["end"] <= b["end"]))).alias("extra"))


def listed(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of the spans by start, then kind as listed, comma-joined."""
    rank = F.array(*[F.lit(k) for k in kinds])
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
