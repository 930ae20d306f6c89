"""Column expressions shared by the operators. All are built-in Spark functions,
so they run inside the JVM and need no shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import QUALITY_DEFAULT, QUALITY_WEIGHTS, STOPWORDS

PUNCTUATION_EDGE = r"""^[.,;:!?"'()\-]+|[.,;:!?"'()\-]+$"""


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def safe_div(num, den, default=0.0) -> Column:
    """num / den, or ``default`` where den is 0 (ANSI mode raises otherwise)."""
    n, d = col(num).cast("double"), col(den).cast("double")
    return F.when(d != 0, n / F.when(d != 0, d)).otherwise(F.lit(default).cast("double"))


def r6(c) -> Column:
    """Six decimals, with -0.0 folded into 0.0."""
    return F.round(col(c), 6) + F.lit(0.0)


def round_binary(c, digits: int) -> Column:
    """A non-negative double to ``digits`` decimals by its binary value; ``round`` goes by
    the printed decimals, which turns a value just under a tie upwards."""
    scale = float(10 ** digits)
    return F.floor(col(c) * scale + 0.5) / scale


def clamp(c, lo=0.0, hi=1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def raw_words(text) -> Column:
    """Lower-cased runs of ASCII letters."""
    return F.filter(F.split(F.lower(col(text)), "[^a-zA-Z]+"), lambda t: F.length(t) > 0)


def tokenise(text, stopwords=STOPWORDS) -> Column:
    """Lower-cased runs of at least two ASCII letters that are not stop words."""
    return F.filter(F.split(F.lower(col(text)), "[^a-zA-Z]+"),
                    lambda t: (F.length(t) > 1) & ~t.isin(list(stopwords)))


def spaced_words(text) -> Column:
    """Lower-cased words split at white space, punctuation kept."""
    return F.filter(F.split(F.lower(col(text)), r"(?U)\s+"), lambda t: F.length(t) > 0)


def strip_punctuation(word) -> Column:
    return F.regexp_replace(col(word), PUNCTUATION_EDGE, "")


def strip_space(text) -> Column:
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def sentences(text) -> Column:
    """Split after . ! ? followed by white space."""
    return F.filter(F.split(strip_space(text), r"(?U)(?<=[.!?])\s+"),
                    lambda s: F.length(strip_space(s)) > 0)


def argument_sentences(text) -> Column:
    """Split after . ? ! followed by one blank."""
    parts = F.transform(F.split(col(text), r"(?<=[.?!]) "), strip_space)
    return F.filter(parts, lambda s: F.length(s) > 0)


def ngrams(tokens, n: int) -> Column:
    """Array of space-joined runs of n tokens."""
    def runs(t):
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))
    return let(tokens, runs)


def entropy_term(count) -> Column:
    """c * log2(c), 0 at 0. Entropy of counts is log2(T) - sum(term) / T."""
    c = col(count).cast("double")
    return F.when(c > 0, c * F.log2(F.when(c > 0, c))).otherwise(F.lit(0.0))


def entropy_of(total, sum_terms) -> Column:
    """Shannon entropy in bits from the total count and the summed entropy terms."""
    t = col(total).cast("double")
    return F.when(t > 0, F.log2(F.when(t > 0, t)) - col(sum_terms) / F.when(t > 0, t)
                  ).otherwise(F.lit(0.0))


def quality_weight(c) -> Column:
    out = None
    for name, w in QUALITY_WEIGHTS.items():
        out = (F.when(col(c) == name, F.lit(w)) if out is None
               else out.when(col(c) == name, F.lit(w)))
    return out.otherwise(F.lit(QUALITY_DEFAULT))


_SMALL_FACTORIALS = [math.lgamma(i + 1) for i in range(32)]


_STIRLING = (8.33333333333329678849e-02, -2.77777777728775536470e-03, 7.93650558643019558500e-04,
             -5.95187557450339963135e-04, 8.36339918996282139126e-04, -1.63092934096575273989e-03)


def log_factorial(n) -> Column:
    """ln(n!): exact values below 32, above that the series of C's lgamma, term by term in its order: ln(n!) of
    a million has an error of 1e-9 in its last bits, which must be the same one on both sides of a comparison."""
    n = col(n).cast("double")
    x = F.when(n >= 32, n).otherwise(F.lit(32.0)) + 1
    z = 1 / x
    y = z * z
    tail = F.lit(_STIRLING[-1])
    for w in reversed(_STIRLING[:-1]):
        tail = w + y * tail
    series = (x - 0.5) * (F.log(x) - 1) + (4.18938533204672725052e-01 + z * tail)
    small = F.element_at(F.array(*[F.lit(v) for v in _SMALL_FACTORIALS]),
                         F.when((n >= 0) & (n < 32), n.cast("int") + 1).otherwise(F.lit(1)))
    return F.when(n >= 32, series).otherwise(small)


def log_choose(n, k) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(col(n) - col(k))
