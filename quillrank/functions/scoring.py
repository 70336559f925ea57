"""Inverse document frequency, term weight and score of the five BM25 variants, as Column expressions.

Arithmetic is in double precision; idf, weight and score are each rounded to single, so scores agree bit by bit
wherever they are computed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Params


def idf(method: str, n: Column, df: Column) -> Column:
    """Of a term that ``df`` of ``n`` documents hold. Robertson's is negative for a term that most of them hold."""
    n, df = n.cast("double"), df.cast("double")
    ratio = {
        "robertson": (n - df + 0.5) / (df + 0.5),
        "lucene": F.lit(1.0) + (n - df + 0.5) / (df + 0.5),
        "atire": n / df,
        "bm25l": (n + 1.0) / (df + 0.5),
        "bm25plus": (n + 1.0) / df,
    }[method]
    return F.ln(ratio).cast("float")


def weight(p: Params, tf: Column, length: Column, mean: Column) -> Column:
    """Of a term that stands ``tf`` times among the ``length`` tokens of a document, where documents have ``mean`` tokens.

    bm25l takes no account of the length.
    """
    tf, length, mean = tf.cast("double"), length.cast("double"), mean.cast("double")
    k1, b, delta = F.lit(p.k1), F.lit(p.b), F.lit(p.delta)
    norm = (F.lit(1.0) - b) + b * (length / mean)
    if p.method in ("robertson", "lucene"):
        out = tf / (k1 * norm + tf)
    elif p.method == "atire":
        out = tf * (k1 + 1.0) / (tf + k1 * norm)
    elif p.method == "bm25l":
        out = (k1 + 1.0) * (tf + delta) / (k1 + tf + delta)
    else:
        out = (k1 + 1.0) * tf / (k1 * norm + tf) + delta
    return out.cast("float")


def score(p: Params, n: Column, df: Column, tf: Column, length: Column, mean: Column) -> Column:
    return (idf(p.method, n, df).cast("double") * weight(p, tf, length, mean).cast("double")).cast("float")


def mean_length(tokens: Column, documents: Column) -> Column:
    """Tokens a document, both numbers and their quotient in single precision; 0 where there are no documents."""
    return F.coalesce(F.try_divide(tokens.cast("float").cast("double"), documents.cast("float").cast("double")).cast("float"), F.lit(0).cast("float"))


def ordered_sum(scores: Column) -> Column:
    """Single-precision running sum of an array of structs (df, place, score), rarest term first."""
    return F.aggregate(F.array_sort(scores), F.lit(0).cast("float"), lambda a, x: (a + x["score"]).cast("float"))
