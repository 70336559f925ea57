"""Numeric functions over arrays and columns: dot product, maximum, z-score, percentile, discounted gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1.1920928955078125e-07


def dot(a: Column, b: Column) -> Column:
    """Single-precision dot product in the order of the arrays. Arrays of other lengths meet as far as the shorter goes."""
    size = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), size), F.slice(b, F.lit(1), size), lambda x, y: (x.cast("float") * y.cast("float")).cast("float"))
    return F.aggregate(products, F.lit(0).cast("float"), lambda s, x: (s + x).cast("float"))


def greatest_of(values: Column) -> Column:
    """The largest number of an array, minus infinity for an empty one."""
    return F.coalesce(F.array_max(values), F.lit(float("-inf")))


def zscores(df: DataFrame, value: str, *by: str, out: str = "z") -> DataFrame:
    """``df`` with the standard scores of ``value`` in each group of ``by``: population deviation; all 1 where it is (nearly) 0."""
    w = Window.partitionBy(*by)
    spread = F.stddev_pop(value).over(w)
    return df.withColumn(out, F.when(spread < EPSILON, F.lit(1.0)).otherwise((F.col(value) - F.avg(value).over(w)) / F.when(spread >= EPSILON, spread)))


def percentile(values: Column, p: float) -> Column:
    """The value of an array at place round(p / 100 * (n - 1)) of its order; null for an empty array."""
    place = F.floor(F.lit(p) / 100 * (F.size(values) - 1) + 0.5).cast("int")
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), place + 1))


def harness_percentile(values: Column, p: int) -> Column:
    """The value at place n * p / 100, rounded down, and n - 1 at most."""
    place = F.least(F.floor(F.size(values) * F.lit(p) / 100), F.size(values) - 1).cast("int")
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), place + 1))


def gain(grade: Column, rank: Column) -> Column:
    """A grade's share of the discounted gain at rank 1, 2, ..."""
    return grade.cast("double") / F.log2(rank.cast("double") + 1.0)


def format_bytes(n: int) -> str:
    """A number of bytes for people to read: "512 B", "1.50 KB", "2.00 MB", "3.10 GB"."""
    for unit, size in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        if n >= size:
            return f"{n / size:.2f} {unit}"
    return f"{n} B"


def bytes_label(n: Column) -> Column:
    """``format_bytes`` of a column; null for null.

    Java's ``%.2f`` rounds halves up, C's and Python's to even, so hundredths are rounded here. The rest has 30 bits at most, a hundredfold of it is exact.
    """
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for unit, size in (("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30)):
        value = n.cast("double") / size
        rest = value % 1
        out = F.when(n >= size, F.format_string(f"%.2f {unit}", value - rest + F.rint(rest * 100) / 100)).otherwise(out)
    return out
