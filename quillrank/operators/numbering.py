"""Dense numbers 0, 1, 2, ... in a given order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise, sent


def numbered(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """``df`` with a BIGINT column ``name`` that counts the rows in ``order`` from ``first`` on.

    Rows are range-partitioned and sorted, each partition counts its own, and the few numbers of partitions are added up. ``order`` must tell
    all rows apart for the numbers to be the same in every run.
    """
    ranged = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id()), "ranged")
    own = Window.partitionBy("part_").orderBy(*order)
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part_").count().select("part_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before_"))
    return ranged.withColumn("own_", F.row_number().over(own)).join(offsets, "part_").withColumn(name, (F.col("before_") + F.col("own_") - 1 + first).cast("long")).drop("part_", "own_", "before_")


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows up to each in the order of a column of distinct values, in the same way."""
    ranged = materialise(df.repartitionByRange(order).withColumn("part_", F.spark_partition_id()), "ranged")
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part_").agg(F.sum(value).alias("own_")).select("part_", F.coalesce(F.sum("own_").over(before), F.lit(0)).alias("before_"))
    own = F.sum(value).over(Window.partitionBy("part_").orderBy(order))
    return ranged.withColumn(name, own).join(offsets, "part_").withColumn(name, F.col(name) + F.col("before_")).drop("part_", "before_")


def ranks(df: DataFrame, name: str) -> tuple[DataFrame, Column, Column]:
    """The places of distinct whole numbers among all of them, as a table of one row for 64 (rank_bucket, rank_bits, rank_before), to be joined with
    ``shiftright(name, 6)``; then the place of a number, from 0, and whether the number is there."""
    bit = F.expr(f"shiftleft(1L, CAST({name} & 63 AS INT))")
    held = df.select(F.shiftright(name, 6).alias("rank_bucket"), bit.alias("bit")).groupBy("rank_bucket").agg(F.bit_or("bit").alias("rank_bits"), F.count("*").alias("n"))
    held = running_total(held, "rank_bucket", "n", "upto").select("rank_bucket", "rank_bits", (F.col("upto") - F.col("n")).alias("rank_before"))
    held = materialise(held, "ranks")
    lower = F.expr(f"bit_count(rank_bits & ~shiftleft(-1L, CAST({name} & 63 AS INT)))")
    return sent(held, held.count()), (F.col("rank_before") + lower).cast("long"), bit.bitwiseAND(F.col("rank_bits")) != 0
