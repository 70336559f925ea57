"""Made-up corpora and queries for trying things out: the same numbers give the same texts, on any number of executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus(spark: SparkSession, n_docs: int, vocabulary: int = 5000, least: int = 20, most: int = 199, seed: int = 42) -> DataFrame:
    """(doc_id, text): words "w0", "w1", ... of which the first are the commonest, as in Zipf's law."""
    def unit(*cols):
        return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)

    size = (F.lit(least) + F.floor(unit(F.lit("size"), F.col("id")) * (most - least + 1))).cast("int")
    word = lambda i: F.concat(F.lit("w"), F.floor(F.pow(F.lit(float(vocabulary)), unit(F.col("id"), i)) - 1).cast("int"))
    return spark.range(n_docs).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), size), word), " ").alias("text"))


def queries(spark: SparkSession, n: int, vocabulary: int = 5000, most: int = 3, seed: int = 7) -> DataFrame:
    """(query_id, text) of one to ``most`` words."""
    return corpus(spark, n, vocabulary, 1, most, seed).select(F.col("doc_id").alias("query_id"), "text")
