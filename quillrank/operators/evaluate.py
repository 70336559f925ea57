"""Measures of ranked results against graded relevance: discounted gain, nDCG, recall, and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import gain
from .numbering import running_total


def dcg(results: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, dcg) of results (query_id, rank, doc_id) to rank ``k``, for queries of qrels (query_id, doc_id, grade). Gain is linear; 0 where nothing relevant was found."""
    found = results.filter(F.col("rank") <= k).join(qrels, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    return qrels.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("dcg", F.lit(0.0)).alias("dcg"))


def ideal_dcg(qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, ideal): the discounted gain of the best order."""
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "doc_id"))
    ranked = qrels.withColumn("rank", best)
    return ranked.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("rank") <= k, gain(F.col("grade"), F.col("rank")))), F.lit(0.0)).alias("ideal"))


def ndcg(results: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) for the queries of ``qrels``; 0 where the ideal is 0."""
    both = dcg(results, qrels, k).join(ideal_dcg(qrels, k), "query_id")
    return both.select("query_id", F.when(F.col("ideal") > 0, F.try_divide("dcg", "ideal")).otherwise(0.0).alias("ndcg"))


def mean_ndcg(results: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """One row (n_queries, mean_ndcg), over the queries that have any relevance."""
    return ndcg(results, qrels, k).agg(F.count("*").alias("n_queries"), F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("mean_ndcg"))


def recall(results: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall): the share of ``truth``'s first ``k`` (query_id, rank, doc_id) that ``results`` has among its own."""
    wanted, got = truth.filter(F.col("rank") <= k), results.filter(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit"))
    met = wanted.join(got, ["query_id", "doc_id"], "left")
    return met.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def fuse(rankings: list[DataFrame], k: int = 10, constant: int = 60) -> DataFrame:
    """(query_id, rank, doc_id, score): reciprocal rank fusion, the sum of 1 / (constant + rank) over the rankings."""
    every = rankings[0].select("query_id", "doc_id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "doc_id", "rank"))
    scores = every.groupBy("query_id", "doc_id").agg(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def percentiles(df: DataFrame, value: str, percents: list[float], harness: bool = False) -> DataFrame:
    """(p, value): the value at place round(p / 100 * (n - 1)) of the order of all; ``harness``: at place n * p / 100 rounded down.

    Exact, by counting equal values and adding the counts up; only distinct values are ordered. No rows, no percentiles.
    """
    held = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("c"))
    upto = running_total(held, "value", "c", "upto")
    upto = upto.crossJoin(upto.agg(F.sum("c").alias("n")))
    place = F.least(F.floor(F.col("n") * F.col("p") / 100), F.col("n") - 1) if harness else F.floor(F.col("p") / 100 * (F.col("n") - 1) + 0.5)
    wanted = df.sparkSession.createDataFrame([(float(p),) for p in percents], "p double")
    return upto.crossJoin(wanted).filter((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place)).select("p", "value")
