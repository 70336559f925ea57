"""Upper bounds of scores by blocks, and search that leaves out what can't be among the best. Results are exact.

``block_maxima`` cuts each term's postings into blocks of equal length. Pruning needs blocks that mean the same documents for
every term, so ``range_bounds`` cuts by ranges of doc_id. The search is that of Turtle and Flood's MaxScore for a batch: a query's terms with the highest
bounds give a score that the k-th best reaches at least; the terms whose bounds together stay below it are common words, as a rule, and can bring no
document among the best by themselves. Only the other terms' postings are added up; what they leave within reach, by the common words' bounds in its range,
is looked up among the postings of the common words. Where they have less than half of a batch's postings, all are added up: the rows are the same.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import check_k
from ..errors import FeatureNotEnabled, InvalidParameter
from ..storage import materialise
from .index import Index
from .search import batch_terms, document_scores, query_terms, restricted, top_k

BLOCK_SIZE = 128
RANGE = 4096


def block_maxima(postings: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """(term, block_no, min_doc, max_doc, block_max): blocks of ``block_size`` postings in the order of doc_id; negative scores count as 0."""
    if block_size < 1 or block_size & (block_size - 1):
        raise InvalidParameter("the block size must be a power of two")
    # places are counted in each range of ids, and the ranges' sizes added up, so a common term's postings needn't be in one task
    ranged = postings.withColumn("bucket", F.floor(F.col("doc_id") / RANGE))
    before = Window.partitionBy("term").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("term", "bucket").count().select("term", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("term", "bucket").orderBy("doc_id")) - 1
    blocks = ranged.withColumn("own", own).join(offsets, ["term", "bucket"]).withColumn("block_no", F.floor((F.col("before") + F.col("own")) / block_size))
    return blocks.groupBy("term", "block_no").agg(F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc"), F.max(F.greatest("score", F.lit(0).cast("float"))).alias("block_max"))


def term_maxima(postings: DataFrame) -> DataFrame:
    """(term, max_score); negative scores count as 0."""
    return postings.groupBy("term").agg(F.max(F.greatest("score", F.lit(0).cast("float"))).alias("max_score"))


def range_bounds(postings: DataFrame, width: int = RANGE) -> DataFrame:
    """(term, bucket, range_max, range_min): the greatest score of a term among the ``width`` documents of each range of ids, and the least; 0 where they are on the other side of it."""
    zero = F.lit(0).cast("float")
    ranged = postings.withColumn("bucket", F.floor(F.col("doc_id") / width))
    return ranged.groupBy("term", "bucket").agg(F.max(F.greatest("score", zero)).alias("range_max"), F.min(F.least("score", zero)).alias("range_min"))


def with_bounds(index: Index, width: int = RANGE) -> Index:
    """``index`` with its range bounds written, in the order of the terms: what ``search_pruned`` and ``search_approximate`` begin with."""
    bounds = range_bounds(index.postings, width).repartitionByRange("term", "bucket").sortWithinPartitions("term", "bucket")
    return replace(index, maxima=materialise(bounds, "maxima"), width=width)


def search_pruned(index: Index, queries: DataFrame, k: int = 10, width: int = RANGE, decimals: int | None = None) -> DataFrame:
    """The rows of ``search_batch``. Uses the bounds of ``with_bounds`` where the index has them, else computes them for ``width``."""
    check_k(k)
    if index.maxima is not None:
        width = index.width
    terms = materialise(query_terms(queries, index.tokenizer).select("query_id", "term", "qtf"), "query-terms")
    wanted = batch_terms(terms)
    ranges = restricted(index.maxima if index.maxima is not None else range_bounds(index.postings, width), wanted)
    postings = index.postings.select("term", "doc_id", F.col("score").cast("double").alias("s"))
    limits = ranges.groupBy("term").agg(F.max("range_max").alias("high"), F.min("range_min").alias("low"))
    # by bound, the greatest first: the terms that make up half of the sum give the score to be reached
    falling = Window.partitionBy("query_id").orderBy(F.desc("high"), "term")
    known = terms.join(limits, "term").join(restricted(index.terms, wanted), "term").select("query_id", "term", "qtf", "df", (F.col("qtf") * F.col("high").cast("double")).alias("high"), (F.col("qtf") * F.col("low").cast("double")).alias("low"))
    known = known.withColumn("before", F.sum("high").over(falling) - F.col("high")).withColumn("total", F.sum("high").over(Window.partitionBy("query_id")))
    known = materialise(known.withColumn("seed", F.col("before") * 2 <= F.col("total")), "query-limits")

    def scores(chosen: DataFrame) -> DataFrame:
        return postings.join(chosen.select("query_id", "term", "qtf"), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("s") * F.col("qtf")).alias("score"))

    # the k-th best score by seeds alone, less what other terms may take away
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    reached = scores(known.filter("seed")).withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("query_id", "score")
    taken = known.groupBy("query_id").agg(F.coalesce(F.sum(F.when(~F.col("seed"), F.col("low"))), F.lit(0.0)).alias("taken"))
    # sums in another order differ by some ulps
    least = reached.join(taken, "query_id").select("query_id", ((F.col("score") + F.col("taken")) * (1 - 1e-9)).alias("least")).filter("least > 0")
    least = materialise(least, "query-least")
    rising = Window.partitionBy("query_id").orderBy("high", F.desc("term"))
    split = known.join(least, "query_id", "left").withColumn("upto", F.sum("high").over(rising)).withColumn("common", F.coalesce(F.col("upto") < F.col("least"), F.lit(False)))
    split = materialise(split.select("query_id", "term", "qtf", "df", "common"), "query-split")
    spared, every = split.agg(F.coalesce(F.sum(F.when(F.col("common"), F.col("df"))), F.lit(0)), F.coalesce(F.sum("df"), F.lit(0))).first()
    if spared * 2 < every:
        # bounds spare less than half of the postings: looking up the rest would cost more
        return top_k(document_scores(index.postings, terms, index.stats.n_docs), k, decimals)
    common = split.filter("common").select("query_id", "term", "qtf")
    rest = ranges.join(common, "term").groupBy("query_id", "bucket").agg(F.sum(F.col("range_max").cast("double") * F.col("qtf")).alias("rest"))
    # a range without any common word has no row in ``rest``
    found = scores(split.filter("NOT common")).withColumn("bucket", F.floor(F.col("doc_id") / width)).join(least, "query_id", "left").join(rest, ["query_id", "bucket"], "left")
    near = materialise(found.filter("least IS NULL OR score + coalesce(rest, 0) >= least").select("query_id", "doc_id", "score"), "candidates")
    # where few are left, this table is small enough for Spark to broadcast it, and the postings of common words stay where they are
    wanted_now = materialise(near.select("query_id", "doc_id").join(common, "query_id"), "lookups")
    more = postings.join(wanted_now, ["term", "doc_id"]).select("query_id", "doc_id", (F.col("s") * F.col("qtf")).alias("score"))
    return top_k(near.unionByName(more).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score")), k, decimals)


def search_approximate(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """The search that is allowed to leave results out; this one never does. The index must have bounds."""
    if index.maxima is None:
        raise FeatureNotEnabled("the index has no bounds; make them with with_bounds")
    return search_pruned(index, queries, k)
