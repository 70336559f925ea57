"""Ranked search of many queries at once: query terms meet postings in a join, scores are summed by query and document.

A single query is a batch of one. Equal scores rank by doc_id, everywhere.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import check_k
from ..functions import scoring
from ..functions.text import Tokenizer
from ..storage import SENT_ROWS, materialise, sent
from .index import Index

#: So few terms go to the scan as literals, which reach the row groups. More are a written table, whose size tells Spark whether to broadcast it.
TERM_LIMIT = 64
#: Pairs of a query and a document that a task may hold, and the most tasks.
PAIRS, MOST_PARTS = 1_000_000, 4_000


def query_terms(queries: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(query_id, term, qtf, pos) of queries (query_id, text): how often a term stands in the query, and where first."""
    found = queries.select("query_id", F.posexplode(tokenizer.tokens(F.col("text"))).alias("pos", "term"))
    return found.groupBy("query_id", "term").agg(F.count("*").alias("qtf"), F.min("pos").alias("pos"))


def batch_terms(terms: DataFrame) -> list[str] | DataFrame:
    """The distinct terms of a batch: a list of up to ``TERM_LIMIT``, or a written table (term)."""
    distinct = terms.select("term").distinct()
    found = [r[0] for r in distinct.limit(TERM_LIMIT + 1).collect()]
    return found if len(found) <= TERM_LIMIT else materialise(distinct, "terms")


def restricted(rows: DataFrame, terms: list[str] | DataFrame | None) -> DataFrame:
    """``rows`` of these terms; None for all."""
    if terms is None:
        return rows
    return rows.filter(F.col("term").isin(terms)) if isinstance(terms, list) else rows.join(terms, "term", "left_semi")


def by_document(postings: DataFrame, terms: DataFrame, docs: int, on: str | list[str] = "term") -> DataFrame:
    """``postings`` joined with a batch's ``terms`` (query_id, term, ...) such that those of a document are in one task: each is shuffled once, however many
    queries ask for it, and what is computed by query and document needs no shuffle of its own. A batch too large to send is joined as Spark sees fit."""
    n, queries = terms.agg(F.count("*"), F.countDistinct("query_id")).first()
    if n > SENT_ROWS:
        return postings.join(terms, on)
    pairs = docs * queries
    parts = max(1, -(-pairs // PAIRS), min(terms.sparkSession.sparkContext.defaultParallelism, -(-pairs * 20 // PAIRS)))
    return postings.join(F.broadcast(terms.select(on).distinct()), on, "left_semi").repartition(min(parts, MOST_PARTS), "doc_id").join(F.broadcast(terms), on)


def document_scores(postings: DataFrame, terms: DataFrame, docs: int) -> DataFrame:
    """(query_id, doc_id, score): double sums over the query's tokens. Unknown terms fall out of the join; repeated ones count again. ``docs``: about how
    many documents there are."""
    met = by_document(postings.select("term", "doc_id", "score"), terms.select("query_id", "term", "qtf"), docs)
    return met.groupBy("query_id", "doc_id").agg(F.sum(F.col("score").cast("double") * F.col("qtf")).alias("score"))


def single_scores(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score): sums in single precision, rarest term first, terms of one frequency in the query's order; of the documents that may be
    among a query's ``k`` best.

    A single-precision sum of n numbers is within n ulps of their absolute sum from the double one, so documents that can't reach the k-th best are left
    out before the numbers of the others are put in order.
    """
    found = materialise(queries.select("query_id", F.posexplode(index.tokenizer.tokens(F.col("text"))).alias("pos", "term")), "query-terms")
    terms = found.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    met = by_document(index.postings.select("term", "doc_id", F.col("score").cast("double").alias("s")), terms, index.stats.n_docs)
    sums = met.groupBy("query_id", "doc_id").agg(F.sum(F.col("s") * F.col("qtf")).alias("score"), (F.sum(F.abs("s") * F.col("qtf")) * F.sum("qtf") * 2.0**-23).alias("off"))
    best = Window.partitionBy("query_id").orderBy(F.desc("low"))
    lows = sums.select("query_id", (F.col("score") - F.col("off")).alias("low")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    least = materialise(lows.filter(F.col("r") == k).select("query_id", F.col("low").alias("least")), "query-least")
    near = sums.join(sent(least, least.count()), "query_id", "left").filter("least IS NULL OR score + off >= least").select("query_id", "doc_id")
    wanted = materialise(near.join(found, "query_id"), "lookups")
    again = index.postings.select("term", "doc_id", "df", "score").join(sent(wanted, wanted.count()), ["term", "doc_id"])
    return again.groupBy("query_id", "doc_id").agg(scoring.ordered_sum(F.collect_list(F.struct("df", "pos", "score"))).alias("score"))


def top_k(scores: DataFrame, k: int, decimals: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): each query's ``k`` best of the scores above 0. ``decimals``: compare scores as rounded."""
    key = F.col("score") if decimals is None else F.round("score", decimals)
    by = Window.partitionBy("query_id").orderBy(key.desc(), "doc_id")
    ranked = scores.filter("score > 0").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search_batch(index: Index, queries: DataFrame, k: int = 10, exact_single: bool = False, decimals: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score) of queries (query_id, text). A query without known terms has no rows."""
    check_k(k)
    if exact_single:
        return top_k(single_scores(index, queries, k), k, decimals)
    return top_k(document_scores(index.postings, materialise(query_terms(queries, index.tokenizer), "query-terms"), index.stats.n_docs), k, decimals)


def search_tokens(index: Index, tokens: list[str], k: int = 10) -> DataFrame:
    """(rank, doc_id, score) of one query given as tokens. The terms are literals, so only their row groups are read."""
    check_k(k)
    times: dict[str, int] = {}
    for t in tokens:
        times[t] = times.get(t, 0) + 1
    if not times:
        rows = index.postings.limit(0)
        factor = F.lit(1)
    else:
        rows = index.postings.filter(F.col("term").isin(*times))
        factor = F.lit(1)
        for t, n in times.items():
            if n > 1:
                factor = F.when(F.col("term") == t, n).otherwise(factor)
    scores = rows.groupBy("doc_id").agg(F.sum(F.col("score").cast("double") * factor).alias("score")).filter("score > 0")
    best = scores.orderBy(F.col("score").desc(), "doc_id").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id")).alias("rank"), "doc_id", "score")


def tokens_of(index: Index, text: str) -> list[str]:
    spark = index.postings.sparkSession
    return spark.createDataFrame([(text,)], "text string").select(index.tokenizer.tokens(F.col("text"))).first()[0]


def search(index: Index, text: str, k: int = 10) -> DataFrame:
    """(rank, doc_id, score) of one query."""
    check_k(k)
    return search_tokens(index, tokens_of(index, text), k)


def dense_scores(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) for every query and every document, 0 where they share no term."""
    # every document bears a posting of 0 that all queries ask for
    ids = queries.select("query_id").distinct()
    asked = query_terms(queries, index.tokenizer).select("query_id", "term", "qtf", F.lit(False).alias("every"))
    asked = materialise(asked.unionByName(ids.select("query_id", F.lit("").alias("term"), F.lit(1).cast("long").alias("qtf"), F.lit(True).alias("every"))), "query-terms")
    rows = index.postings.select("term", "doc_id", "score", F.lit(False).alias("every"))
    rows = rows.unionByName(index.lengths.select(F.lit("").alias("term"), "doc_id", F.lit(0).cast("float").alias("score"), F.lit(True).alias("every")))
    met = by_document(rows, asked, index.stats.n_docs, ["every", "term"])
    return met.groupBy("query_id", "doc_id").agg(F.sum(F.col("score").cast("double") * F.col("qtf")).alias("score"))


def postings_of(index: Index, term: str) -> DataFrame:
    """A term's postings by document; one range of files is read."""
    return index.postings.filter(F.col("term") == term).orderBy("doc_id")


class QueryCache:
    """The results of the last ``capacity`` different queries; 0 keeps none. Keyed by the query's text and k, so not aware of updates."""

    def __init__(self, capacity: int = 0) -> None:
        self.capacity = capacity
        self._held: OrderedDict[tuple[str, int], list] = OrderedDict()

    def __len__(self) -> int:
        return len(self._held)

    def get(self, text: str, k: int) -> list | None:
        if (text, k) not in self._held:
            return None
        self._held.move_to_end((text, k))
        return self._held[text, k]

    def put(self, text: str, k: int, rows: list) -> None:
        if self.capacity < 1:
            return
        self._held[text, k] = rows
        self._held.move_to_end((text, k))
        while len(self._held) > self.capacity:
            self._held.popitem(last=False)

    def clear(self) -> None:
        self._held.clear()


def search_cached(index: Index, cache: QueryCache, text: str, k: int = 10) -> list:
    """Rows of ``search``, from the cache where they are in it."""
    found = cache.get(text, check_k(k))
    if found is None:
        found = search(index, text, k).orderBy("rank").collect()
        cache.put(text, k, found)
    return found
