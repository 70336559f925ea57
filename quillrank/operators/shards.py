"""Search over shards: each ranks its own documents, and the best of all are merged.

Frequencies are added up by term, and documents and tokens over all shards, so the scores are those of one index. A shard can be
left out, as if it didn't answer; the result is then marked as degraded.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import check_k, single
from ..errors import InvalidParameter, ShardFailure
from ..functions import maths, scoring
from ..storage import materialise
from .index import Index, Stats, scored
from .search import batch_terms, document_scores, query_terms, restricted, top_k


@dataclass(frozen=True)
class ShardedResult:
    rows: DataFrame
    degraded: bool
    responded: int
    total: int


def shard_of(doc_id: Column, n_shards: int) -> Column:
    return F.pmod(doc_id, F.lit(n_shards)).cast("int")


def shard_frequencies(index: Index, n_shards: int) -> DataFrame:
    """(shard, term, df)."""
    return index.postings.groupBy(shard_of(F.col("doc_id"), n_shards).alias("shard"), "term").agg(F.count("*").alias("df"))


def global_idf(index: Index, n_shards: int) -> DataFrame:
    """(term, df, idf): frequencies of all shards added up by term, and the idf of all documents."""
    total = shard_frequencies(index, n_shards).groupBy("term").agg(F.sum("df").alias("df"))
    return total.withColumn("idf", scoring.idf(index.params.method, F.lit(index.stats.n_docs), F.col("df")))


def merge(candidates: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of every query among the candidates (query_id, doc_id, score) of all shards."""
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return candidates.filter("score > 0").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def search_shards(index: Index, queries: DataFrame, k: int = 10, n_shards: int = 4, multiplier: int = 2, silent: tuple[int, ...] = ()) -> ShardedResult:
    """Rows (query_id, rank, doc_id, score, shard): shards give their best k * multiplier, of which the best k stay. ``silent`` shards give nothing."""
    check_k(k)
    if n_shards < 1 or multiplier < 1:
        raise InvalidParameter("there must be a shard and a multiplier of at least 1")
    lost = {s for s in silent if 0 <= s < n_shards}
    if len(lost) == n_shards:
        raise ShardFailure("no shard answered")
    terms = query_terms(queries, index.tokenizer).select("query_id", "term", "qtf")
    rows = index.postings.withColumn("shard", shard_of(F.col("doc_id"), n_shards))
    if lost:
        rows = rows.filter(~F.col("shard").isin(*lost))
    rows = restricted(rows, batch_terms(terms))
    scores = rows.join(terms, "term").groupBy("query_id", "shard", "doc_id").agg(F.sum(F.col("score").cast("double") * F.col("qtf")).alias("score"))
    local = Window.partitionBy("query_id", "shard").orderBy(F.col("score").desc(), "doc_id")
    candidates = scores.filter("score > 0").withColumn("r", F.row_number().over(local)).filter(F.col("r") <= k * multiplier)
    merged = merge(candidates, k).select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", "shard")
    return ShardedResult(merged, bool(lost), n_shards - len(lost), n_shards)


def standardised(scores: DataFrame) -> DataFrame:
    """``scores`` (query_id, shard, ...) with each shard's z-scores: how shards without common statistics can be compared."""
    return maths.zscores(scores, "score", "query_id", "shard")


class Shard:
    """One shard as a service: an index of its own, whose documents count from ``offset``."""

    def __init__(self, index: Index, offset: int = 0) -> None:
        self.index, self.offset = index, offset
        self._whole: tuple[DataFrame, Stats] | None = None

    def health(self) -> dict:
        return {"healthy": True, "num_docs": self.index.stats.n_docs}

    def collect_idf(self) -> tuple[DataFrame, Stats]:
        """(term, df) and statistics of this shard."""
        return self.index.terms, self.index.stats

    def apply_idf(self, terms: DataFrame, stats: Stats) -> None:
        """Scores are by these frequencies and statistics from now on."""
        self._whole = terms, stats

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score): the best ``k`` of each query, ids counted over all shards."""
        terms = query_terms(queries, self.index.tokenizer)
        wanted = batch_terms(terms)
        postings = restricted(self.index.postings, wanted)
        if self._whole is not None:
            postings = scored(postings.drop("df", "score").join(restricted(self._whole[0], wanted), "term"), self.index.params, self._whole[1])
        return top_k(document_scores(postings, terms, self.index.stats.n_docs), k).select("query_id", (F.col("doc_id") + self.offset).alias("doc_id"), "score")


class Coordinator:
    """Asks several shards and merges their answers. Shards that fail are left out, and the result is then degraded."""

    def __init__(self, shards: list[Shard], multiplier: int = 2, timeout: float = 30.0) -> None:
        if not shards or multiplier < 1 or timeout <= 0:
            raise InvalidParameter("there must be a shard, a multiplier of at least 1 and a positive timeout")
        self.shards, self.multiplier, self.timeout = shards, multiplier, timeout
        self.ready = False

    def health(self) -> list[dict]:
        return [self._ask(s.health) or {"healthy": False} for s in self.shards]

    def _ask(self, what, *given):
        """What a shard answers within the time, None for one that fails."""
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(what, *given).result(self.timeout)
        except Exception:
            return None
        finally:
            pool.shutdown(wait=False)

    def prepare(self) -> None:
        """Collects frequencies and statistics of all shards, adds them up, and gives the sums to all."""
        found = [x for s in self.shards if (x := self._ask(s.collect_idf)) is not None]
        if not found:
            raise ShardFailure("no shard answered")
        rows = found[0][0].select("term", "df")
        for terms, _ in found[1:]:
            rows = rows.unionByName(terms.select("term", "df"))
        terms = materialise(rows.groupBy("term").agg(F.sum("df").alias("df")), "terms")
        n, tokens = sum(s.n_docs for _, s in found), sum(s.n_tokens for _, s in found)
        stats = Stats(n, tokens, single(single(tokens) / single(n)) if n else 0.0)
        for s in self.shards:
            self._ask(s.apply_idf, terms, stats)
        self.ready = True

    def search(self, queries: DataFrame, k: int = 10) -> ShardedResult:
        check_k(k)
        if not self.ready:
            self.prepare()
        found = [x for s in self.shards if (x := self._ask(s.search, queries, k * self.multiplier)) is not None]
        if not found:
            raise ShardFailure("no shard answered")
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        merged = merge(rows, k).select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        return ShardedResult(merged, len(found) < len(self.shards), len(found), len(self.shards))
