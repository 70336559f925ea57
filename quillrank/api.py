"""The short way in: an index over a list of texts or a DataFrame, searched by text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Params
from .errors import NotBuilt
from .functions.text import Tokenizer
from .operators import index as ix
from .operators import prune
from .operators import search as se
from .sources import store


class Retriever:
    """``Retriever(spark, "lucene", k1=1.2).index(texts).search("a query", 5)``"""

    def __init__(self, spark: SparkSession, method: str = "lucene", k1: float = 1.5, b: float = 0.75, delta: float = 0.5, tokenizer: Tokenizer | None = None, cache_capacity: int = 0) -> None:
        self.spark, self.params, self.tokenizer = spark, Params(method, k1, b, delta), tokenizer or Tokenizer()
        self.cache = se.QueryCache(cache_capacity)
        self._index: ix.Index | None = None

    @property
    def held(self) -> ix.Index:
        if self._index is None:
            raise NotBuilt("there is no index yet")
        return self._index

    def index(self, docs: list[str] | DataFrame) -> Retriever:
        """Texts are numbered from 0; a DataFrame has doc_id and text."""
        if not isinstance(docs, DataFrame):
            docs = self.spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
        self._index = ix.build(docs, self.params, self.tokenizer)
        self.cache.clear()
        return self

    def index_tokens(self, docs: list[list[str]]) -> Retriever:
        """Documents that are tokens already."""
        rows = self.spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, tokens array<string>")
        self._index = ix.build(rows, self.params, self.tokenizer, tokens="tokens")
        self.cache.clear()
        return self

    def with_bounds(self, width: int = prune.RANGE) -> Retriever:
        """Prepares the index for ``approximate`` searches."""
        self._index = prune.with_bounds(self.held, width)
        return self

    def search(self, text: str, k: int = 10, approximate: bool = False) -> tuple[list[int], list[float]]:
        """``approximate`` leaves out ranges of documents by their bounds; its results are those of any search, but an index without bounds refuses it."""
        if approximate:
            queries = self.spark.createDataFrame([(0, text)], "query_id long, text string")
            rows = prune.search_approximate(self.held, queries, k).orderBy("rank").collect()
        else:
            rows = se.search_cached(self.held, self.cache, text, k)
        return [r["doc_id"] for r in rows], [r["score"] for r in rows]

    def search_numpy(self, text: str, k: int = 10) -> tuple[np.ndarray, np.ndarray]:
        ids, scores = self.search(text, k)
        return np.array(ids, np.int64), np.array(scores, np.float32)

    def search_batch(self, texts: list[str], k: int = 10) -> list[tuple[list[int], list[float]]]:
        """Results in the order of the texts, in one job."""
        if not texts:
            return []
        queries = self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, text string")
        out: list[tuple[list[int], list[float]]] = [([], []) for _ in texts]
        for r in se.search_batch(self.held, queries, k).orderBy("query_id", "rank").collect():
            out[r["query_id"]][0].append(r["doc_id"])
            out[r["query_id"]][1].append(r["score"])
        return out

    def scores(self, text: str) -> DataFrame:
        """(doc_id, score) of every document."""
        return se.dense_scores(self.held, self.spark.createDataFrame([(0, text)], "query_id long, text string")).drop("query_id")

    def names(self, ids: list[int]) -> list[str | int]:
        """The documents' own names, where they were strings."""
        if self.held.ids is None:
            return list(ids)
        found = {r["doc_id"]: r["name"] for r in self.held.ids.filter(F.col("doc_id").isin(list(ids))).collect()}
        return [found[i] for i in ids]

    def save(self, path: str) -> None:
        store.save(self.held, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Retriever:
        index = store.load(spark, path)
        p = index.params
        out = Retriever(spark, p.method, p.k1, p.b, p.delta, index.tokenizer)
        out._index = index
        return out

    def stats(self) -> dict:
        s = self.held.stats
        return {"num_docs": s.n_docs, "vocab_size": self.held.terms.count(), "avg_doc_len": s.mean_length, "method": self.params.label, "k1": self.params.k1, "b": self.params.b, "delta": self.params.delta}

    def __repr__(self) -> str:
        state = f"{self._index.stats.n_docs} documents" if self._index else "no index"
        return f"Retriever({self.params.label}, k1={self.params.k1:g}, b={self.params.b:g}, {state})"
