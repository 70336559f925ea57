"""Feeding documents in parts: chunks from the driver, or a stream of files."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Params
from ..errors import EmptyCorpus, InvalidParameter
from ..functions.text import Tokenizer
from ..operators.index import Index, build
from ..storage import new_path
from .updates import UpdateLog


class ChunkedBuilder:
    """Collects documents chunk by chunk in the shared folder; ``build`` gives what one build of all would."""

    def __init__(self, spark: SparkSession, params: Params | None = None, tokenizer: Tokenizer | None = None, chunk_size: int = 100_000) -> None:
        if chunk_size < 1:
            raise InvalidParameter("chunk_size must be at least 1")
        self.spark, self.params, self.tokenizer, self.chunk_size = spark, params, tokenizer, chunk_size
        self.path = new_path(spark, "chunks")
        self.n_docs = 0
        self._held: list[str | None] = []

    def add_documents(self, texts: Iterable[str | None]) -> ChunkedBuilder:
        """More documents, from any iterable; a chunk is written whenever there are enough."""
        for text in texts:
            self._held.append(text)
            if len(self._held) >= self.chunk_size:
                self._flush()
        return self

    def _flush(self) -> None:
        if self._held:
            rows = [(self.n_docs + i, t) for i, t in enumerate(self._held)]
            self.spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(self.path)
            self.n_docs += len(self._held)
            self._held = []

    def build(self) -> Index:
        self._flush()
        if not self.n_docs:
            raise EmptyCorpus("an index needs at least one document")
        return build(self.spark.read.schema("doc_id long, text string").parquet(self.path), self.params, self.tokenizer)


def follow(stream: DataFrame, log: UpdateLog, checkpoint: str, order: list[str] | None = None):
    """Appends every micro-batch of a stream (text) to the log, and takes what is there now: the running query.

    The rows of a batch bear the stream's id (which its checkpoint holds) and the batch's number in the same append, so a batch that is tried
    again after any failure isn't added twice, and several streams may feed one log.
    """
    spark = log.spark

    def add(batch: DataFrame, number: int) -> None:
        name = json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]
        log.append_documents(batch.select(F.col("text"), *[c for c in order or [] if c != "text"]), order, (name, number))

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
