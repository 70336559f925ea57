"""Adding and deleting documents without building the index anew: a log of operations beside it.

The log is a table of rows (seq, generation, op, doc_id, content, stream, batch); one commit is one Parquet append, so it is there as a whole or not at
all. Rows that a stream's micro-batch brought bear its mark. Additions are tokenised once: their counts are kept beside the log.
Searches see base postings and those of added documents, without deleted ones. Three strategies tell how they are scored:

* ``fast``: all scores by the statistics of the base index; a new term counts as if one document held it.
* ``exact``: frequencies and number of documents as they are now, lengths against the base's mean.
* ``rebuild``: everything as an index built now would have it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import check_k
from ..errors import EmptyCorpus, InvalidParameter, LogState
from ..functions import scoring
from ..operators.index import Index, Stats, corpus_stats, document_frequencies, flat_counts, laid_out, lengths_of, scored, token_counts
from ..operators.numbering import numbered, ranks
from ..operators.search import batch_terms, document_scores, query_terms, restricted, top_k
from ..storage import materialise, new_path, sent

SCHEMA = "seq long, generation long, op string, doc_id long, content string, stream string, batch long"
STRATEGIES = ("fast", "exact", "rebuild")


@dataclass(frozen=True)
class DeleteReport:
    """How many documents were deleted, and the ids that weren't there: unknown, deleted before, or named twice."""

    deleted: int
    not_found: list[int]


class UpdateLog:
    def __init__(self, index: Index, path: str | None = None, threshold: float = 0.10) -> None:
        """``path``: a folder of Parquet files; what it holds is replayed. Without it the log lives in the shared folder."""
        self.index, self.threshold = index, threshold
        self.spark: SparkSession = index.postings.sparkSession
        self.path = path or new_path(self.spark, "log")
        self._staged: list[DataFrame] | None = None
        #: Counts of the additions up to a generation, and what was computed for the last one.
        self._counts: tuple[int, DataFrame | None] = (0, None)
        self._now: tuple[int, dict] = (-1, {})
        self.generation = 0
        self._next_id = (index.lengths.agg(F.max("doc_id")).first()[0] if index.stats.n_docs else -1) or 0
        self._next_id += 1
        if path is None or not self._exists():
            self.spark.createDataFrame([], SCHEMA).write.mode("append").parquet(self.path)
        seen = self.log().agg(F.max("generation"), F.max(F.when(F.col("op") == "add", F.col("doc_id"))), F.max("seq")).first()
        self.generation = seen[0] or 0
        self._next_id = max(self._next_id, (seen[1] if seen[1] is not None else -1) + 1)
        self._seq = (seen[2] if seen[2] is not None else -1) + 1

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def log(self) -> DataFrame:
        """All committed operations."""
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def _commit(self, rows: DataFrame) -> None:
        rows.withColumn("generation", F.lit(self.generation).cast("long")).select("seq", "generation", "op", "doc_id", "content", "stream", "batch").write.mode("append").parquet(self.path)

    def _record(self, rows: DataFrame, n: int, mark: tuple[str, int] | None = None) -> None:
        """``rows`` (place, op, doc_id, content): committed at once, or staged in a batch."""
        stream, batch = mark or (None, None)
        rows = rows.select((F.col("place") + F.lit(self._seq)).cast("long").alias("seq"), "op", "doc_id", "content", F.lit(stream).cast("string").alias("stream"), F.lit(batch).cast("long").alias("batch"))
        self._seq += n
        if self._staged is None:
            self.generation += 1
            self._commit(rows)
        else:
            self._staged.append(rows)

    def append_documents(self, docs: DataFrame, order: list[str] | None = None, mark: tuple[str, int] | None = None) -> tuple[int, int]:
        """Adds the texts of ``docs`` (text) in the order of the columns named (default: text); gives the first id and the one after the last.

        ``mark``: a stream and the number of its micro-batch, kept with the rows. One that the log has already adds nothing.
        """
        if mark is not None and not self._visible().filter((F.col("stream") == mark[0]) & (F.col("batch") == mark[1])).isEmpty():
            return self._next_id, self._next_id
        rows = numbered(docs, order or ["text"], "place")
        rows = materialise(rows.select("place", F.lit("add").alias("op"), (F.col("place") + self._next_id).alias("doc_id"), F.coalesce("text", F.lit("")).alias("content")), "added")
        n = rows.count()
        first, self._next_id = self._next_id, self._next_id + n
        if n:
            self._record(rows, n, mark)
        return first, first + n

    def append_texts(self, texts: list[str]) -> list[int]:
        """Adds a few texts in their order; their ids."""
        rows = self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
        return list(range(*self.append_documents(rows, ["i"])))

    def _visible(self) -> DataFrame:
        rows = self.log()
        for more in self._staged or []:
            rows = rows.unionByName(more.withColumn("generation", F.lit(self.generation).cast("long")))
        return rows

    def delete_documents(self, ids: list[int]) -> DeleteReport:
        """Marks documents as deleted. Ids that aren't live are reported, not an error."""
        wanted = self.spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "place long, doc_id long")
        rows = self._visible()
        known = self.index.lengths.select("doc_id").unionByName(rows.filter("op = 'add'").select("doc_id"))
        live = wanted.select("doc_id").distinct().join(known, "doc_id", "left_semi").join(rows.filter("op = 'delete'"), "doc_id", "left_anti")
        found = {r[0] for r in live.collect()}
        seen: set[int] = set()
        missing = []
        for x in map(int, ids):
            if x in found and x not in seen:
                seen.add(x)
            else:
                missing.append(x)
        if seen:
            gone = self.spark.createDataFrame([(i, x) for i, x in enumerate(sorted(seen))], "place long, doc_id long")
            self._record(gone.select("place", F.lit("delete").alias("op"), "doc_id", F.lit(None).cast("string").alias("content")), len(seen))
        return DeleteReport(len(seen), missing)

    def delete_frame(self, ids: DataFrame) -> DataFrame:
        """Deletes the documents of ``ids`` (doc_id), however many; (doc_id, deleted) for each distinct id, false where it wasn't live."""
        rows = self._visible()
        known = self.index.lengths.select("doc_id").unionByName(rows.filter("op = 'add'").select("doc_id"))
        wanted = ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
        live = wanted.join(known.distinct(), "doc_id", "left_semi").join(rows.filter("op = 'delete'"), "doc_id", "left_anti")
        gone = materialise(numbered(live, ["doc_id"], "place"), "deleted")
        n = gone.count()
        if n:
            self._record(gone.select("place", F.lit("delete").alias("op"), "doc_id", F.lit(None).cast("string").alias("content")), n)
        return wanted.join(gone.select("doc_id", F.lit(True).alias("deleted")), "doc_id", "left").select("doc_id", F.coalesce("deleted", F.lit(False)).alias("deleted"))

    def begin_batch(self) -> None:
        """What follows is invisible until ``commit_batch``. Beginning again drops what was staged."""
        self._staged = []

    def commit_batch(self) -> None:
        if self._staged is None:
            raise LogState("there is no batch to commit")
        staged, self._staged = self._staged, None
        if staged:
            rows = staged[0]
            for more in staged[1:]:
                rows = rows.unionByName(more)
            self.generation += 1
            self._commit(rows)

    def rollback_batch(self) -> None:
        self._staged = None

    def added(self) -> DataFrame:
        """(doc_id, text) of committed additions, also of those deleted since."""
        return self.log().filter("op = 'add'").select("doc_id", F.col("content").alias("text"))

    def deleted(self) -> DataFrame:
        return self.log().filter("op = 'delete'").select("doc_id").distinct()

    def added_count(self) -> int:
        return self.added().count()

    def deleted_count(self) -> int:
        return self.deleted().count()

    def is_deleted(self, doc_id: int) -> bool:
        return not self.deleted().filter(F.col("doc_id") == doc_id).isEmpty()

    def live_count(self) -> int:
        return self.index.stats.n_docs + self.added_count() - self.deleted_count()

    def is_empty(self) -> bool:
        return self.log().isEmpty()

    def __len__(self) -> int:
        return self.log().count()

    def should_compact(self) -> bool:
        """Whether additions reach the threshold's share of the base."""
        return self.index.stats.n_docs > 0 and self.added_count() >= self.threshold * self.index.stats.n_docs

    def _added_counts(self) -> DataFrame:
        """``token_counts`` of committed additions: what was added since the last time is tokenised and written."""
        upto, held = self._counts
        if held is None or upto < self.generation:
            more = self.log().filter((F.col("op") == "add") & (F.col("generation") > upto)).select("doc_id", F.col("content").alias("text"))
            more = materialise(token_counts(more, self.index.tokenizer), "added-counts")
            held = more if held is None else held.unionByName(more)
            self._counts = self.generation, held
        return held

    def _stats(self) -> Stats:
        """Of the live documents, computed once a generation."""
        if self._now[0] != self.generation:
            self._now = self.generation, {}
        if "stats" not in self._now[1]:
            self._now[1]["stats"] = Stats(*corpus_stats(self._live_counts()[1]).first())
        return self._now[1]["stats"]

    def _live_counts(self) -> tuple[DataFrame, DataFrame]:
        """Live (term, doc_id, tf, doc_len, added) and (doc_id, doc_len)."""
        fresh = self._added_counts()
        new = flat_counts(fresh).withColumn("added", F.lit(True))
        base = self.index.postings.select("term", "doc_id", "tf", "doc_len").withColumn("added", F.lit(False))
        lengths = self.index.lengths.unionByName(lengths_of(fresh))
        gone = materialise(self.deleted(), "gone")
        gone = sent(gone, gone.count())
        return base.unionByName(new).join(gone, "doc_id", "left_anti"), lengths.join(gone, "doc_id", "left_anti")

    def _known(self, frequencies: DataFrame, terms: list[str] | DataFrame | None) -> DataFrame:
        """(term, df) of some terms, written, so that Spark knows how few they are; as it is for all terms."""
        return frequencies if terms is None else materialise(restricted(frequencies, terms), "frequencies")

    def live_postings(self, strategy: str = "fast", terms: list[str] | DataFrame | None = None) -> DataFrame:
        """(term, doc_id, tf, doc_len, df, score) of the live documents, of some terms only if these are named."""
        if strategy not in STRATEGIES:
            raise InvalidParameter(f"unknown strategy {strategy!r}; known are {', '.join(STRATEGIES)}")
        rows = restricted(self._live_counts()[0], terms)
        base = self.index.stats
        if strategy == "fast":
            known = rows.join(self._known(self.index.terms, terms), "term", "left").withColumn("df", F.greatest(F.coalesce("df", F.lit(0)), F.lit(1)))
            return scored(known.drop("added"), self.index.params, base)
        live = self._known(document_frequencies(rows), terms)
        stats = self._stats()
        if strategy == "exact":
            stats = replace(stats, mean_length=base.mean_length)
        return scored(rows.drop("added").join(live, "term"), self.index.params, stats)

    def search(self, queries: DataFrame, k: int = 10, strategy: str = "fast", decimals: int | None = None) -> DataFrame:
        """(query_id, rank, doc_id, score) of queries (query_id, text) over the live documents. Only postings of their terms are scored."""
        check_k(k)
        terms = materialise(query_terms(queries, self.index.tokenizer), "query-terms")
        return top_k(document_scores(self.live_postings(strategy, batch_terms(terms)), terms, self.index.stats.n_docs), k, decimals)

    def compact(self, partitions: int | None = None) -> tuple[Index, DataFrame]:
        """A new index of the live documents, and (old_id, doc_id). New ids count from 0 in the order of the old; scores are those of an index built now.

        The log is left behind with the old index; ``UpdateLog`` of the new one begins empty.
        """
        lengths = self._live_counts()[1]
        held, place, lives = ranks(lengths, "doc_id")
        ids = materialise(lengths.withColumn("rank_bucket", F.shiftright("doc_id", 6)).join(held, "rank_bucket").select(F.col("doc_id").alias("old_id"), place.alias("new_id"), "doc_len"), "compacted")
        stats = Stats(*corpus_stats(ids).first())
        if not stats.n_docs:
            raise EmptyCorpus("compaction would leave no document")
        # postings of documents that aren't live have no rank, so the deleted ones needn't be taken away before
        rows = self.index.postings.select("term", "doc_id", "tf", "doc_len").unionByName(flat_counts(self._added_counts()))
        rows = rows.withColumn("rank_bucket", F.shiftright("doc_id", 6)).join(held, "rank_bucket").filter(lives).select("term", place.alias("doc_id"), "tf", "doc_len")
        terms = materialise(document_frequencies(rows), "terms")
        postings = laid_out(rows, terms, self.index.params, stats, partitions)
        index = Index(postings, ids.select(F.col("new_id").alias("doc_id"), "doc_len"), terms, stats, self.index.params, self.index.tokenizer)
        return index, ids.select("old_id", F.col("new_id").alias("doc_id"))
