"""Queries of the ways in and out: files of every format, stored indexes, streams, logs, options and services, with the SQL that must give the same rows.

What a reader is to read is written from the tables first, whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Params, parse_method
from ..errors import InvalidParameter
from ..functions import maths
from ..functions.text import Tokenizer
from ..operators import evaluate, prune, shards
from ..operators import index as ix
from ..operators import search as se
from ..sources import readers, store, synthetic
from ..storage import new_path
from ..streaming.ingest import ChunkedBuilder, follow
from ..streaming.updates import UpdateLog
from . import queries as core
from . import sql

K = core.K


def _hashed(df: DataFrame, text: str = "text") -> DataFrame:
    """(h, n): how often each text is there, by its hash."""
    return df.groupBy(F.md5(text).alias("h")).agg(F.count("*").alias("n"))


def _written(df: DataFrame, name: str, kind: str, **options: object) -> str:
    path = f"{new_path(df.sparkSession, name)}"
    df.write.options(**options).format(kind).save(path)
    return path


def read_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array of objects."""
    rows = core._table(spark, sf_dir, "nation").orderBy("n_nationkey").agg(F.to_json(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("value"))
    return readers.read_json(spark, _written(rows.coalesce(1), "array", "text"), "n_name").groupBy("text").agg(F.count("*").alias("n"))


def read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(readers.read_jsonl(spark, _written(core._table(spark, sf_dir, "documents").select("text", "lang"), "lines", "json"), "text"))


def _csv(sep: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = core._table(spark, sf_dir, "documents").select("doc_id", "text", "source")
        # Spark's writer takes white space off the ends of values if it isn't told to keep it
        path = _written(docs, "csv", "csv", header=True, sep=sep, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue=readers.NO_VALUE)
        return _hashed(readers.read_csv(spark, path, "text", sep))

    return run


def read_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of ``documents`` as a document."""
    return _hashed(readers.read_text(spark, _written(core._table(spark, sf_dir, "documents").select("text"), "text", "text")))


def read_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which every other one is JSON."""
    docs = core._table(spark, sf_dir, "documents").select(F.regexp_replace("text", "[\\n\\r]", " ").alias("text"), "doc_id")
    lines = docs.filter(F.trim("text") != "").select(F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct("text"))).otherwise(F.col("text")).alias("value"))
    return _hashed(readers.read_loose(spark, _written(lines, "loose", "text")))


def _beir(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """Paths of a corpus with string ids, of queries, and of judgements, which call a document relevant to a passage that it contains."""
    docs, items = core._table(spark, sf_dir, "documents"), core._table(spark, sf_dir, "benchmark")
    corpus = docs.select(F.concat(F.lit("D-"), "doc_id").alias("_id"), F.lit("").alias("title"), "text")
    queries = items.select(F.concat(F.lit("Q"), "item_id").alias("_id"), "text")
    judged = core.qrels(spark, sf_dir).select(F.concat(F.lit("Q"), "query_id").alias("query-id"), F.concat(F.lit("D-"), "doc_id").alias("corpus-id"), F.col("grade").alias("score"))
    return _written(corpus, "corpus", "json"), _written(queries, "queries", "json"), _written(judged, "qrels", "csv", header=True, sep="\t")


def beir_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of string ids, indexed, searched and judged, all from files."""
    corpus, queries, judged = core._once(spark, sf_dir, "beir", lambda: _beir(spark, sf_dir))
    index = core._once(spark, sf_dir, "beir-index", lambda: ix.build(readers.read_beir_corpus(spark, corpus)))
    # ids are numbered in the order of the strings, so equal scores rank by them
    found = index.named(se.search_batch(index, readers.read_beir_queries(spark, queries), K, decimals=6))
    return evaluate.ndcg(found, readers.read_qrels(spark, judged), K).select("query_id", F.round("ndcg", 6).alias("ndcg"))


def read_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = core._table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).select(F.lit("q").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("quality").alias("score"))
    return readers.read_qrels(spark, _written(rows, "labels", "csv", header=True, sep="\t")).select("query_id", "doc_id", F.col("grade").cast("long").alias("grade"))


_NAMES = {"a.JSON": "json", "b.ndjson": "jsonl", "c.jsonl": "jsonl", "d.csv": "csv", "e.TSV": "tsv", "f.txt": "text", "g": "text", "x.y/h.parquet": "parquet", "i.json.bak": "text"}


def detected_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, readers.detect_format(n)) for n in _NAMES], "name string, format string")


_METHODS = {"BM25+": "bm25plus", "bm25L": "bm25l", " Atire ": "atire", "LUCENE": "lucene", "robertson": "robertson", "tfidf": "error", "": "error"}


def method_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    def parse(name: str) -> str:
        try:
            return parse_method(name)
        except InvalidParameter:
            return "error"

    return spark.createDataFrame([(n, parse(n)) for n in _METHODS], "name string, method string")


_PARAMS = [("lucene", 1.5, 0.75, 0.5, True), ("lucene", -0.1, 0.75, 0.5, False), ("lucene", 0.0, 0.0, 0.5, True), ("atire", 1.5, 1.01, 0.5, False), ("bm25l", 1.5, 0.75, -0.5, False), ("lucene", 1.5, 0.75, -0.5, True), ("bm25plus", 1.5, 1.0, 0.0, True), ("robertson", 1.5, -0.01, 0.5, False)]


def parameter_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def good(*given) -> bool:
        try:
            return Params(*given) is not None
        except InvalidParameter:
            return False

    return spark.createDataFrame([(*p[:4], good(*p[:4])) for p in _PARAMS], "method string, k1 double, b double, delta double, good boolean")


def byte_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of documents, and of as many thousands and millions of them, for people to read."""
    sizes = core._table(spark, sf_dir, "documents").select(F.explode(F.array(*[F.col("n_chars") * F.lit(x) for x in (1, 1000, 1_000_000)])).alias("n")).distinct()
    return sizes.select("n", maths.bytes_label(F.col("n")).alias("label"))


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index saved twice, loaded and searched."""
    path = new_path(spark, "stored")
    store.save(core.corpus_index(spark, sf_dir), path)
    store.save(core.corpus_index(spark, sf_dir), path)
    return core._best(se.search_batch(store.load(spark, path), core.query_set(spark, sf_dir), K, decimals=6))


def tokenised_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of tokens that were split elsewhere."""
    docs = core._table(spark, sf_dir, "documents").select("doc_id", Tokenizer().tokens(F.col("text")).alias("words"))
    return core._best(se.search_batch(ix.build(docs, tokens="words"), core.query_set(spark, sf_dir), K, decimals=6))


def custom_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of the caller's: what stands between spaces."""
    found = Tokenizer(custom=lambda s: s.split(" ")).tokens(F.col("text"))
    return core._table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of ``benchmark`` as ids of the vocabulary of ``documents``."""
    vocab = core._once(spark, sf_dir, "vocabulary", lambda: ix.vocabulary(core._table(spark, sf_dir, "documents"), Tokenizer()))
    items = core._table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    out = ix.tokenized(items, Tokenizer(), vocab)
    return out.select(F.col("doc_id").alias("item_id"), F.array_join(F.transform("token_ids", lambda x: x.cast("string")), " ").alias("ids"), F.col("length").cast("long").alias("length"))


def chunked_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of ``benchmark``, given one by one; their postings."""
    items = [r["text"] for r in core._table(spark, sf_dir, "benchmark").orderBy("item_id").collect()]
    built = ChunkedBuilder(spark, chunk_size=7).add_documents(items).build()
    return built.postings.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), F.round(F.col("score").cast("double"), 5).alias("score"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as a file stream, started twice, into the log of an index; how often each text was added."""
    log = UpdateLog(core.corpus_index(spark, sf_dir))
    source, checkpoint = _written(core._table(spark, sf_dir, "conversations").select("text"), "incoming", "parquet"), new_path(spark, "checkpoint")
    for _ in range(2):
        follow(spark.readStream.schema("text string").parquet(source), log, checkpoint).awaitTermination()
    return _hashed(log.added())


def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of the updates opened anew: what it holds, and whether it is time to compact."""
    held = core.update_log(spark, sf_dir)
    log = UpdateLog(held.index, held.path)
    log.begin_batch()
    log.append_texts(["never committed"])
    log.rollback_batch()
    counts = (log.added_count(), log.deleted_count(), log.live_count(), len(log), log.should_compact())
    return spark.createDataFrame([counts], "added long, deleted long, live long, entries long, compact boolean")


def cached_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two texts searched three times in a cache of one: what is found, and how many results are kept."""
    index, cache = core.corpus_index(spark, sf_dir), se.QueryCache(1)
    texts = [r["text"] for r in core.query_set(spark, sf_dir).orderBy("query_id").limit(2).collect()]
    rows = []
    for text in (texts[0], texts[0], texts[-1], texts[0]):
        rows = se.search_cached(index, cache, text, K)
    return spark.createDataFrame([(r["rank"], r["doc_id"], round(r["score"], 4), len(cache)) for r in rows], "rank long, doc_id long, score double, kept long")


def approximate_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the best ten the search by bounds finds."""
    index = core._once(spark, sf_dir, "bounds", lambda: prune.with_bounds(core.corpus_index(spark, sf_dir), 256))
    q = core.query_set(spark, sf_dir)
    return evaluate.recall(prune.search_approximate(index, q, K), se.search_batch(index, q, K), K).agg(F.count("*").alias("n_queries"), F.avg("recall").alias("recall"))


def shard_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three shards by ranges of doc_id as services, with frequencies collected and applied by their coordinator."""
    docs = core._table(spark, sf_dir, "documents").select("doc_id", "text")

    def make() -> shards.Coordinator:
        most = docs.agg(F.max("doc_id")).first()[0] + 1
        cuts = [0, most // 3, 2 * most // 3, most]
        parts = [docs.filter((F.col("doc_id") >= a) & (F.col("doc_id") < b)).withColumn("doc_id", F.col("doc_id") - a) for a, b in zip(cuts, cuts[1:])]
        return shards.Coordinator([shards.Shard(ix.build(p), a) for p, a in zip(parts, cuts)], timeout=600)

    found = core._once(spark, sf_dir, "shards", make).search(core.query_set(spark, sf_dir), K)
    return found.rows.select("query_id", "doc_id", F.round("score", 4).alias("score"), F.lit(found.degraded).alias("degraded"))


def broken_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks on an index with faults put in: the first ten documents' postings doubled, the next ten's documents unknown, scores of 0 for ten more."""
    from dataclasses import replace

    index = core.corpus_index(spark, sf_dir)
    p = index.postings
    twice = p.filter("doc_id < 10")
    zero = F.when((F.col("doc_id") >= 20) & (F.col("doc_id") < 30), F.lit(0).cast("float")).otherwise(F.col("score"))
    faulty = p.withColumn("score", zero).unionByName(twice)
    return ix.violations(replace(index, postings=faulty, lengths=index.lengths.filter("doc_id < 10 OR doc_id >= 20"))).select("repeated_pairs", "unknown_documents", "zero_scores")


def made_up_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up corpus: documents, their sizes' range, and whether the first words are the commonest."""
    words = synthetic.corpus(spark, 1000).select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    sizes = words.groupBy("doc_id").count().agg(F.count("*").alias("docs"), (F.min("count") >= 20).alias("least"), (F.max("count") <= 199).alias("most"))
    common = words.groupBy("w").count().agg(F.max_by("w", "count").alias("commonest"))
    return sizes.crossJoin(common)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_json_array": read_json_array, "read_jsonl": read_jsonl, "read_csv": _csv(","), "read_tsv": _csv("\t"), "read_text": read_text, "read_loose": read_loose, "beir_files": beir_files, "read_qrels": read_qrels,
    "detected_formats": detected_formats, "method_names": method_names, "parameter_checks": parameter_checks, "byte_labels": byte_labels, "stored_index": stored_index, "tokenised_corpus": tokenised_corpus, "custom_tokenizer": custom_tokenizer,
    "token_ids": token_ids, "chunked_build": chunked_build, "stream_ingest": stream_ingest, "log_counts": log_counts, "cached_search": cached_search, "approximate_top10": approximate_top10, "shard_services": shard_services,
    "broken_index": broken_index, "made_up_corpus": made_up_corpus,
}

_TEXTS = "SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY h"
_BEIR = core._DCG.replace("round(score, 6) DESC, doc_id)", "round(score, 6) DESC, 'D-' || doc_id)")
_ITEM_DOCS = f"d AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS doc_id, {sql.tokens('text')} AS toks FROM benchmark)"


def _values(rows: list[tuple], names: str) -> str:
    def cell(x: object) -> str:
        return f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") t({names})"


ORACLE_SQL: dict[str, str] = {
    "read_json_array": "SELECT n_name AS text, count(*) AS n FROM nation GROUP BY n_name",
    "read_jsonl": _TEXTS, "read_csv": _TEXTS, "read_tsv": _TEXTS,
    "read_text": "SELECT md5(t) AS h, count(*) AS n FROM (SELECT regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS t FROM documents) WHERE t <> '' GROUP BY h",
    "read_loose": "SELECT md5(t) AS h, count(*) AS n FROM (SELECT regexp_replace(text, '[\\n\\r]', ' ', 'g') AS t FROM documents) WHERE trim(t) <> '' GROUP BY h",
    "beir_files": f"WITH {_BEIR} SELECT 'Q' || query_id AS query_id, round(dcg / ideal, 6) AS ndcg FROM dcg JOIN ideal USING (query_id)",
    "read_qrels": "SELECT 'q' AS query_id, doc_id::VARCHAR AS doc_id, max(quality)::BIGINT AS grade FROM labels GROUP BY ALL",
    "detected_formats": _values(list(_NAMES.items()), "name, format"),
    "method_names": _values(list(_METHODS.items()), "name, method"),
    "parameter_checks": _values(_PARAMS, "method, k1, b, delta, good"),
    "byte_labels": """SELECT n, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824::DOUBLE) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576::DOUBLE) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024::DOUBLE) ELSE n || ' B' END AS label
FROM (SELECT DISTINCT n_chars * unnest([1, 1000, 1000000])::BIGINT AS n FROM documents)""",
    "stored_index": core._best_sql(), "tokenised_corpus": core._best_sql(),
    "custom_tokenizer": "SELECT doc_id, len(string_split(text, ' '))::BIGINT AS n FROM documents",
    "token_ids": f"""WITH {sql.DOCS}, s AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS i FROM d), f AS (SELECT term, min((doc_id, i)) AS first FROM s GROUP BY term),
v AS (SELECT term, row_number() OVER (ORDER BY first) - 1 AS term_id FROM f), b AS (SELECT item_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS i FROM (SELECT item_id, {sql.tokens("text")} AS toks FROM benchmark))
SELECT item_id, coalesce(string_agg(term_id::VARCHAR, ' ' ORDER BY i) FILTER (term_id IS NOT NULL), '') AS ids, count(*) AS length FROM b LEFT JOIN v USING (term) GROUP BY item_id""",
    "chunked_build": f"WITH {sql.postings().replace(sql.DOCS, _ITEM_DOCS)} SELECT doc_id, term, tf, round(score::DOUBLE, 5) AS score FROM post",
    "stream_ingest": "SELECT md5(text) AS h, count(*) AS n FROM conversations GROUP BY h",
    "log_counts": """WITH g AS (SELECT count(DISTINCT doc_id) AS gone FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents)), a AS (SELECT count(*) AS added FROM conversations), n AS (SELECT count(*) AS docs FROM documents)
SELECT added, gone AS deleted, docs + added - gone AS live, added + gone AS entries, added >= 0.1 * docs AS compact FROM g, a, n""",
    "cached_search": f"WITH {sql.scores(queries=core._FIRST)}, {sql.top(K)} SELECT rank, doc_id, round(score, 4) AS score, 1::BIGINT AS kept FROM best",
    "approximate_top10": f"WITH {sql.scores()}, {sql.top(K)} SELECT count(DISTINCT query_id) AS n_queries, 1.0::DOUBLE AS recall FROM best",
    "shard_services": f"WITH {sql.scores()}, {sql.top(K)} SELECT query_id, doc_id, round(score, 4) AS score, false AS degraded FROM best",
    "broken_index": f"WITH {sql.postings()} SELECT count(*) FILTER (doc_id < 10) AS repeated_pairs, count(*) FILTER (doc_id BETWEEN 10 AND 19) AS unknown_documents, count(*) FILTER (doc_id BETWEEN 20 AND 29) AS zero_scores FROM post",
    "made_up_corpus": "SELECT 1000::BIGINT AS docs, true AS least, true AS most, 'w0' AS commonest",
}
