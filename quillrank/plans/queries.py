"""The queries of the driver: every operator over whole tables, and the SQL that must give the same rows.

``documents`` is the corpus, ``benchmark`` the batch of queries. Updates add the turns of ``conversations`` and delete what ``labels`` calls toxic.
A document is relevant to a passage of ``benchmark`` that it contains.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import METHODS, Params
from ..functions import maths, scoring
from ..functions.stopwords import for_language
from ..functions.text import Tokenizer
from ..operators import evaluate, prune, shards
from ..operators import index as ix
from ..operators import search as se
from ..storage import materialise, sent
from ..streaming.updates import UpdateLog
from . import sql, stems

K = 10
N_SHARDS = 4
TOKENS = ["the", "of", "and", "the"]
_built: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], object]):
    """Made once a session and folder: an index is built once and searched often."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_index(spark: SparkSession, sf_dir: str) -> ix.Index:
    return _once(spark, sf_dir, "index", lambda: ix.build(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _best(found: DataFrame, decimals: int = 4) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round(F.col("score").cast("double"), decimals).alias("score"))


def _ranked(spark: SparkSession, sf_dir: str, method: str = "lucene", k: int = K) -> DataFrame:
    index = corpus_index(spark, sf_dir)
    if method != "lucene":
        index = index.with_params(Params(method))
    return se.search_batch(index, query_set(spark, sf_dir), k, decimals=6)


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds the index anew; its size."""
    index = ix.build(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return index.postings.agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"), F.round(F.sum(F.col("score").cast("double")), 2).alias("score_sum"))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.token_counts(_table(spark, sf_dir, "documents"), Tokenizer())


def tokenize_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("lang", F.size(Tokenizer().tokens(F.col("text"))).alias("n")).groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_docs"))


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(Tokenizer().tokens(F.col("text"))).cast("long").alias("doc_len"))


def vocab_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.flat_counts(_counted(spark, sf_dir)).agg(F.countDistinct("term").alias("n_terms"), F.count("*").alias("n_postings"))


def vocab_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.vocabulary(_table(spark, sf_dir, "documents"), Tokenizer())


def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.flat_counts(_counted(spark, sf_dir)).select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.document_frequencies(ix.flat_counts(_counted(spark, sf_dir)))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ix.corpus_stats(_table(spark, sf_dir, "documents").select(F.size(Tokenizer().tokens(F.col("text"))).alias("doc_len")))
    return found.select("n_docs", "n_tokens", F.round(F.col("mean_length").cast("double"), 4).alias("mean_length"))


def _idf(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = corpus_index(spark, sf_dir)
        return index.terms.select("term", F.round(scoring.idf(method, F.lit(index.stats.n_docs), F.col("df")).cast("double"), 5).alias("idf"))

    return run


def _weight(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = corpus_index(spark, sf_dir)
        w = scoring.weight(Params(method), F.col("tf"), F.col("doc_len"), F.lit(index.stats.mean_length))
        return index.postings.select("doc_id", "term", F.round(w.cast("double"), 5).alias("weight"))

    return run


def _score(method: str):
    return lambda spark, sf_dir: _best(_ranked(spark, sf_dir, method))


def search_single_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search for one text, that of the first passage."""
    text = query_set(spark, sf_dir).orderBy("query_id").first()["text"]
    return se.search(corpus_index(spark, sf_dir), text, K).select(F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 4).alias("score"))


def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.search_tokens(corpus_index(spark, sf_dir), TOKENS, K).select(F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 4).alias("score"))


def batch_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(_ranked(spark, sf_dir, k=5))


def single_precision_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = se.search_batch(corpus_index(spark, sf_dir), query_set(spark, sf_dir), K, exact_single=True)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.col("score").cast("double").alias("score"))


def dense_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.dense_scores(corpus_index(spark, sf_dir), query_set(spark, sf_dir)).select("query_id", "doc_id", F.round("score", 4).alias("score"))


def duplicate_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text said twice scores twice as much."""
    twice = query_set(spark, sf_dir).select("query_id", F.concat_ws(" ", "text", "text").alias("text"))
    return _best(se.search_batch(corpus_index(spark, sf_dir), twice, K, decimals=6))


def unknown_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different terms of each query no document holds."""
    index = corpus_index(spark, sf_dir)
    terms = se.query_terms(query_set(spark, sf_dir), index.tokenizer)
    return terms.join(index.terms, "term", "left_anti").groupBy("query_id").agg(F.count("*").alias("n_unknown"))


_STOPS = tuple(for_language("en"))
_CODES = ("de", "en", "es", "fr")


def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Tokenizer(stopwords=_STOPS).tokens(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"))


def _pattern(pattern: str):
    """How many tokens of a pattern each document has, and which: matched in the text as it is, then in small letters."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _table(spark, sf_dir, "documents").select("doc_id", Tokenizer(pattern=pattern).tokens(F.col("text")).alias("t"))
        return found.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))

    return run


def stemmed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English stems and in how many documents they are. No SQL: stemming isn't in it."""
    return ix.document_frequencies(ix.flat_counts(ix.token_counts(_table(spark, sf_dir, "documents"), Tokenizer(stemmer="english"))))


def stem_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of listed words in 13 languages by the tokenizer, against the published ones."""
    words = spark.createDataFrame([r[:2] for r in stems.rows()], "lang string, word string")
    out = None
    for lang in stems.PAIRS:
        part = words.filter(F.col("lang") == lang).select("lang", "word", F.element_at(Tokenizer(stemmer=lang).tokens(F.col("word")), 1).alias("stem"))
        out = part if out is None else out.unionByName(part)
    return out


def language_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of each document its language's stop list leaves."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    n = F.lit(None).cast("long")
    for code in _CODES:
        n = F.when(F.col("lang") == code, F.size(Tokenizer(stopwords=tuple(for_language(code))).tokens(F.col("text"))).cast("long")).otherwise(n)
    return docs.select("doc_id", n.alias("n"))


def nnz_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings by term whose Robertson score is above, and below 0; those of 0 aren't held."""
    p = corpus_index(spark, sf_dir).with_params(Params("robertson")).postings
    return p.groupBy("term").agg(F.count_if(F.col("score") > 0).alias("above"), F.count_if(F.col("score") < 0).alias("below"))


def index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.violations(corpus_index(spark, sf_dir))


def merged_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting twice over, added up."""
    p = corpus_index(spark, sf_dir).postings.select("term", "doc_id", "score")
    return ix.merged(p.unionByName(p)).select("term", "doc_id", F.round(F.col("score").cast("double"), 4).alias("score"))


def block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prune.block_maxima(corpus_index(spark, sf_dir).postings)
    return found.withColumn("block_max", F.round(F.col("block_max").cast("double"), 5))


def term_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prune.term_maxima(corpus_index(spark, sf_dir).postings).withColumn("max_score", F.round(F.col("max_score").cast("double"), 5))


def pruned_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _once(spark, sf_dir, "bounds", lambda: prune.with_bounds(corpus_index(spark, sf_dir), 256))
    return prune.search_pruned(index, query_set(spark, sf_dir), K, decimals=6).select("query_id", "doc_id", F.round("score", 4).alias("score"))


def update_log(spark: SparkSession, sf_dir: str) -> UpdateLog:
    def make() -> UpdateLog:
        log = UpdateLog(corpus_index(spark, sf_dir))
        log.append_documents(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id", "turn", "role", "text"])
        log.delete_frame(_table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"))
        return log

    return _once(spark, sf_dir, "log", make)


def _updated(strategy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _best(update_log(spark, sf_dir).search(query_set(spark, sf_dir), K, strategy, 6))

    return run


def tombstone_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are left of the base."""
    log = update_log(spark, sf_dir)
    return log.index.lengths.join(log.deleted(), "doc_id", "left_anti").select("doc_id", F.col("doc_len").cast("long").alias("doc_len"))


def delete_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting every labelled document after the toxic ones are gone: which are there to be deleted."""
    base = corpus_index(spark, sf_dir)
    log = UpdateLog(base)
    labels = _table(spark, sf_dir, "labels")
    log.delete_frame(labels.filter("toxic = 1").select("doc_id"))
    return log.delete_frame(labels.select("doc_id"))


def compact_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ids = _once(spark, sf_dir, "compact", lambda: update_log(spark, sf_dir).compact())
    return ids


def compact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = _once(spark, sf_dir, "compact", lambda: update_log(spark, sf_dir).compact())
    return _best(se.search_batch(index, query_set(spark, sf_dir), K, decimals=6))


def shard_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_frequencies(corpus_index(spark, sf_dir), N_SHARDS).withColumn("shard", F.col("shard").cast("long"))


def global_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.global_idf(corpus_index(spark, sf_dir), N_SHARDS).withColumn("idf", F.round(F.col("idf").cast("double"), 5))


def shard_merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.search_shards(corpus_index(spark, sf_dir), query_set(spark, sf_dir), K, N_SHARDS).rows
    return rows.select("query_id", "doc_id", F.round("score", 4).alias("score"))


def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = corpus_index(spark, sf_dir)
    scores = se.document_scores(index.postings, se.query_terms(query_set(spark, sf_dir), index.tokenizer), index.stats.n_docs)
    return maths.zscores(scores, "score", "query_id").select("query_id", "doc_id", F.round("z", 4).alias("z"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, grade): documents that contain a passage, grade 1. Candidates are those that hold the passage's rarest term."""

    def make() -> DataFrame:
        index, q = corpus_index(spark, sf_dir), query_set(spark, sf_dir)
        # small tables are written, so that Spark knows they are and sends them to the postings and texts instead of shuffling these
        terms = materialise(se.query_terms(q, index.tokenizer), "query-terms").join(index.terms, "term")
        # a passage's first and last words may be cut off from longer ones; what stands between must be whole
        inner = q.select("query_id", Tokenizer().tokens(F.col("text")).alias("t")).select("query_id", F.explode(F.slice("t", F.lit(2), F.greatest(F.size("t") - 2, F.lit(0)))).alias("term")).distinct()
        rarest = terms.join(inner, ["query_id", "term"]).groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
        rarest = materialise(rarest, "rarest")
        pairs = index.postings.select("term", "doc_id").join(rarest, "term").select("query_id", "doc_id")
        # passages of one or two tokens have nothing between: they are looked for everywhere
        short = q.join(inner.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
        pairs = pairs.unionByName(short.crossJoin(index.lengths.select("doc_id")))
        pairs = materialise(pairs, "pairs")
        texts = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")).join(sent(pairs, pairs.count()), "doc_id").join(q, "query_id")
        return materialise(texts.filter(F.contains("body", "text")).select("query_id", "doc_id", F.lit(1).alias("grade")), "qrels")

    return _once(spark, sf_dir, "qrels", make)


def dcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.dcg(_ranked(spark, sf_dir), qrels(spark, sf_dir), K).withColumn("dcg", F.round("dcg", 6))


def ndcg_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ndcg(_ranked(spark, sf_dir), qrels(spark, sf_dir), K).withColumn("ndcg", F.round("ndcg", 6))


def mean_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mean_ndcg(_ranked(spark, sf_dir), qrels(spark, sf_dir), K).withColumn("mean_ndcg", F.round("mean_ndcg", 6))


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each query's best ten by one method another finds."""
    return evaluate.recall(_ranked(spark, sf_dir, "bm25plus"), _ranked(spark, sf_dir), K).withColumn("recall", F.round("recall", 6))


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.percentiles(corpus_index(spark, sf_dir).lengths, "doc_len", [50, 95, 99]).select("p", F.col("value").cast("long").alias("value"))


def harness_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.percentiles(corpus_index(spark, sf_dir).lengths, "doc_len", [50, 95, 99], harness=True).select("p", F.col("value").cast("long").alias("value"))


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of two methods in one."""
    return _best(evaluate.fuse([_ranked(spark, sf_dir), _ranked(spark, sf_dir, "atire")], K), 6)


def dot_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector with itself, and its largest number."""
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(maths.dot(F.col("embedding"), F.col("embedding")).cast("double"), 4).alias("dot"), F.round(maths.greatest_of(F.col("embedding")).cast("double"), 6).alias("greatest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "index_build": index_build, "tokenize_count": tokenize_count, "token_lengths": token_lengths, "vocab_size": vocab_size, "vocab_first_seen": vocab_first_seen, "term_freq": term_freq, "doc_freq": doc_freq, "corpus_stats": corpus_stats,
    **{f"idf_{m}": _idf(m) for m in METHODS}, **{f"tfc_{m}": _weight(m) for m in METHODS}, **{f"score_{m}": _score(m) for m in METHODS},
    "search_single_top10": search_single_top10, "search_tokens": search_tokens, "batch_top5": batch_top5, "single_precision_top10": single_precision_top10, "dense_scores": dense_scores, "duplicate_query_terms": duplicate_query_terms, "unknown_terms": unknown_terms,
    "stopword_filter": stopword_filter, "custom_pattern": _pattern("[a-z]{4,}"), "upper_pattern": _pattern("[A-Z]+[a-z]?"), "stemmed_vocabulary": stemmed_vocabulary, "stem_pairs": stem_pairs, "language_tokens": language_tokens, "nnz_by_term": nnz_by_term, "index_check": index_check, "merged_triplets": merged_triplets,
    "block_max": block_max, "term_max": term_max, "pruned_top10": pruned_top10,
    "wal_fast": _updated("fast"), "wal_exact": _updated("exact"), "wal_rebuild": _updated("rebuild"), "tombstone_mask": tombstone_mask, "delete_report": delete_report, "compact_renumber": compact_renumber, "compact_search": compact_search,
    "shard_df": shard_df, "global_idf": global_idf, "shard_merge_topk": shard_merge_topk, "zscore": zscore, "dcg": dcg, "ndcg_at_10": ndcg_at_10, "mean_ndcg": mean_ndcg, "recall_at_k": recall_at_k,
    "percentiles": percentiles, "harness_percentiles": harness_percentiles, "rrf_hybrid": rrf_hybrid, "dot_product": dot_product,
}


def _best_sql(method: str = "lucene", k: int = K, queries: str = sql.QUERIES) -> str:
    return f"WITH {sql.scores(method, queries)}, {sql.top(k)} SELECT query_id, rank, doc_id, round(score, 4) AS score FROM best"


_FIRST = f"q AS (SELECT 0 AS query_id, unnest({sql.tokens('text')}) AS term FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark))"
_GIVEN = f"q AS (SELECT 0 AS query_id, unnest({TOKENS}) AS term)"
_TWICE = f"q AS (SELECT item_id AS query_id, unnest({sql.tokens(chr(34) + 'text' + chr(34) + ' || chr(32) || text')}) AS term FROM benchmark)"

_LIVE = f"""{sql.DOCS}, {sql.STATS}, {sql.COUNTS}, {sql.QUERIES},
gone AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents)),
extra AS (SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY conv_id, turn, role, text) AS doc_id, {sql.tokens("text")} AS toks FROM conversations),
alld AS (SELECT * FROM (SELECT doc_id, toks FROM d UNION ALL SELECT doc_id, toks FROM extra) WHERE doc_id NOT IN (SELECT doc_id FROM gone)),
alens AS (SELECT doc_id, len(toks)::BIGINT AS dl FROM alld),
ast AS (SELECT count(*) AS n, (sum(dl)::FLOAT::DOUBLE / count(*)::FLOAT::DOUBLE)::FLOAT::DOUBLE AS mean FROM alens),
atf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM alld) GROUP BY ALL),
adf AS (SELECT term, count(*) AS df FROM atf GROUP BY term)"""


def _live_sql(n: str, df: str, mean: str, end: str) -> str:
    return f"""WITH {_LIVE},
lpost AS (SELECT atf.term, doc_id, {sql.score("lucene", n, df, "tf", "dl", mean)} AS score FROM atf JOIN alens USING (doc_id) JOIN adf USING (term) LEFT JOIN df USING (term), st, ast),
sc AS (SELECT query_id, doc_id, sum(score::DOUBLE) AS score FROM lpost JOIN q USING (term) GROUP BY query_id, doc_id), {sql.top(K)}
{end}"""


_BEST = "SELECT query_id, rank, doc_id, round(score, 4) AS score FROM best"
_RENUMBER = "ren AS (SELECT doc_id AS old_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_id FROM alens)"
_QRELS = "qrels AS (SELECT item_id AS query_id, doc_id FROM documents d2 JOIN benchmark b ON contains(d2.text, b.text))"
_DCG = f"""{sql.scores()}, {sql.top(K)}, {_QRELS},
dcg AS (SELECT query_id, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg FROM (SELECT DISTINCT query_id FROM qrels) LEFT JOIN (SELECT best.* FROM best JOIN qrels USING (query_id, doc_id)) USING (query_id) GROUP BY query_id),
ideal AS (SELECT query_id, sum(CASE WHEN r <= {K} THEN 1 / log2(r + 1) ELSE 0 END) AS ideal FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS r FROM qrels) GROUP BY query_id)"""


def _two(method: str) -> str:
    """Two rankings: a by lucene, b by ``method``."""
    return f"""a AS (WITH {sql.scores()}, {sql.top(K)} SELECT query_id, doc_id, rank FROM best), b AS (WITH {sql.scores(method)}, {sql.top(K)} SELECT query_id, doc_id, rank FROM best)"""


def _percentile_sql(place: str) -> str:
    return f"""WITH {sql.DOCS}, {sql.STATS}, o AS (SELECT dl, row_number() OVER (ORDER BY dl) - 1 AS i FROM lens)
SELECT p::DOUBLE AS p, dl AS value FROM (SELECT unnest([50, 95, 99]) AS p) JOIN o ON i = (SELECT {place} FROM st)"""


ORACLE_SQL: dict[str, str] = {
    "index_build": f"WITH {sql.postings()} SELECT count(*) AS postings, sum(tf)::BIGINT AS tokens, round(sum(score::DOUBLE), 2) AS score_sum FROM post",
    "tokenize_count": f"SELECT lang, sum(len({sql.tokens('text')}))::BIGINT AS n_tokens, count(*) AS n_docs FROM documents GROUP BY lang",
    "token_lengths": f"SELECT doc_id, len({sql.tokens('text')})::BIGINT AS doc_len FROM documents",
    "vocab_size": f"WITH {sql.DOCS}, {sql.COUNTS} SELECT count(DISTINCT term) AS n_terms, count(*) AS n_postings FROM tf",
    "vocab_first_seen": f"""WITH {sql.DOCS}, s AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS i FROM d), f AS (SELECT term, min((doc_id, i)) AS first FROM s GROUP BY term)
SELECT term, row_number() OVER (ORDER BY first) - 1 AS term_id FROM f""",
    "term_freq": f"WITH {sql.DOCS}, {sql.COUNTS} SELECT doc_id, term, tf FROM tf",
    "doc_freq": f"WITH {sql.DOCS}, {sql.COUNTS} SELECT term, df FROM df",
    "corpus_stats": f"WITH {sql.DOCS}, {sql.STATS} SELECT n AS n_docs, total AS n_tokens, round(mean, 4) AS mean_length FROM st",
    **{f"idf_{m}": f"WITH {sql.DOCS}, {sql.STATS}, {sql.COUNTS} SELECT term, round({sql.idf(m, 'n', 'df')}, 5) AS idf FROM df, st" for m in METHODS},
    **{f"tfc_{m}": f"WITH {sql.DOCS}, {sql.STATS}, {sql.COUNTS} SELECT doc_id, term, round({sql.weight(m, 'tf', 'dl', 'mean')}, 5) AS weight FROM tf JOIN lens USING (doc_id), st" for m in METHODS},
    **{f"score_{m}": _best_sql(m) for m in METHODS},
    "search_single_top10": f"WITH {sql.scores(queries=_FIRST)}, {sql.top(K)} SELECT rank, doc_id, round(score, 4) AS score FROM best",
    "search_tokens": f"WITH {sql.scores(queries=_GIVEN)}, {sql.top(K)} SELECT rank, doc_id, round(score, 4) AS score FROM best",
    "batch_top5": _best_sql(k=5),
    "single_precision_top10": f"""WITH {sql.postings()}, q AS (SELECT item_id AS query_id, unnest({sql.tokens("text")}) AS term, generate_subscripts({sql.tokens("text")}, 1) AS pos FROM benchmark),
sc AS (SELECT query_id, doc_id, list_reduce(list(score ORDER BY df, pos), lambda a, x: (a + x)::FLOAT) AS score FROM post JOIN q USING (term) GROUP BY query_id, doc_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score::DOUBLE AS score FROM sc WHERE score > 0 QUALIFY rank <= {K}""",
    "dense_scores": f"WITH {sql.scores()} SELECT item_id AS query_id, doc_id, round(coalesce(score, 0), 4) AS score FROM benchmark CROSS JOIN lens LEFT JOIN sc ON sc.query_id = item_id AND sc.doc_id = lens.doc_id".replace("AS query_id, doc_id, round", "AS query_id, lens.doc_id, round"),
    "duplicate_query_terms": _best_sql(queries=_TWICE),
    "unknown_terms": f"WITH {sql.DOCS}, {sql.COUNTS}, {sql.QUERIES} SELECT query_id, count(DISTINCT term) AS n_unknown FROM q WHERE term NOT IN (SELECT term FROM df) GROUP BY query_id",
    "stopword_filter": f"SELECT doc_id, len(list_filter({sql.tokens('text')}, lambda x: NOT list_contains({list(_STOPS)}, x)))::BIGINT AS n FROM documents",
    **{name: f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(list_transform(t, lambda x: lower(x)), ' ')) AS tokens FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS t FROM documents)" for name, p in (("custom_pattern", "[a-z]{4,}"), ("upper_pattern", "[A-Z]+[a-z]?"))},
    "stem_pairs": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in stems.rows()) + ") t(lang, word, stem)",
    "language_tokens": f"SELECT doc_id, CASE lang {' '.join(f"WHEN '{c}' THEN len(list_filter({sql.tokens('text')}, lambda x: NOT list_contains({for_language(c)}, x)))::BIGINT" for c in _CODES)} END AS n FROM documents",
    "nnz_by_term": f"WITH {sql.postings('robertson')} SELECT term, count(*) FILTER (score > 0) AS above, count(*) FILTER (score < 0) AS below FROM post GROUP BY term",
    "index_check": "SELECT 0::BIGINT AS repeated_pairs, 0::BIGINT AS unknown_documents, 0::BIGINT AS nulls, 0::BIGINT AS not_finite, 0::BIGINT AS zero_scores, 0::BIGINT AS bad_counts, 0::BIGINT AS bad_frequencies",
    "merged_triplets": f"WITH {sql.postings()} SELECT term, doc_id, round((score::DOUBLE * 2)::FLOAT::DOUBLE, 4) AS score FROM post",
    "block_max": f"""WITH {sql.postings()}, b AS (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // {prune.BLOCK_SIZE} AS block_no FROM post)
SELECT term, block_no, min(doc_id) AS min_doc, max(doc_id) AS max_doc, round(max(greatest(score, 0))::DOUBLE, 5) AS block_max FROM b GROUP BY term, block_no""",
    "term_max": f"WITH {sql.postings()} SELECT term, round(max(greatest(score, 0))::DOUBLE, 5) AS max_score FROM post GROUP BY term",
    "pruned_top10": f"WITH {sql.scores()}, {sql.top(K)} SELECT query_id, doc_id, round(score, 4) AS score FROM best",
    "wal_fast": _live_sql("st.n", "greatest(coalesce(df.df, 0), 1)", "st.mean", _BEST),
    "wal_exact": _live_sql("ast.n", "adf.df", "st.mean", _BEST),
    "wal_rebuild": _live_sql("ast.n", "adf.df", "ast.mean", _BEST),
    "tombstone_mask": f"WITH {sql.DOCS}, {sql.STATS} SELECT doc_id, dl AS doc_len FROM lens WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "delete_report": "SELECT doc_id, bool_and(toxic <> 1) AND doc_id IN (SELECT doc_id FROM documents) AS deleted FROM labels GROUP BY doc_id",
    "compact_renumber": f"WITH {_LIVE}, {_RENUMBER} SELECT old_id, doc_id FROM ren",
    "compact_search": _live_sql("ast.n", "adf.df", "ast.mean", f"SELECT query_id, rank, ren.doc_id, round(score, 4) AS score FROM best JOIN (SELECT doc_id AS old_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_id FROM alens) ren ON best.doc_id = old_id"),
    "shard_df": f"WITH {sql.postings()} SELECT doc_id % {N_SHARDS} AS shard, term, count(*) AS df FROM post GROUP BY ALL",
    "global_idf": f"WITH {sql.postings()} SELECT term, any_value(df) AS df, round(any_value({sql.idf('lucene', 'n', 'df')}), 5) AS idf FROM post, st GROUP BY term",
    "shard_merge_topk": f"WITH {sql.scores()}, {sql.top(K)} SELECT query_id, doc_id, round(score, 4) AS score FROM best",
    "zscore": f"""WITH {sql.scores()}, w AS (SELECT *, avg(score) OVER (PARTITION BY query_id) AS m, stddev_pop(score) OVER (PARTITION BY query_id) AS s FROM sc)
SELECT query_id, doc_id, round(CASE WHEN s < {maths.EPSILON} THEN 1.0::DOUBLE ELSE (score - m) / s END, 4) AS z FROM w""",
    "dcg": f"WITH {_DCG} SELECT query_id, round(dcg, 6) AS dcg FROM dcg",
    "ndcg_at_10": f"WITH {_DCG} SELECT query_id, round(dcg / ideal, 6) AS ndcg FROM dcg JOIN ideal USING (query_id)",
    "mean_ndcg": f"WITH {_DCG} SELECT count(*) AS n_queries, round(avg(dcg / ideal), 6) AS mean_ndcg FROM dcg JOIN ideal USING (query_id)",
    "recall_at_k": f"WITH {_two('bm25plus')} SELECT a.query_id, round(count(b.doc_id) / count(*), 6) AS recall FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id GROUP BY a.query_id",
    "percentiles": _percentile_sql("floor(p / 100::DOUBLE * (n - 1) + 0.5)"),
    "harness_percentiles": _percentile_sql("least(n * p // 100, n - 1)"),
    "rrf_hybrid": f"""WITH {_two("atire")}, s AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY query_id, doc_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM s QUALIFY rank <= {K}""",
    "dot_product": "SELECT vec_id, round(list_dot_product(embedding, embedding)::DOUBLE, 4) AS dot, round(list_max(embedding)::DOUBLE, 6) AS greatest FROM embeddings",
}
