"""What keeps queries within their limits on large tables: what is shuffled, and what is sent."""

import pytest
from pyspark.sql import functions as F

from quillrank.functions.text import Tokenizer
from quillrank.operators import index as ix
from quillrank.operators import search as se
from quillrank.operators.numbering import ranks
from quillrank.sources import store
from quillrank.streaming.updates import UpdateLog

TEXTS = ["the red fox runs over the hill", "a lazy dog sleeps under the hill", "red red red wine in the glass", "", "a cat sat by the mill with a dog", "wine and bread and wine", None, "the fox"]
QUERIES = ["red fox", "the hill", "wine wine bread", "nothing known here", "", "the dog the cat"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def asked(spark):
    return frame(spark, QUERIES).withColumnRenamed("doc_id", "query_id")


@pytest.fixture(scope="module")
def index(spark):
    return ix.build(frame(spark, TEXTS))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counting_shuffles_nothing_and_postings_once(spark, monkeypatch):
    docs = frame(spark, [" ".join(f"w{j}" for j in range(i % 7)) + " the" * (i % 3) for i in range(40)])
    assert "Exchange" not in plan(ix.token_counts(docs, Tokenizer()))
    whole = {(r["term"], r["doc_id"]): tuple(r) for r in ix.build(docs).postings.collect()}
    # few rows to a range, and nearly every term common
    for name, value in (("COMMON_DF", 4), ("BLOCK_DOCS", 3), ("RANGE_ROWS", 10)):
        monkeypatch.setattr(ix, name, value)
    built = ix.build(docs)
    assert {(r["term"], r["doc_id"]): tuple(r) for r in built.postings.collect()} == whole
    assert {r["term"]: r["df"] for r in built.terms.collect()} == {k[0]: v[4] for k, v in whole.items()}


def test_counts_of_given_tokens(spark):
    given = spark.createDataFrame([(0, ["b", "a", None, "b"]), (1, []), (2, None), (3, [None]), (4, ["", "a"])], "doc_id long, w array<string>")
    assert sorted(map(tuple, ix.token_counts(given, Tokenizer(), "w").collect()), key=repr) == sorted([(0, 4, "a", 1), (0, 4, "b", 2), (1, 0, None, 0), (2, 0, None, 0), (3, 1, None, 0), (4, 2, "", 1), (4, 2, "a", 1)], key=repr)


def test_scores_are_summed_where_the_documents_are(spark, index):
    terms = se.query_terms(asked(spark), index.tokenizer)
    found = plan(se.document_scores(index.postings, terms, 1000)).split("BroadcastExchange")[0]
    assert "hashpartitioning(query_id" not in found and ("hashpartitioning(doc_id" in found or "REPARTITION_BY_NUM" in found)
    # a batch too large to send gives the same rows
    every = {(r["query_id"], r["doc_id"]): r["score"] for r in se.dense_scores(index, asked(spark)).collect()}
    held, se.SENT_ROWS = se.SENT_ROWS, 0
    try:
        assert {(r["query_id"], r["doc_id"]): r["score"] for r in se.dense_scores(index, asked(spark)).collect()} == pytest.approx(every)
    finally:
        se.SENT_ROWS = held


def test_single_precision_puts_only_near_documents_in_order(spark, index):
    near = {(r["query_id"], r["doc_id"]) for r in se.single_scores(index, asked(spark), 1).collect()}
    every = {(r["query_id"], r["doc_id"]) for r in se.document_scores(index.postings, se.query_terms(asked(spark), index.tokenizer), 10).collect()}
    best = {(r["query_id"], r["doc_id"]) for r in se.search_batch(index, asked(spark), 1, exact_single=True).collect()}
    assert best <= near < every


def test_live_postings_meet_written_frequencies(spark):
    log = UpdateLog(ix.build(frame(spark, TEXTS)))
    log.append_texts(["a zebra", "the fox"])
    log.delete_documents([0])
    terms = spark.createDataFrame([("fox",), ("zebra",), ("the",)], "term string")
    for strategy in ("fast", "exact", "rebuild"):
        # else Spark can't know how few they are, and shuffles all postings of a term to one task
        assert "/frequencies-" in plan(log.live_postings(strategy, terms))


def test_ranks(spark):
    ids = [0, 5, 62, 63, 64, 127, 128, 1000, 10**12, 10**12 + 1]
    held, place, there = ranks(spark.createDataFrame([(i,) for i in ids], "x long"), "x")
    asked_for = spark.createDataFrame([(i,) for i in [*ids, 1, 65, 10**12 + 2]], "x long").withColumn("rank_bucket", F.shiftright("x", 6))
    assert {r["x"]: r["p"] for r in asked_for.join(held, "rank_bucket").filter(there).select("x", place.alias("p")).collect()} == {x: i for i, x in enumerate(ids)}


def test_fingerprint_is_the_sum_of_the_hashes(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 101).alias("x"))
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64("id", "x").cast("decimal(38,0)"))).first()
    assert store.fingerprint(df) == (n, str(total)) and store.fingerprint(df.limit(0)) == (0, "0")
