import math
import random

import pytest
from pyspark.sql import functions as F

import brute
from quillrank import errors
from quillrank.api import Retriever
from quillrank.config import METHODS, Params, parse_method
from quillrank.functions import maths, scoring
from quillrank.functions.stopwords import LANGUAGES, for_language
from quillrank.functions.text import Tokenizer
from quillrank.operators import evaluate, prune, shards
from quillrank.operators import index as ix
from quillrank.operators import search as se
from quillrank.operators.numbering import numbered
from quillrank.streaming.ingest import ChunkedBuilder, follow
from quillrank.streaming.updates import UpdateLog

TEXTS = [
    "the red fox runs over the hill", "a lazy dog sleeps under the hill", "foxes and dogs and cats", "red red red wine in the glass", "the quick river runs past the mill",
    "", "a cat sat by the mill with a dog", "wine and bread and wine", None, "over hill and dale the horn calls", "Größe café naïve 東京 ٣ été",
]
QUERIES = ["red fox", "the hill", "wine wine bread", "nothing known here", "", "café 東京", "dog cat mill"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def asked(spark, texts=QUERIES):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def rows(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


def same(found, docs, method="lucene", k=10, texts=QUERIES, **params):
    held = brute.postings(docs, method, **params)
    for i, q in enumerate(texts):
        want = brute.search(held, q, k, docs)
        got = found.get(i, [])
        assert [d for d, _ in got] == [d for d, _ in want], (method, q)
        assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-9)


@pytest.fixture(scope="module")
def index(spark):
    return ix.build(frame(spark, TEXTS))


@pytest.mark.parametrize("method", METHODS)
def test_every_method_ranks_as_brute_force(spark, index, method):
    found = rows(se.search_batch(index.with_params(Params(method)), asked(spark), 10))
    same(found, dict(enumerate(TEXTS)), method)


@pytest.mark.parametrize(("k1", "b"), [(0.0, 0.75), (1.2, 0.0), (1.2, 1.0)])
def test_extreme_parameters(spark, index, k1, b):
    same(rows(se.search_batch(index.with_params(Params("lucene", k1, b)), asked(spark), 10)), dict(enumerate(TEXTS)), k1=k1, b=b)


def test_random_corpora(spark):
    rnd = random.Random(5)
    docs = {i: " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(0, 30))) for i in range(60)}
    queries = [" ".join(rnd.choice("abcdefghijz") for _ in range(rnd.randrange(1, 5))) for _ in range(20)]
    built = ix.build(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    for method in METHODS:
        same(rows(se.search_batch(built.with_params(Params(method)), asked(spark, queries), 7)), docs, method, 7, queries)
    assert rows(prune.search_pruned(built, asked(spark, queries), 7, 8)).keys() == rows(se.search_batch(built, asked(spark, queries), 7)).keys()
    a, b = rows(prune.search_pruned(built, asked(spark, queries), 7, 8)), rows(se.search_batch(built, asked(spark, queries), 7))
    assert {q: [d for d, _ in x] for q, x in a.items()} == {q: [d for d, _ in x] for q, x in b.items()}


def test_closed_form_score(spark):
    p = Params("lucene", 1.2, 0.75)
    got = spark.range(1).select(scoring.score(p, F.lit(1000), F.lit(100), F.lit(3), F.lit(100), F.lit(80.0)).alias("s")).first()["s"]
    k1 = float(brute.f32(1.2))
    want = math.log(1 + 900.5 / 100.5) * 3 / (k1 * (0.25 + 0.75 * 100 / 80) + 3)
    assert got == pytest.approx(want, rel=1e-6)


def test_stats_count_empty_documents(index):
    assert index.stats.n_docs == len(TEXTS)
    assert index.lengths.filter("doc_len = 0").count() == 2
    assert all(v == 0 for v in ix.violations(index).first())


def test_ways_to_search_agree(spark, index):
    batch = rows(se.search_batch(index, asked(spark), 5))
    single = rows(se.search_batch(index, asked(spark), 5, exact_single=True))
    for i, q in enumerate(QUERIES):
        alone = [(r["doc_id"], r["score"]) for r in se.search(index, q, 5).orderBy("rank").collect()]
        assert [d for d, _ in alone] == [d for d, _ in batch.get(i, [])]
        assert [s for _, s in alone] == pytest.approx([s for _, s in batch.get(i, [])])
        assert [s for _, s in single.get(i, [])] == pytest.approx([s for _, s in batch.get(i, [])], rel=1e-5)
    dense = se.dense_scores(index, asked(spark))
    assert dense.count() == len(TEXTS) * len(QUERIES)
    assert dense.filter("query_id = 3 AND score <> 0").count() == 0


def test_ties_go_to_the_lower_id(spark):
    found = Retriever(spark).index(["same words", "other", "same words", "same words"]).search("same", 2)
    assert found[0] == [0, 2]


def test_bad_arguments(spark, index):
    for bad in ({"k1": -1}, {"b": 1.1}, {"b": float("nan")}, {"method": "tfidf"}, {"method": "bm25l", "delta": -1}):
        with pytest.raises(errors.InvalidParameter):
            Params(**bad)
    Params("lucene", delta=-1)
    assert parse_method("BM25+") == "bm25plus"
    with pytest.raises(errors.InvalidParameter):
        se.search_batch(index, asked(spark), 0)
    with pytest.raises(errors.EmptyCorpus):
        ix.build(frame(spark, TEXTS).limit(0))
    with pytest.raises(errors.InvalidParameter):
        prune.block_maxima(index.postings, 100)


def test_all_empty_corpus_is_an_index(spark):
    r = Retriever(spark).index(["", ""])
    assert r.search("a") == ([], []) and r.stats()["avg_doc_len"] == 0


def test_tokenizer(spark):
    def run(t, text):
        return spark.createDataFrame([(text,)], "text string").select(t.tokens(F.col("text"))).first()[0]

    assert run(Tokenizer(), "Été, 東京-tower x_1!") == ["été", "東京", "tower", "x_1"]
    assert run(Tokenizer(), None) == []
    assert run(Tokenizer(lowercase=False), "Ab cD") == ["Ab", "cD"]
    assert run(Tokenizer(pattern="[a-z]+"), "ab1cd") == ["ab", "cd"]
    assert run(Tokenizer(stemmer="english"), "running jumps easily") == ["run", "jump", "easili"]
    assert run(Tokenizer(stopwords=tuple(for_language("EN"))), "the cat and dog") == ["cat", "dog"]
    assert run(Tokenizer(custom=lambda s: s.split("|")), "A b|C") == ["A b", "C"]
    assert Tokenizer().language("de").stemmer == "german" and Tokenizer().language("klingon") == Tokenizer() and Tokenizer().language("fr").stemmer == "french" and Tokenizer().language("ta").stemmer == "tamil" and Tokenizer().language("hi").stemmer is None
    with pytest.raises(errors.TokenizationError):
        Tokenizer(pattern="(")
    assert Tokenizer.from_json(Tokenizer(stopwords=("a",), stemmer="english").to_json()) == Tokenizer(stopwords=("a",), stemmer="english")


def test_stems():
    from quillrank.functions.stemming import STEMMERS
    from quillrank.plans import stems

    assert len(STEMMERS) == 17
    assert [(k, w, STEMMERS[k](w)) for k, w, _ in stems.rows()] == stems.rows()
    # light stemmers
    assert STEMMERS["arabic"]("والكتاب") == "كتاب" and STEMMERS["turkish"]("evlerden") == "evler"[:2] + "ler" and STEMMERS["turkish"]("kitapları") == "kitap"
    rnd = random.Random(2)
    for stem in STEMMERS.values():
        for _ in range(300):
            assert isinstance(stem("".join(rnd.choice("abcdeghilmnorstuvyéèçãõäößáőёстйаиؤالகை'") for _ in range(rnd.randrange(1, 12)))), str)


def test_stopword_lists():
    assert len(LANGUAGES) == 17 and len(for_language("english")) == 33 and for_language("xx") is None


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert numbered(df, ["x"], "n", 5).filter("n <> x + 5").count() == 0
    assert numbered(df.limit(0), ["x"], "n").count() == 0


def test_vocabulary_and_tokenized(spark):
    docs = frame(spark, ["b a b", "c a", ""])
    vocab = ix.vocabulary(docs, Tokenizer())
    assert {r["term"]: r["term_id"] for r in vocab.collect()} == {"b": 0, "a": 1, "c": 2}
    got = {r["doc_id"]: (list(r["token_ids"]), r["length"]) for r in ix.tokenized(docs, Tokenizer(), vocab).collect()}
    assert got == {0: ([0, 1, 0], 3), 1: ([2, 1], 2), 2: ([], 0)}


def test_cache():
    c = se.QueryCache(2)
    c.put("a", 1, [1]), c.put("b", 1, [2]), c.get("a", 1), c.put("c", 1, [3])
    assert c.get("b", 1) is None and c.get("a", 1) == [1] and len(c) == 2
    none = se.QueryCache(0)
    none.put("a", 1, [1])
    assert len(none) == 0


def test_blocks(spark, index):
    blocks = prune.block_maxima(index.postings, 2)
    assert blocks.agg(F.max("block_no")).first()[0] >= 1
    whole = {r["term"]: r["m"] for r in blocks.groupBy("term").agg(F.max("block_max").alias("m")).collect()}
    assert whole == {r["term"]: r["max_score"] for r in prune.term_maxima(index.postings).collect()}


def test_shards(spark, index):
    whole = rows(se.search_batch(index, asked(spark), 4))
    for n in (1, 3):
        got = shards.search_shards(index, asked(spark), 4, n)
        assert not got.degraded and {q: [d for d, _ in x] for q, x in rows(got.rows).items()} == {q: [d for d, _ in x] for q, x in whole.items()}
    part = shards.search_shards(index, asked(spark), 4, 3, silent=(1,))
    assert part.degraded and part.responded == 2 and part.rows.filter("doc_id % 3 = 1").count() == 0
    with pytest.raises(errors.ShardFailure):
        shards.search_shards(index, asked(spark), 4, 2, silent=(0, 1))
    df = {r["term"]: r["df"] for r in index.terms.collect()}
    assert {r["term"]: r["df"] for r in shards.global_idf(index, 3).collect()} == df


def test_evaluation(spark):
    results = spark.createDataFrame([(0, 1, 10, 1.0), (0, 2, 11, 0.9), (0, 3, 12, 0.8), (0, 4, 13, 0.7), (0, 5, 14, 0.6), (1, 1, 10, 1.0)], "query_id long, rank int, doc_id long, score double")
    qrels = spark.createDataFrame([(0, 10, 3), (0, 12, 2), (0, 13, 1), (2, 5, 1)], "query_id long, doc_id long, grade int")
    want = (3 + 2 / 2 + 1 / math.log2(5)) / (3 + 2 / math.log2(3) + 1 / 2)
    got = {r["query_id"]: r["ndcg"] for r in evaluate.ndcg(results, qrels, 5).collect()}
    assert got == {0: pytest.approx(want), 2: 0.0}
    assert evaluate.mean_ndcg(results, qrels, 5).first()["mean_ndcg"] == pytest.approx(want / 2)
    assert evaluate.mean_ndcg(results, qrels.limit(0), 5).first()["mean_ndcg"] == 0
    assert evaluate.recall(results, results, 3).filter("recall <> 1").count() == 0
    fused = evaluate.fuse([results, results], 2).filter("query_id = 0").orderBy("rank").collect()
    assert [r["doc_id"] for r in fused] == [10, 11] and fused[0]["score"] == pytest.approx(2 / 61)
    values = spark.createDataFrame([(x,) for x in (5, 1, 4, 2, 3)], "v int")
    assert {r["p"]: r["value"] for r in evaluate.percentiles(values, "v", [0, 50, 100]).collect()} == {0: 1, 50: 3, 100: 5}
    assert evaluate.percentiles(values.limit(0), "v", [50]).count() == 0


def test_maths(spark):
    one = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0], [])], "a array<float>, b array<float>, c array<float>")
    r = one.select(maths.dot(F.col("a"), F.col("b")).alias("d"), maths.greatest_of(F.col("c")).alias("m"), maths.percentile(F.col("a"), 50).alias("p"), maths.harness_percentile(F.col("a"), 99).alias("h")).first()
    assert (r["d"], r["m"], r["p"], r["h"]) == (14.0, float("-inf"), 2.0, 3.0)
    z = maths.zscores(spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "g int, v double"), "v", "g")
    assert sorted((r["g"], r["z"]) for r in z.collect()) == [(0, -1.0), (0, 1.0), (1, 1.0)]
    assert maths.format_bytes(1536) == "1.50 KB" and maths.format_bytes(12) == "12 B"


def test_bytes_labels_round_halves_to_even(spark):
    labels = {
        None: None, 0: "0 B", 1023: "1023 B", 1152: "1.12 KB", 1151: "1.12 KB", 1153: "1.13 KB", 1408: "1.38 KB", 272000: "265.62 KB", (1 << 20) - 1: "1024.00 KB", 9 << 17: "1.12 MB", 11 << 17: "1.38 MB",
        9 << 27: "1.12 GB", (9 << 27) + 1: "1.13 GB", 4503599632739205: "4194304.00 GB", (1 << 63) - 1: "8589934592.00 GB",
    }
    rows = spark.createDataFrame([(n,) for n in labels], "n long").select("n", maths.bytes_label(F.col("n")).alias("label")).collect()
    assert {r["n"]: r["label"] for r in rows} == labels
    assert all(maths.format_bytes(n) == label for n, label in labels.items() if n is not None)


def test_updates(spark, index):
    log = UpdateLog(index)
    assert log.is_empty() and not log.should_compact()
    ids = log.append_texts(["red fox red fox", "new zebra hill"])
    assert ids == [11, 12]
    report = log.delete_documents([0, 0, 99, 12])
    assert (report.deleted, report.not_found) == (2, [0, 99])
    assert log.delete_documents([0]).not_found == [0]
    assert (log.added_count(), log.deleted_count(), log.live_count()) == (2, 2, 11)
    assert log.is_deleted(0) and not log.is_deleted(1) and log.should_compact()
    live = {i: t for i, t in enumerate([*TEXTS, "red fox red fox"]) if i != 0}
    same(rows(log.search(asked(spark), 10, "rebuild")), live)
    fast = rows(log.search(asked(spark), 10))
    assert 0 not in [d for d, _ in fast[0]] and fast[0][0][0] == 11
    assert rows(log.search(asked(spark), 10, "exact")).keys() == fast.keys()
    compacted, renamed = log.compact()
    old = {r["doc_id"]: r["old_id"] for r in renamed.collect()}
    assert sorted(old) == list(range(11)) and [old[i] for i in range(11)] == sorted(live)
    got = {q: [(old[d], s) for d, s in x] for q, x in rows(se.search_batch(compacted, asked(spark), 10)).items()}
    same(got, live)
    again = UpdateLog(index, log.path)
    assert again.live_count() == 11 and again.append_texts(["x"]) == [13]


def test_batches_of_updates(spark, index):
    log = UpdateLog(index)
    with pytest.raises(errors.LogState):
        log.commit_batch()
    log.begin_batch()
    log.append_texts(["zebra"])
    assert log.added_count() == 0
    log.rollback_batch()
    log.begin_batch()
    ids = log.append_texts(["zebra"])
    log.delete_documents(ids)
    log.commit_batch()
    assert log.added_count() == 1 and log.deleted_count() == 1 and rows(log.search(asked(spark, ["zebra"]), 5)) == {}
    gone = log.delete_frame(spark.createDataFrame([(i,) for i in (1, 1, 2, 77)], "doc_id long"))
    assert {r["doc_id"]: r["deleted"] for r in gone.collect()} == {1: True, 2: True, 77: False}
    every = UpdateLog(ix.build(frame(spark, ["a"])))
    every.delete_documents([0])
    with pytest.raises(errors.EmptyCorpus):
        every.compact()


def test_chunks_and_streams(spark, index, tmp_path):
    built = ChunkedBuilder(spark, chunk_size=3).add_documents(TEXTS).build()
    assert sorted(map(tuple, built.postings.collect())) == sorted(map(tuple, index.postings.collect()))
    with pytest.raises(errors.EmptyCorpus):
        ChunkedBuilder(spark).build()
    spark.createDataFrame([("zebra one",), ("zebra two",)], "text string").write.parquet(f"{tmp_path}/in")
    log = UpdateLog(index)
    stream = spark.readStream.schema("text string").parquet(f"{tmp_path}/in")
    follow(stream, log, f"{tmp_path}/checkpoint").awaitTermination(120)
    assert [d for d, _ in rows(log.search(asked(spark, ["zebra"]), 5))[0]] == [11, 12]


def test_streams_share_a_log(spark, index, tmp_path):
    log = UpdateLog(index)
    for name in ("a", "b"):
        spark.createDataFrame([(f"zebra {name}",)], "text string").write.parquet(f"{tmp_path}/in-{name}")
        stream = spark.readStream.schema("text string").parquet(f"{tmp_path}/in-{name}")
        follow(stream, log, f"{tmp_path}/checkpoint-{name}").awaitTermination(120)
    assert log.added_count() == 2
    # a batch tried again, by another log on the same files as after a crash
    again = UpdateLog(index, log.path)
    mark = tuple(log.log().filter("content = 'zebra a'").select("stream", "batch").first())
    more = spark.createDataFrame([("zebra a",)], "text string")
    assert again.append_documents(more, mark=mark) == (13, 13) and again.added_count() == 2
    assert again.append_documents(more, mark=(mark[0], mark[1] + 1)) == (13, 14)
    spark.createDataFrame([("zebra c",)], "text string").write.mode("append").parquet(f"{tmp_path}/in-a")
    stream = spark.readStream.schema("text string").parquet(f"{tmp_path}/in-a")
    log = UpdateLog(index, log.path)
    follow(stream, log, f"{tmp_path}/checkpoint-a").awaitTermination(120)
    # its number is the one given by hand above
    assert log.added_count() == 3


def test_additions_are_counted_once(spark, index):
    log = UpdateLog(index)
    log.append_texts(["zebra one"])
    first = log._added_counts()
    assert log._added_counts() is first
    log.append_texts(["zebra two two"])
    assert sorted((r["term"], r["tf"]) for r in log._added_counts().collect()) == [("one", 1), ("two", 2), ("zebra", 1), ("zebra", 1)]
    for strategy in ("fast", "exact", "rebuild"):
        whole = {(r["term"], r["doc_id"]): (r["df"], r["score"]) for r in log.live_postings(strategy).collect()}
        part = {(r["term"], r["doc_id"]): (r["df"], r["score"]) for r in log.live_postings(strategy, ["zebra", "fox"]).collect()}
        assert part == {k: v for k, v in whole.items() if k[0] in ("zebra", "fox")}


def test_string_ids(spark, tmp_path):
    docs = spark.createDataFrame([("MED-10", "red fox"), ("MED-2", "red dog"), ("x", None), (None, "lost")], "doc_id string, text string")
    built = ix.build(docs)
    found = built.named(se.search_batch(built, asked(spark, ["red fox"]), 5)).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == ["MED-10", "MED-2"] and built.stats.n_docs == 3
    r = Retriever(spark).index(docs)
    r.save(str(tmp_path / "held"))
    back = Retriever.load(spark, str(tmp_path / "held"))
    assert back.names(back.search("dog")[0]) == ["MED-2"]


def test_empty_index(spark):
    none = ix.empty(spark)
    assert se.search_batch(none, asked(spark), 5).count() == 0 and all(v == 0 for v in ix.violations(none).first()) and none.stats.n_docs == 0


def test_violations_are_found(spark, index):
    broken = [("a", 0, 2, 1, 1, 1.0), ("a", 0, 1, 1, 1, 1.0), ("b", 99, 1, 2, 1, 0.0), ("c", 1, 0, 2, 1, float("nan")), ("c", 2, 1, 2, 1, 1.0), (None, 1, 1, 1, 1, 1.0)]
    import dataclasses

    held = dataclasses.replace(index, postings=spark.createDataFrame(broken, ix.POSTINGS))
    assert ix.violations(held).first().asDict() == {"repeated_pairs": 1, "unknown_documents": 1, "nulls": 1, "not_finite": 1, "zero_scores": 1, "bad_counts": 2, "bad_frequencies": 2}


def test_approximate(spark, index):
    with pytest.raises(errors.FeatureNotEnabled):
        prune.search_approximate(index, asked(spark), 3)
    bounded = prune.with_bounds(index, 2)
    a, b = rows(prune.search_approximate(bounded, asked(spark), 3)), rows(se.search_batch(index, asked(spark), 3))
    assert {q: [d for d, _ in x] for q, x in a.items()} == {q: [d for d, _ in x] for q, x in b.items()}
    # common words in long queries, negative scores among them
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    docs = [" ".join(w for i, w in enumerate(words) if rnd.random() < 1 / (1 + i / 3)) for _ in range(120)]
    texts = [" ".join(rnd.sample(words, 15) + words[:5]) for _ in range(12)]
    for method in ("lucene", "robertson"):
        built = prune.with_bounds(ix.build(frame(spark, docs), Params(method)), 16)
        a, b = rows(prune.search_pruned(built, asked(spark, texts), 5, decimals=6)), rows(se.search_batch(built, asked(spark, texts), 5, decimals=6))
        assert {q: [d for d, _ in x] for q, x in a.items()} == {q: [d for d, _ in x] for q, x in b.items()}
        assert all(s == pytest.approx(t) for q in a for (_, s), (_, t) in zip(a[q], b[q]))
    assert bounded.with_params(Params("atire")).maxima is None


def test_batches_of_many_terms_are_joined(spark, index, monkeypatch):
    want = rows(se.search_batch(index, asked(spark), 5))
    monkeypatch.setattr(se, "TERM_LIMIT", 3)
    assert se.batch_terms(se.query_terms(asked(spark), index.tokenizer)).count() > 3
    assert rows(se.search_batch(index, asked(spark), 5)) == want


def test_shard_services(spark, index):
    parts = [TEXTS[:4], TEXTS[4:8], TEXTS[8:]]
    services = [shards.Shard(ix.build(frame(spark, x)), offset) for x, offset in zip(parts, (0, 4, 8))]
    whole = rows(se.search_batch(index, asked(spark), 4))
    coordinator = shards.Coordinator(services)
    found = coordinator.search(asked(spark), 4)
    assert not found.degraded and rows(found.rows) == {q: [(d, pytest.approx(s)) for d, s in x] for q, x in whole.items()}
    assert [h["num_docs"] for h in coordinator.health()] == [4, 4, 3]

    class Lost(shards.Shard):
        def search(self, queries, k):
            raise OSError("gone")

        health = collect_idf = search

    part = shards.Coordinator([services[0], Lost(services[1].index)]).search(asked(spark), 4)
    assert part.degraded and part.responded == 1 and part.total == 2
    with pytest.raises(errors.ShardFailure):
        shards.Coordinator([Lost(services[1].index)]).search(asked(spark), 4)
    with pytest.raises(errors.InvalidParameter):
        shards.Coordinator([])


def test_percentiles_of_doubles(spark):
    rnd = random.Random(1)
    values = [rnd.random() for _ in range(999)] + [0.5, 0.5]
    got = {r["p"]: r["value"] for r in evaluate.percentiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0, 1, 50, 99.9, 100]).collect()}
    values.sort()
    assert got == {p: values[int(p / 100 * 1000 + 0.5)] for p in (0, 1, 50, 99.9, 100)}


def test_tokens_match_before_they_are_lowered(spark):
    def run(pattern, text):
        return spark.createDataFrame([(text,)], "text string").select(Tokenizer(pattern=pattern).tokens(F.col("text"))).first()[0]

    assert run("[A-Z]+", "Hello NASA World") == ["h", "nasa", "w"] and run("[a-z]{4,}", "Hello NASA World") == ["ello", "orld"]
    assert run(r"\w+", "ÉTÉ İstanbul Σ") == [x.lower() for x in ("ÉTÉ", "İstanbul", "Σ")]
