import json

import pytest

from quillrank import errors
from quillrank.__main__ import main
from quillrank.api import Retriever
from quillrank.functions.text import Tokenizer
from quillrank.output import Service, as_table
from quillrank.sources import readers, store, synthetic


def texts(df):
    return [r["text"] for r in df.orderBy("doc_id").collect()]


def write(tmp_path, name, content):
    (tmp_path / name).write_text(content, encoding="utf-8")
    return str(tmp_path / name)


def test_formats(spark, tmp_path):
    assert [readers.detect_format(x) for x in ("a.JSON", "b.ndjson", "c.jsonl", "d.csv", "e.TSV", "f.txt", "g", "x/h.parquet")] == ["json", "jsonl", "jsonl", "csv", "tsv", "text", "text", "parquet"]
    assert texts(readers.read_corpus(spark, write(tmp_path, "a.json", '["one", "two \\"x\\"", ""]'))) == ["one", 'two "x"', ""]
    assert texts(readers.read_corpus(spark, write(tmp_path, "b.json", '[{"t": "one"}, {"t": "two", "u": 1}]'), "t")) == ["one", "two"]
    assert texts(readers.read_corpus(spark, write(tmp_path, "c.jsonl", '"one"\n\n{"t": "two"}\n'), "t")) == ["one", "two"]
    assert texts(readers.read_corpus(spark, write(tmp_path, "d.csv", 'id,body\n1,"a, ""b"""\n2,\n3,c\n'), "body")) == ['a, "b"', "c"]
    assert texts(readers.read_corpus(spark, write(tmp_path, "e.tsv", "body\tid\nx y\t1\n"))) == ["x y"]
    assert texts(readers.read_corpus(spark, write(tmp_path, "f.txt", "  one \n\n two\n"))) == ["one", "two"]
    assert texts(readers.read_loose(spark, write(tmp_path, "g.txt", '{"text": "one"}\nplain\n'))) == ["one", "plain"]


def test_bad_files(spark, tmp_path):
    with pytest.raises(errors.InvalidDocument):
        readers.read_corpus(spark, write(tmp_path, "d.csv", "id,body\n1,a\n"), "text")
    for name, content, field in (("a.jsonl", '{"t": 1}\n', "t"), ("b.jsonl", '{"u": "x"}\n', "t"), ("c.jsonl", '{"t": "x"}\n', None), ("d.json", '{"t": "x"}', "t"), ("e.json", "[1]", None)):
        with pytest.raises(Exception, match="no string|not a string|not a JSON"):
            readers.read_corpus(spark, write(tmp_path, name, content), field).collect()


def test_evaluation_files(spark, tmp_path):
    corpus = readers.read_beir_corpus(spark, write(tmp_path, "corpus.jsonl", '{"_id": "a", "title": "T", "text": "x"}\n{"_id": "b", "title": "", "text": "y"}\n{"_id": "c", "text": "z"}\n'))
    assert {r["doc_id"]: r["text"] for r in corpus.collect()} == {"a": "T x", "b": "y", "c": "z"}
    assert readers.read_beir_queries(spark, write(tmp_path, "q.jsonl", '{"_id": "q", "text": "x"}\n')).first()["query_id"] == "q"
    qrels = readers.read_qrels(spark, write(tmp_path, "q.tsv", "query-id\tcorpus-id\tscore\nq\ta\t1\nq\tb\t2\nq\ta\t3\n"))
    assert {r["doc_id"]: r["grade"] for r in qrels.collect()} == {"a": 3, "b": 2}


def test_store(spark, tmp_path):
    path = str(tmp_path / "held")
    r = Retriever(spark, "bm25+", 1.2, 0.5, 0.25, Tokenizer(stopwords=("the",))).index(["the cat", "the dog", "cat cat"])
    r.save(path)
    back = Retriever.load(spark, path)
    assert back.search("the cat") == r.search("the cat") and back.tokenizer == r.tokenizer and back.params == r.params
    r.index(["one more"]).save(path)
    assert Retriever.load(spark, path).stats()["num_docs"] == 1
    assert "BM25+" in store.card(r.held, "small")
    version = (tmp_path / "held" / "CURRENT").read_text()
    manifest = tmp_path / "held" / version / "manifest.json"
    good = json.loads(manifest.read_text())
    for change, error in (({"version": 9}, errors.UnsupportedVersion), ({"params": {"method": "none"}}, errors.CorruptIndex), ({"tables": {**good["tables"], "terms": [7, "1"]}}, errors.CorruptIndex)):
        (tmp_path / "held" / version / ".manifest.json.crc").unlink(missing_ok=True)
        manifest.write_text(json.dumps(good | change))
        with pytest.raises(error):
            store.load(spark, path)
    with pytest.raises(errors.CorruptIndex):
        store.load(spark, str(tmp_path / "nowhere"))
    with pytest.raises(errors.TokenizationError):
        Retriever(spark, tokenizer=Tokenizer(custom=str.split)).index(["a b"]).save(str(tmp_path / "x"))


def test_retriever(spark):
    r = Retriever(spark, cache_capacity=4)
    with pytest.raises(errors.QuillError):
        r.search("a")
    r.index_tokens([["A b", "c"], [], ["c"]])
    assert r.search("c")[0] == [2, 0] and r.search("c")[0] == [2, 0] and len(r.cache) == 1
    ids, scores = r.search_numpy("c")
    assert ids.tolist() == [2, 0] and scores.dtype == "float32"
    assert r.search_batch([]) == [] and [x[0] for x in r.search_batch(["c", "zzz", "c"])] == [[2, 0], [], [2, 0]]
    assert r.scores("c").count() == 3 and "3 documents" in repr(r)


def test_service(spark):
    s = Service(Retriever(spark).index(["red fox", "red dog"]))
    status, body = s.handle("POST", "/search", '{"query": "fox", "top_k": 1}')
    assert status == 200 and json.loads(body)["results"][0]["doc_id"] == 0
    assert s.handle("POST", "/search", '{"query": "fox", "top_k": 0}')[0] == 400
    assert s.handle("POST", "/search", "{")[0] == 400 and s.handle("POST", "/search", "{}")[0] == 400
    assert s.handle("GET", "/nowhere")[0] == 404 and s.handle("POST", "/admin/reload")[0] == 501
    assert s.handle("POST", "/search", "x" * (s.max_body + 1))[0] == 413
    assert len(json.loads(s.handle("POST", "/batch", '{"queries": ["fox", "dog"]}')[1])["results"]) == 2
    assert json.loads(s.handle("GET", "/stats")[1])["num_docs"] == 2 and s.handle("GET", "/health")[0] == 200
    assert {t["name"] for t in s.tools()} == {"search", "index_stats"} and json.loads(s.call("search", {"query": "dog"}))["count"] == 1


def test_command_line(spark, tmp_path, capsys):
    source, target = write(tmp_path, "docs.txt", "red fox\nlazy dog\n"), str(tmp_path / "out")
    assert main(["index", source, target, "--method", "atire"]) == 0
    assert main(["search", target, "dog", "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["results"][0]["doc_id"] == 1
    assert main(["search", target, "  "]) == 1 and main(["search", str(tmp_path / "no"), "x"]) == 1
    assert "0.500000" in as_table([3], [0.5])


def test_synthetic(spark):
    a, b = synthetic.corpus(spark, 50).collect(), synthetic.corpus(spark, 50).collect()
    assert a == b and all(20 <= len(r["text"].split()) <= 199 for r in a)
    assert synthetic.queries(spark, 5).count() == 5


def test_bad_lines_are_named(spark, tmp_path):
    path = write(tmp_path, "a.jsonl", '{"t": "x"}\n\n"y"\n{"u": 1}\n')
    with pytest.raises(errors.InvalidDocument, match="a.jsonl, line 4: no string in the field 't'"):
        readers.read_jsonl(spark, path, "t")


def test_retrieval_files_end_to_end(spark, tmp_path):
    from quillrank.operators import evaluate
    from quillrank.operators import index as ix
    from quillrank.operators import search as se

    corpus = readers.read_beir_corpus(spark, write(tmp_path, "corpus.jsonl", '{"_id": "d1", "title": "Foxes", "text": "red fox"}\n{"_id": "d2", "text": "lazy dog"}\n'))
    queries = readers.read_beir_queries(spark, write(tmp_path, "queries.jsonl", '{"_id": "q1", "text": "fox"}\n{"_id": "q2", "text": "cat"}\n'))
    qrels = readers.read_qrels(spark, write(tmp_path, "q.tsv", "query-id\tcorpus-id\tscore\nq1\td1\t1\nq2\td2\t1\n"))
    index = ix.build(corpus)
    found = index.named(se.search_batch(index, queries, 10))
    assert {r["query_id"]: r["ndcg"] for r in evaluate.ndcg(found, qrels).collect()} == {"q1": 1.0, "q2": 0.0}


def test_reports():
    from quillrank.output import Measured, Report

    report = Report("2020-01-01", "here", [Measured("small", 10, 4, 1.0, 2.0, [0.1, 0.3, 0.2], 0.5)])
    assert Report.from_json(report.to_json()) == report and "small" in str(report) and report.corpora[0].latency(50) == 200 and report.corpora[0].queries_per_second == 2
    with pytest.raises(errors.SerializationError):
        Report.from_json("{}")


def test_options_and_agents(spark, tmp_path, capsys, monkeypatch):
    import io

    source, target = write(tmp_path, "docs.txt", "The running foxes\nA lazy dog\n"), str(tmp_path / "out")
    assert main(["index", source, target, "--language", "en", "--bounds"]) == 0
    assert "KB" in capsys.readouterr().out
    assert main(["search", target, "fox", "--approximate", "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["results"][0]["doc_id"] == 0
    assert Retriever.load(spark, target).tokenizer.stemmer == "english"
    stops = write(tmp_path, "stops.txt", "lazy the")
    assert main(["index", source, target, "--stopwords", stops, "--stemmer", "none", "--keep-case"]) == 0
    kept = Retriever.load(spark, target)
    assert kept.tokenizer.stopwords == ("lazy", "the") and not kept.tokenizer.lowercase and kept.search("The")[0] == [0]
    assert main(["search", target, "fox", "--approximate"]) == 1
    service = Service(kept)
    assert service.handle("POST", "/search", '{"query": "dog", "approximate": true}')[0] == 501
    lines = [{"id": 1, "method": "initialize"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "dog"}}}, {"method": "notifications/initialized"}, {"id": 4, "method": "none"}]
    monkeypatch.setattr("sys.stdin", io.StringIO("\n".join(map(json.dumps, lines)) + "\nnot json\n"))
    assert main(["mcp", target]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["id"] for x in out] == [1, 2, 3, 4, None] and json.loads(out[2]["result"]["content"][0]["text"])["count"] == 1 and "error" in out[3]
