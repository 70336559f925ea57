"""python -m quillrank index|search|serve|mcp|bench: the engine from a shell."""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import SparkSession

from .api import Retriever
from .errors import InvalidParameter, QuillError
from .functions.maths import format_bytes
from .functions.stopwords import CODES, for_language
from .functions.text import Tokenizer
from .output import Measured, Report, Service, as_json, as_table
from .sources import readers, store, synthetic


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("quillrank").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _tokenizer(a: argparse.Namespace) -> Tokenizer:
    """What the options --pattern, --language, --stemmer, --stopwords and --keep-case say, the later ones over the earlier."""
    out = Tokenizer(pattern=a.pattern) if a.pattern else Tokenizer()
    if a.language:
        out = out.language(a.language)
    if a.stemmer:
        out = replace(out, stemmer=None if a.stemmer == "none" else CODES.get(a.stemmer, a.stemmer))
    if a.stopwords:
        words = for_language(a.stopwords)
        if words is None and a.stopwords != "none":
            with open(a.stopwords, encoding="utf-8") as f:
                words = f.read().split()
        out = replace(out, stopwords=tuple(words or ()))
    return replace(out, lowercase=False) if a.keep_case else out


def _index(a: argparse.Namespace) -> None:
    spark = _session()
    began = time.perf_counter()
    retriever = Retriever(spark, a.method, a.k1, a.b, a.delta, _tokenizer(a)).index(readers.read_corpus(spark, a.input, a.field))
    if a.bounds:
        retriever.with_bounds()
    retriever.save(a.output)
    print(f"{Retriever.load(spark, a.output)!r} in {a.output}, {format_bytes(store.size_of(spark, a.output))}, {time.perf_counter() - began:.1f} s")


def _search(a: argparse.Namespace) -> None:
    if not a.query.strip():
        raise InvalidParameter("the query is empty")
    retriever = Retriever.load(_session(), a.index)
    began = time.perf_counter()
    ids, scores = retriever.search(a.query, a.k, a.approximate)
    print(as_json(a.query, ids, scores, time.perf_counter() - began) if a.format == "json" else as_table(ids, scores))


def _mcp(a: argparse.Namespace) -> None:
    """Answers an agent's messages, a line each, until there are no more."""
    service = Service(Retriever.load(_session(), a.index), a.approximate)
    for line in sys.stdin:
        answer = service.message(line) if line.strip() else None
        if answer is not None:
            print(answer, flush=True)


def _serve(a: argparse.Namespace) -> None:
    service = Service(Retriever.load(_session(), a.index), a.approximate)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            body = self.rfile.read(min(size, service.max_body + 1)).decode("utf-8", "replace")
            status, text = service.handle(self.command, self.path, body)
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(text.encode())

        do_GET = do_POST = _answer

    HTTPServer((a.host, a.port), Handler).serve_forever()


def _bench(a: argparse.Namespace) -> None:
    spark = _session()
    began = time.perf_counter()
    retriever = Retriever(spark).index(synthetic.corpus(spark, a.docs))
    built = time.perf_counter() - began
    texts = [r["text"] for r in synthetic.queries(spark, a.queries).collect()]
    began = time.perf_counter()
    retriever.search_batch(texts, a.k)
    batch = time.perf_counter() - began
    single = []
    for t in texts[: a.singles]:
        began = time.perf_counter()
        retriever.search(t, a.k)
        single.append(time.perf_counter() - began)
    measured = Measured("synthetic", a.docs, len(texts), built, batch, single)
    report = Report(time.strftime("%Y-%m-%dT%H:%M:%S"), f"Spark {spark.version}, {spark.sparkContext.master}", [measured])
    print(report.to_json() if a.format == "json" else report)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillrank")
    sub = parser.add_subparsers(required=True)
    p = sub.add_parser("index")
    p.add_argument("input"), p.add_argument("output"), p.add_argument("--field"), p.add_argument("--method", default="lucene")
    p.add_argument("--k1", type=float, default=1.5), p.add_argument("--b", type=float, default=0.75), p.add_argument("--delta", type=float, default=0.5)
    p.add_argument("--pattern"), p.add_argument("--language"), p.add_argument("--stemmer"), p.add_argument("--stopwords", help="a language, a file or none")
    p.add_argument("--keep-case", action="store_true"), p.add_argument("--bounds", action="store_true", help="prepare for --approximate")
    p.set_defaults(run=_index)
    p = sub.add_parser("search")
    p.add_argument("index"), p.add_argument("query"), p.add_argument("-k", type=int, default=10), p.add_argument("--format", choices=("table", "json"), default="table")
    p.add_argument("--approximate", action="store_true")
    p.set_defaults(run=_search)
    p = sub.add_parser("serve")
    p.add_argument("index"), p.add_argument("--host", default="127.0.0.1"), p.add_argument("--port", type=int, default=7720)
    p.add_argument("--approximate", action="store_true")
    p.set_defaults(run=_serve)
    p = sub.add_parser("mcp")
    p.add_argument("index"), p.add_argument("--approximate", action="store_true")
    p.set_defaults(run=_mcp)
    p = sub.add_parser("bench")
    p.add_argument("--docs", type=int, default=10_000), p.add_argument("--queries", type=int, default=100), p.add_argument("--singles", type=int, default=5), p.add_argument("-k", type=int, default=10)
    p.add_argument("--format", choices=("table", "json"), default="table")
    p.set_defaults(run=_bench)
    parsed = parser.parse_args(args)
    try:
        parsed.run(parsed)
    except QuillError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
