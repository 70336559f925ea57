"""Pieces of DuckDB SQL that compute from the raw tables what the operators compute, written independently of them."""

from __future__ import annotations


def tokens(text: str, pattern: str = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+") -> str:
    return f"regexp_extract_all(lower({text}), '{pattern}')"


def idf(method: str, n: str, df: str) -> str:
    inner = {
        "robertson": f"({n} - {df} + 0.5::DOUBLE) / ({df} + 0.5::DOUBLE)", "lucene": f"1 + ({n} - {df} + 0.5::DOUBLE) / ({df} + 0.5::DOUBLE)",
        "atire": f"{n}::DOUBLE / {df}", "bm25l": f"({n} + 1::DOUBLE) / ({df} + 0.5::DOUBLE)", "bm25plus": f"({n} + 1::DOUBLE) / {df}",
    }[method]
    return f"ln({inner})::FLOAT::DOUBLE"


def weight(method: str, tf: str, dl: str, mean: str) -> str:
    """At k1 1.5, b 0.75 and delta 0.5."""
    norm = f"(0.25::DOUBLE + 0.75::DOUBLE * ({dl}::DOUBLE / {mean}))"
    inner = {
        "robertson": f"{tf} / (1.5::DOUBLE * {norm} + {tf})", "lucene": f"{tf} / (1.5::DOUBLE * {norm} + {tf})", "atire": f"{tf} * 2.5::DOUBLE / ({tf} + 1.5::DOUBLE * {norm})",
        "bm25l": f"2.5::DOUBLE * ({tf} + 0.5::DOUBLE) / (1.5::DOUBLE + {tf} + 0.5::DOUBLE)", "bm25plus": f"2.5::DOUBLE * {tf} / (1.5::DOUBLE * {norm} + {tf}) + 0.5::DOUBLE",
    }[method]
    return f"({inner})::FLOAT::DOUBLE"


def score(method: str, n: str, df: str, tf: str, dl: str, mean: str) -> str:
    return f"({idf(method, n, df)} * {weight(method, tf, dl, mean)})::FLOAT"


DOCS = f"""d AS (SELECT doc_id, {tokens("text")} AS toks FROM documents)"""
STATS = """lens AS (SELECT doc_id, len(toks)::BIGINT AS dl FROM d),
st AS (SELECT count(*) AS n, sum(dl)::BIGINT AS total, (sum(dl)::FLOAT::DOUBLE / count(*)::FLOAT::DOUBLE)::FLOAT::DOUBLE AS mean FROM lens)"""
COUNTS = """tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
QUERIES = f"""q AS (SELECT item_id AS query_id, unnest({tokens("text")}) AS term FROM benchmark)"""


def postings(method: str = "lucene") -> str:
    """CTEs down to post (doc_id, term, tf, dl, df, score)."""
    return f"""{DOCS}, {STATS}, {COUNTS},
post AS (SELECT * FROM (SELECT doc_id, term, tf, dl, df, {score(method, "n", "df", "tf", "dl", "mean")} AS score FROM tf JOIN df USING (term) JOIN lens USING (doc_id), st) WHERE score <> 0)"""


def scores(method: str = "lucene", queries: str = QUERIES) -> str:
    """CTEs down to sc (query_id, doc_id, score)."""
    return f"""{postings(method)}, {queries},
sc AS (SELECT query_id, doc_id, sum(score::DOUBLE) AS score FROM post JOIN q USING (term) GROUP BY query_id, doc_id)"""


def top(k: int, source: str = "sc", keys: str = "query_id") -> str:
    """CTE best (..., rank, doc_id, score), ranks by the score rounded to 6 decimals."""
    return f"""best AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 6) DESC, doc_id) AS rank FROM {source} WHERE score > 0 QUALIFY rank <= {k})"""
