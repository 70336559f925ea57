"""Corpus cleaning in stages; each calls one operator of ``quillrank.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last keep the columns of ``documents``; the last adds the ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import langid, linededup, pieces, simhash, wumanber
from quillrank.llm._shared import cut, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language explains go (null, empty and letterless texts among them); ``lang`` of the others is the language found.

    Repeated rows are judged alike, null ids pass through, an empty table stays empty.
    """
    return langid.accepted(docs, relabel=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of more than ``linededup.MAX_DOCS`` documents go, but for the document with the least id that has them: it keeps
    its lines, so of a document with thousands of copies one stays whole. Documents of which nothing is left go, null and blank texts too;
    an empty table stays empty."""
    out = linededup.drop_common_lines(docs, keep_first=True).filter(r"text RLIKE '\\S'")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the least id stays. Null and word-less texts and null ids belong to no group and
    stay, as do repeated rows of a document that stays; an empty table stays empty."""
    # a written table has a size, by which Spark broadcasts it or not
    gone = cut(simhash.near_duplicates(docs).select("doc_id"), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test string of ``benchmark`` go; null, empty and word-less texts hold none. Repeated rows are judged alike, and with
    no benchmark all stay."""
    return wumanber.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their texts, the number of ids, and whether decoding gives the text back. A null text has null ids, an
    empty one none; long texts are encoded whole, repeated rows alike."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the cross-parsing, trie or merge stages: tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
