"""Line deduplication: lines that occur in more than ``max_docs`` distinct documents are dropped.

A line is what stands between line feeds; its normalised form has white space runs as one space, none at its ends
and small letters. Normalised lines are exploded as 64-bit hashes, distinct documents are counted per hash with
partial aggregation (so a line that every document holds is no hot key), and lines over the threshold are dropped;
the others are put together again in their order. Only hashes and ids are shuffled for the counts. Texts move once,
in the join of each document with its own dropped hashes, which Spark turns into a broadcast where that side is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, fresh, table

MAX_DOCS = 10


def line_key(line: Column) -> Column:
    """Hash of the normalised line; null for a line without anything but white space."""
    clean = F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))
    return F.when(clean != "", F.xxhash64(clean))


def drop_common_lines(docs: DataFrame, max_docs: int = MAX_DOCS, keep_first: bool = False, dropped: str | None = None) -> DataFrame:
    """``docs`` with the common lines taken out of ``text``; the other columns stay as they are, whatever their names.

    ``keep_first``: a common line stays in the document with the least doc_id of those that have it.
    ``dropped``: name of a column to add, with the number of lines dropped from the row.
    A null text stays null (0 dropped), an empty one empty. Blank lines are never counted or dropped, and a line
    repeated within a document counts once. Rows that share a doc_id are one document; rows with a null doc_id
    don't count as documents, but their common lines are dropped. A document may end up with an empty text. Very long texts
    count whole, and an empty table stays empty.
    """
    lines = F.split("text", "\n", -1)
    held = docs.select(F.col("doc_id").alias("d"), F.explode(F.array_distinct(F.transform(lines, line_key))).alias("h")).filter("h IS NOT NULL")
    counted = held.groupBy("h").agg(F.countDistinct("d").alias("n"), F.min("d").alias("first"))
    common = cut(counted.filter(F.col("n") > max_docs).select("h", "first"), "common-lines")
    found = held.join(common, "h")
    if keep_first:
        found = found.filter("d IS NULL OR d <> first")
    ident, hashes, parts = fresh(docs.columns, "line_doc", "line_hashes", "line_parts")
    mine = found.groupBy("d").agg(F.collect_set("h").alias(hashes)).withColumnRenamed("d", ident)
    joined = docs.join(mine, docs["doc_id"].eqNullSafe(mine[ident]), "left")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(hashes), line_key(x)), F.lit(False)))
    joined = joined.withColumn(parts, F.when(F.col(hashes).isNotNull() & F.col("text").isNotNull(), kept))
    text = F.when(F.col(parts).isNull(), F.col("text")).otherwise(F.array_join(parts, "\n"))
    out = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    if dropped:
        out.append(F.when(F.col(parts).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(parts)).cast("long").alias(dropped))
    return joined.select(*out)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` without its common lines, and how many these were; see ``drop_common_lines`` for nulls, empty and long texts and repeated rows."""
    return drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), dropped="n_dropped")


OP9_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, line, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS k
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), common AS (
  SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) > {MAX_DOCS}
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.k IS NULL), '') AS text, count(common.k) AS n_dropped
FROM lines LEFT JOIN common ON lines.k = common.k GROUP BY doc_id
"""
