"""Benchmark decontamination by Wu-Manber multi-pattern search.

Benchmark items and documents are brought to one form: words (runs of letters, digits and non-ASCII characters) in small letters,
a space before, between and after them. The test strings are all windows of ``N_WORDS`` words of an item, or the whole
item where it has fewer, but at least ``MIN_WORDS``: an item of one or two common words would accuse every text that has them.
A document is contaminated by an item if it contains one of its test strings.

Search: with m the length of the shortest test string, only the first m bytes of each string count for shifting. The
shift table has, for the hash of a block of ``B`` bytes, how far the search window can move at least; blocks that occur in no
prefix let it move by m - B + 1. Where the shift is 0, the bucket of that suffix block lists the test strings to
compare directly, byte by byte. The search positions of many stretches of text move side by side in numpy.

Test strings are places in one buffer of the items' text, some 30 bytes each beside it; no string is an object by itself. Beyond
``PASS_WINDOWS`` of them the documents are searched in several passes, so neither the driver nor a worker holds more at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import CHUNK_BYTES, LOWER_BYTE, WORD_BYTE, _tables, mix64, slices, spread, text_buffers
from ._shared import fresh, table

N_WORDS = 13
MIN_WORDS = 3
PASS_WINDOWS = 1 << 20
_BLOCK = 8
_LANE = 1024
_SLICE = 2 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in small letters with one space before, between and after; a text without words is empty."""
    n = len(offsets) - 1
    inside = WORD_BYTE[data]
    first, last = inside.copy(), inside.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if len(data):
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
    some = np.zeros(n, np.int64)
    word_row = np.searchsorted(offsets, np.flatnonzero(first), side="right") - 1
    some[word_row] = 1
    # each word byte goes one place on for each word before it in the whole buffer and for each text with words up to its own
    rank = np.cumsum(inside) + np.cumsum(first)
    shift = np.cumsum(some)
    at = np.flatnonzero(inside)
    row = np.searchsorted(offsets, at, side="right") - 1
    word_bytes = np.bincount(row, minlength=n)
    words = np.bincount(word_row, minlength=n)
    size = word_bytes + words + some
    out_offsets = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(out_offsets[-1]), 32, np.uint8)
    out[rank[at] - 1 + shift[row] - 1] = LOWER_BYTE[data[at]]
    return out, out_offsets


def _blocks(data: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` (up to 8) bytes that end before each of ``ends``, as one number."""
    key = np.zeros(len(ends), np.uint64)
    for j in range(width):
        key |= data[ends - width + j].astype(np.uint64) << np.uint64(8 * j)
    return key


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (key * _MULT >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Patterns:
    """Test strings ``data[start : start + size]``, in the order of their suffix blocks; string j is of the items ``item[first[j] : first[j + 1]]``."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    first: np.ndarray
    item: np.ndarray
    m: int
    width: int
    bits: int
    shift: np.ndarray
    suffix: np.ndarray

    def string(self, j: int) -> bytes:
        return self.data[self.start[j] : self.start[j] + self.size[j]].tobytes()


def windows(data: np.ndarray, offsets: np.ndarray, n_words: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, end) of the test strings of normalised items."""
    spaces = np.flatnonzero(data == 32)
    first = np.searchsorted(spaces, offsets)
    n = np.diff(first) - 1
    count = np.where(n >= max(1, min_words), np.maximum(n - n_words + 1, 1), 0)
    at = spread(first[:-1], count)
    return np.repeat(np.arange(len(n)), count), spaces[at], spaces[at + np.repeat(np.minimum(n, n_words), count)] + 1


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches sorted by their start."""
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + CHUNK_BYTES)))
        lo, hi = int(start[a]), int(end[a:b].max())
        power, inverse = _tables(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
        out[a:b] = mix64((sums[end[a:b] - lo] - sums[start[a:b] - lo]) * inverse[start[a:b] - lo] + (end[a:b] - start[a:b]).astype(np.uint64))
        a = b
    return out


def _representatives(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each string the first that equals it. Strings of one hash are compared byte by byte."""
    _, first, code = np.unique(_hashes(data, start, end), return_index=True, return_inverse=True)
    rep = first[code]
    size = end - start
    other = np.flatnonzero(rep != np.arange(len(rep)))
    odd = other[size[other] != size[rep[other]]]
    other = other[size[other] == size[rep[other]]]
    for a in range(0, len(other), 50_000):
        part = other[a : a + 50_000]
        same = data[spread(start[part], size[part])] == data[spread(start[rep[part]], size[part])]
        apart = np.add.reduceat(~same, np.cumsum(size[part]) - size[part]) > 0
        odd = np.append(odd, part[apart])
    held: dict[bytes, int] = {}
    for j in odd.tolist():  # other strings of an equal hash
        rep[j] = held.setdefault(data[start[j] : end[j]].tobytes(), j)
    return rep


def build(data: np.ndarray, offsets: np.ndarray, n_words: int = N_WORDS, min_words: int = MIN_WORDS) -> Patterns:
    """Tables for normalised items."""
    item, start, end = windows(data, offsets, n_words, min_words)
    if not len(item):
        z = np.zeros(0, np.int64)
        return Patterns(data, z, z, np.zeros(1, np.int64), z, 0, 0, 1, np.zeros(2, np.uint8), np.zeros(0, np.uint64))
    rep = _representatives(data, start, end)
    held, code = np.unique(rep, return_inverse=True)
    start, size = start[held], (end - start)[held]
    m = int(size.min())
    width = min(_BLOCK, m)
    suffix = _blocks(data, start + m, width)
    order = np.argsort(suffix, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pair = np.unique(place[code] * (int(item[-1]) + 1) + item)
    owner, item = pair // (int(item[-1]) + 1), pair % (int(item[-1]) + 1)
    start, size = start[order], size[order]
    # the shift of a block is that of its last place in any prefix, so later places overwrite earlier ones
    bits = int(np.clip(np.ceil(np.log2(len(start) * (m - width + 1))) + 3, 16, 24))
    shift = np.full(1 << bits, min(255, m - width + 1), np.uint8)
    for e in range(max(width, m - 255), m + 1):
        shift[_slot(_blocks(data, start + e, width), bits)] = m - e
    return Patterns(data, start.astype(np.int32), size.astype(np.int32), np.searchsorted(owner, np.arange(len(start) + 1)).astype(np.int32), item.astype(np.int32), m, width, bits, shift, suffix[order])


def search(pats: Patterns, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, test string) of every occurrence in normalised bytes."""
    found_at: list[int] = []
    found: list[int] = []
    m, n = pats.m, len(data)
    if not m or n < m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # lanes own the window ends m..n between them
    end = np.arange(m, n + 1, _LANE)
    stop = np.minimum(end + _LANE, n + 1)
    while len(end):
        key = _blocks(data, end, pats.width)
        step = pats.shift[_slot(key, pats.bits)]
        zero = np.flatnonzero(step == 0)
        if len(zero):
            lo, hi = np.searchsorted(pats.suffix, key[zero], "left"), np.searchsorted(pats.suffix, key[zero], "right")
            count = hi - lo
            at, which = np.repeat(end[zero] - m, count), spread(lo, count)
            fits = at + pats.size[which] <= n
            at, which = at[fits], which[fits]
            # the first bytes tell most candidates apart
            same = _blocks(data, at + pats.width, pats.width) == _blocks(pats.data, pats.start[which].astype(np.int64) + pats.width, pats.width)
            for x, j in zip(at[same].tolist(), which[same].tolist()):
                if data[x : x + pats.size[j]].tobytes() == pats.string(j):
                    found_at.append(x)
                    found.append(j)
        end = end + np.maximum(step, 1)
        live = end < stop
        if not live.all():
            end, stop = end[live], stop[live]
    return np.array(found_at, np.int64), np.array(found, np.int64)


def _hits(pats: Patterns, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, rows from there, test strings) for slices of a column of lower-case texts; the occurrences once per row and string."""
    data, offsets = text_buffers(column)
    for a, b in slices(offsets, _SLICE):
        norm, at = normalise(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        where, which = search(pats, norm)
        row = np.searchsorted(at, where, side="right") - 1
        # a string begins and ends with a space, so an occurrence can't reach from one text into the next
        both = np.unique(np.stack([row, which]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
        yield a, both[0], both[1]


def _passes(benchmark: DataFrame, n_words: int, min_words: int) -> Iterator[tuple[list[int | None], Patterns]]:
    """(ids of the items, their tables): items in as many parts as their test strings need, by a hash of the id."""
    rows = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"))
    # a word takes two bytes at least, with the space after it
    total = rows.agg(F.sum(F.least(F.octet_length("text") / 2, F.size(F.split("text", "[^a-z0-9\\x80-\\x{10FFFF}]+"))))).first()[0] or 0
    parts = max(1, math.ceil(total / PASS_WINDOWS))
    for k in range(parts):
        some = (rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else rows).toArrow()
        data, offsets = text_buffers(some.column("text"))
        yield some.column("item_id").to_pylist(), build(*normalise(data, offsets), n_words, min_words)


def contamination(docs: DataFrame, benchmark: DataFrame, n_words: int = N_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, n_windows): documents with the benchmark items they contain and how many of an item's test strings.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored. Null and word-less texts match
    nothing, nor do items of fewer than ``min_words`` words. A test string of several items counts for each, and one that occurs twice in a text
    counts once. Repeated rows of ``docs`` give repeated rows; items that share an id are one item. Null ids pass through. Very long texts are searched whole.
    Without documents or test strings there are no rows.
    """
    spark = docs.sparkSession
    out = None
    for ids, pats in _passes(benchmark, n_words, min_words):
        names = sorted(set(ids), key=lambda x: (x is None, x))
        index = {x: i for i, x in enumerate(names)}
        # items as numbers of their ids, once for each string
        number = np.array([index[x] for x in ids], np.int64)
        owner = np.repeat(np.arange(len(pats.start)), np.diff(pats.first))
        pair = np.unique(owner * (len(names) + 1) + number[pats.item]) if len(owner) else owner
        pats.item = (pair % (len(names) + 1)).astype(np.int32)
        pats.first = np.searchsorted(pair // (len(names) + 1), np.arange(len(pats.start) + 1)).astype(np.int32)
        shared = spark.sparkContext.broadcast((pa.array(names, pa.int64()), pats))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, pats = shared.value
            for batch in batches:
                for a, row, which in _hits(pats, batch.column(1)):
                    if len(row):
                        n = (pats.first[which + 1] - pats.first[which]).astype(np.int64)
                        item = pats.item[spread(pats.first[which].astype(np.int64), n)]
                        pair, times = np.unique(np.stack([np.repeat(row, n), item]), axis=1, return_counts=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + pair[0])), names.take(pa.array(pair[1])), pa.array(times.astype(np.int64))], ["doc_id", "item_id", "n_windows"])

        part = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(run, "doc_id long, item_id long, n_windows long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, n_words: int = N_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` that contain no test string, all columns as they were. Each row is judged where it is, without a shuffle.

    Null, empty and word-less texts stay, and repeated rows are judged alike; an empty table stays empty, and without test strings all rows stay.
    Very long texts are searched whole. Columns of any name pass through.
    """
    for _, pats in _passes(benchmark, n_words, min_words):
        shared = docs.sparkSession.sparkContext.broadcast(pats)
        (small,) = fresh(docs.columns, "small_text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for a, row, _ in _hits(shared.value, batch.column(batch.num_columns - 1)):
                    keep[a + row] = False
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(keep))

        docs = docs.withColumn(small, F.lower("text")).mapInArrow(run, docs.schema)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of ``documents`` hold which items of ``benchmark``; see ``contamination`` for nulls, ties, long texts and repeated rows."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"
OP5_SQL = f"""
WITH items AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), strings AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - {N_WORDS - 1}, 1) + 1), lambda i: ' ' || array_to_string(w[i:i + {N_WORDS - 1}], ' ') || ' ')) AS s
  FROM items WHERE len(w) >= {MIN_WORDS}
), texts AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - {N_WORDS - 1} + 1), lambda i: ' ' || array_to_string(w[i:i + {N_WORDS - 1}], ' ') || ' ')) AS s FROM texts
), full_length AS (
  SELECT doc_id, item_id FROM grams JOIN strings USING (s)
), short AS (
  SELECT doc_id, item_id FROM (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM texts) d
  JOIN (SELECT item_id, s FROM strings WHERE len(string_split(trim(s), ' ')) < {N_WORDS}) i ON contains(d.t, i.s)
)
SELECT doc_id, item_id, count(*) AS n_windows FROM (SELECT * FROM full_length UNION ALL SELECT * FROM short) GROUP BY doc_id, item_id
"""
