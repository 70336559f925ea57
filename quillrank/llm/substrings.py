"""Substring deduplication by relative Lempel-Ziv parsing: passages of ``MIN_WORDS`` words or more that several documents hold.

A document is factored greedily against reference text: the next factor is the longest match with the text of any other document.
A factor of at least ``min_words`` words is a duplicate span. A shared passage either lies in one factor or crosses the
border between two, as a factor that begins inside it reaches its end at least. So at every border that has ``min_words`` words
on both sides together, the stretches of ``min_words`` words across the border are looked up as well. Together that finds
exactly the words that lie in a stretch of ``min_words`` words which another document has too.

Reference blocks are made by content, so that a document need not be held against blocks that can have no long factor for
it: every stretch of ``min_words`` words is led by the least hash of its runs of ``ANCHOR`` words (its anchor), and equal stretches
have equal anchors. Neighbouring stretches with one anchor are a piece, and the pieces with an anchor form a reference block, indexed by its suffixes.
So the longest match of ``min_words`` words or more at a place of a document is found in the block of its anchor, up to the end of the piece; all
blocks of a document are looked up, and its matches are brought together for the parse from its first word to its last. Only anchors of
two documents or more go on, and equal pieces are looked up once, so a document with
thousands of copies costs as much as one: a piece that equals another document's, by a 64-bit hash of its words, is a match to its end. What moves for
every anchor is five numbers; texts move once, those of documents with pieces that differ from all others of their anchor.

Words are runs of letters, digits and non-ASCII characters in small letters, each compared as a 32-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import _tables, mix64, slices, spread, text_buffers, words
from ._shared import cut, table

MIN_WORDS = 50
ANCHOR = 8
#: Reference blocks are indexed in parts of so many words.
PART_WORDS = 1_000_000
_SLICE = 4 << 20


def anchors(hashes: np.ndarray, offsets: np.ndarray, min_words: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor hash, first word, number of stretches) of each piece of texts that are runs of word hashes."""
    n = len(hashes)
    size = np.diff(offsets)
    count = np.maximum(size - min_words + 1, 0)
    if not count.sum():
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z, z
    gram = np.zeros(n, np.uint64)
    power, _ = _tables(width)
    for j in range(width):
        gram[: n - j] += hashes[j:] * power[j]
    gram = mix64(gram)
    # the leftmost least of each window of span grams, by doubling
    span = min_words - width + 1
    least, reach = np.arange(n), 1
    while reach < span:
        step = min(reach, span - reach)
        later = least[np.minimum(np.arange(n) + step, n - 1)]
        least = np.where(gram[later] < gram[least], later, least)
        reach += step
    row = np.repeat(np.arange(len(size)), count)
    start = spread(offsets[:-1], count)
    at = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], gram[at[first]], start[first] - offsets[row[first]], np.diff(np.append(first, len(start)))


def _word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, offsets of the texts in them)."""
    starts, _, hashes = words(data, offsets)
    return hashes >> np.uint64(32), np.searchsorted(starts, offsets)


def _run_hashes(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    power, inverse = _tables(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((hashes + np.uint64(1)) * power[: len(hashes)], dtype=np.uint64)])
    return mix64((sums[first + size] - sums[first]) * inverse[first] + size.astype(np.uint64))


def _piece_batches(min_words: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets, _SLICE):
                hashes, at = _word_runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row, anchor, first, count = anchors(hashes, at, min_words, width)
                piece = _run_hashes(hashes, at[row] + first, count + min_words - 1)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64)), batch.column(0).take(pa.array(a + row)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int16))], ["anchor", "piece", "doc_id", "first", "n"])

    return run


def ranks(symbols: np.ndarray, ends: np.ndarray, most: int) -> list[np.ndarray]:
    """Per level j, numbers for the runs of 2^j symbols from each place on, equal for equal runs and in the order of the runs.

    ``ends``: where the piece that a place lies in ends; beyond it nothing equals anything longer.
    """
    n = len(symbols)
    levels = [np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1]
    reach = 1
    while reach < most:
        now = levels[-1]
        there = np.arange(n) + reach
        second = np.where(there < ends, now[np.minimum(there, n - 1)], 0)
        levels.append(np.unique(now * (n + 2) + second, return_inverse=True)[1].astype(np.int64) + 1)
        reach *= 2
    return levels


def match_lengths(symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each place the length of the longest match with text of another owner, up to the end of its piece.

    In the order of suffixes, the longest match stands next to the run of suffixes of the same owner.
    """
    n = len(symbols)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    ends = (begins + sizes)[piece]
    levels = ranks(symbols, ends, int(sizes.max()))
    order = np.argsort(levels[-1], kind="stable")
    mine = owner[piece][order]
    x, y = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for j in range(len(levels) - 1, -1, -1):
        p, q = x + common, y + common
        inside = (p + (1 << j) <= ends[x]) & (q + (1 << j) <= ends[y])
        level = levels[j]
        common += np.where(inside & (level[np.minimum(p, n - 1)] == level[np.minimum(q, n - 1)]), 1 << j, 0)
    wide = int(sizes.max()) + 1

    def nearest(own: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        """lcp[i]: with the suffix before i. The least since the run of one owner began is the match with the owner before."""
        begin = np.r_[True, own[1:] != own[:-1]]
        run = np.cumsum(begin)
        return np.minimum.accumulate(lcp - run * wide) + run * wide

    best = np.maximum(nearest(mine, np.r_[0, common]), nearest(mine[::-1], np.r_[0, common[::-1]])[::-1])
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def factor(match: np.ndarray, begins: np.ndarray, sizes: np.ndarray, min_words: int) -> np.ndarray:
    """Which places begin a stretch of ``min_words`` words that is duplicate, by greedy factors and the borders between them.

    A place without a match is a factor of one word.
    """
    found = np.zeros(len(match), bool)
    at, ends = begins.copy(), begins + sizes
    before = at.copy()
    while len(at):
        size = np.maximum(1, match[at])
        long = size >= min_words
        found[spread(at[long], size[long] - min_words + 1)] = True
        after = at + size
        # the border at ``at``: stretches that begin in the factor before and end in or beyond this one
        check = after - before >= min_words
        if check.any():
            low = np.maximum(before, at - min_words + 1)[check]
            places = spread(low, at[check] - low)
            found[places[match[places] >= min_words]] = True
        live = after < ends
        before, at, ends = at[live], after[live], ends[live]
    return found


def _factored(key: tuple, t: pa.Table, min_words: int, part_words: int) -> pa.Table:
    """Matches in a bucket of reference blocks, as steps (anchor, piece, a, b): at place a of the piece the longest match with other documents reaches to b."""
    anchor, piece = t.column("anchor").to_numpy(), t.column("piece").to_numpy()
    owner = t.column("owner").to_numpy(zero_copy_only=False)
    several = t.column("several").to_numpy(zero_copy_only=False)
    column = t.column("words").cast(pa.large_binary()).combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    order = np.argsort(anchor, kind="stable")
    sizes = np.diff(at)[order]
    symbols = np.frombuffer(column.buffers()[2], np.uint32)[spread(at[:-1][order], sizes)]
    anchor, piece, owner, several = anchor[order], piece[order], owner[order], several[order]
    # pieces of several documents match whatever equals them, so each is an owner by itself
    owner = np.unique(owner, return_inverse=True)[1]
    owner[several] = len(owner) + np.arange(int(several.sum()))
    begins = np.cumsum(sizes) - sizes
    match = np.zeros(len(symbols), np.int64)
    # parts: runs of pieces; the anchors keep equal stretches together, so parts only meet where they share an anchor
    edges = [0]
    while edges[-1] < len(sizes):
        edges.append(max(edges[-1] + 1, int(np.searchsorted(begins + sizes, begins[edges[-1]] + part_words, side="right"))))
    for i in range(len(edges) - 1):
        a, b = edges[i], edges[i + 1]
        for j in range(i, len(edges) - 1):
            c, d = edges[j], edges[j + 1]
            if i != j and anchor[b - 1] != anchor[c]:
                break
            rows = np.arange(a, b) if i == j else np.r_[np.arange(a, b)[anchor[a:b] == anchor[c]], np.arange(c, d)[anchor[c:d] == anchor[b - 1]]]
            part = np.cumsum(sizes[rows]) - sizes[rows]
            places = spread(begins[rows], sizes[rows])
            match[places] = np.maximum(match[places], match_lengths(symbols[places], part, sizes[rows], owner[rows]))
    # a place matters where its match reaches min_words, and begins a step where it reaches further than the place before
    own = np.repeat(np.arange(len(sizes)), sizes)
    long = (match >= min_words) & ~several[own]
    reach = np.arange(len(match)) + match
    first = np.flatnonzero(long & ~(np.r_[False, long[:-1]] & (reach == np.r_[-1, reach[:-1]])))
    own = own[first]
    return pa.table({"anchor": anchor[own], "piece": piece[own], "a": (first - begins[own]).astype(np.int32), "b": (reach[first] - begins[own]).astype(np.int32)})


def _parsed(min_words: int):
    """Documents with their steps (lo, hi: a match at lo reaches to hi) factored greedily, as the runs of duplicate words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = batch.column(1)
            at = steps.offsets.to_numpy()
            at = at - at[0]
            lo, hi = (steps.flatten().field(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
            size = np.maximum.reduceat(hi, at[:-1])
            for a, b in slices(np.concatenate([[0], np.cumsum(size)]), 1 << 20):
                begins = np.cumsum(size[a:b]) - size[a:b]
                part = slice(at[a], at[b])
                base = np.repeat(begins, np.diff(at[a : b + 1]))
                reach = np.zeros(int(size[a:b].sum()), np.int64)
                np.maximum.at(reach, base + lo[part], base + hi[part])
                # a match at a place goes on at the next; none reaches beyond its document
                match = np.maximum(np.maximum.accumulate(reach) - np.arange(len(reach)), 0)
                found = np.flatnonzero(factor(match, begins, size[a:b], min_words))
                owner = np.searchsorted(begins, found, side="right") - 1
                new = np.ones(len(found), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (found[1:] > found[:-1] + min_words)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(found)) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + owner[first])), pa.array(found[first] - begins[owner[first]]), pa.array(found[last] - found[first] + min_words)], ["doc_id", "first_word", "n_words"])

    return run


def _content_batches(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            wanted = batch.column(2)
            for a, b in slices(offsets, _SLICE):
                hashes, at = _word_runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                some = wanted.slice(a, b - a)
                row = np.repeat(np.arange(b - a), np.diff(some.offsets.to_numpy()))
                items = some.flatten()
                first, size = items.field("first").to_numpy(), items.field("n").to_numpy().astype(np.int64) + min_words - 1
                # rows that share an id may have other texts
                fits = at[row] + first + size <= at[row + 1]
                fits[fits] = _run_hashes(hashes, (at[row] + first)[fits], size[fits]).view(np.int64) == items.field("piece").to_numpy()[fits]
                items, row, first, size = items.filter(pa.array(fits)), row[fits], first[fits], size[fits]
                flat = hashes.astype(np.uint32)[spread(at[row] + first, size)]
                ends = np.concatenate([[0], np.cumsum(size * 4)])
                for lo in range(0, len(row), 50_000):
                    hi = min(lo + 50_000, len(row))
                    held = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((ends[lo : hi + 1] - ends[lo]).astype(np.int32)), pa.py_buffer(flat[ends[lo] // 4 : ends[hi] // 4])])
                    yield pa.RecordBatch.from_arrays([items.field("anchor").slice(lo, hi - lo), items.field("piece").slice(lo, hi - lo), batch.column(0).take(pa.array(a + row[lo:hi])), items.field("several").slice(lo, hi - lo), held], ["anchor", "piece", "owner", "several", "words"])

    return run


def duplicate_spans(docs: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR, part_words: int = PART_WORDS) -> DataFrame:
    """(doc_id, first_word, n_words): the longest runs of words of which every one lies in a stretch of ``min_words`` words that another document holds too.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names. All documents with a passage are named, the first too.
    Words count from 0. A passage repeated in one document alone is none. Null texts, null ids and texts of fewer words give no rows;
    rows that share a doc_id count as one document, and rows with the same id and different texts give the runs of each (joined where they
    touch). Very long texts are parsed whole; an empty table gives no rows.
    Ties can't arise: the result depends on the words alone.
    """
    if not 0 < anchor_words <= min_words:
        raise ValueError("anchor_words must be from 1 to min_words")
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    pieces = cut(texts.mapInArrow(_piece_batches(min_words, anchor_words), "anchor long, piece long, doc_id long, first int, n short"), "pieces")
    kinds = pieces.groupBy("anchor", "piece").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(F.struct("doc_id", "first")).alias("one"), F.first("n").alias("n"))
    shared = kinds.groupBy("anchor").agg(F.min("low").alias("x"), F.max("high").alias("y"), F.count("*").alias("kinds")).filter("x <> y").select("anchor", "kinds")
    kinds = cut(kinds.join(shared, "anchor"), "piece-kinds")
    whole = kinds.filter("low <> high").select("anchor", "piece", F.lit(0).alias("a"), (F.col("n") + F.lit(min_words - 1)).cast("int").alias("b"))
    # an anchor all of whose kinds of pieces have several documents needs no factors
    several = F.col("low") != F.col("high")
    open_anchors = kinds.filter("kinds > 1").groupBy("anchor").agg(F.bool_and(several).alias("done")).filter("NOT done").select("anchor")
    todo = cut(kinds.join(open_anchors, "anchor", "left_semi").select(F.col("one.doc_id").alias("doc_id"), "anchor", "piece", F.col("one.first").alias("first"), "n", several.alias("several")), "open-pieces")
    wanted = todo.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "piece", "first", "n", "several")).alias("wanted"))
    contents = texts.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_content_batches(min_words), "anchor long, piece long, owner long, several boolean, words binary")
    buckets = max(1, -(-(todo.agg(F.sum("n"), F.count("*")).first()[0] or 0) * 3 // part_words))
    found = contents.groupBy(F.pmod("anchor", F.lit(buckets)).alias("bucket")).applyInArrow(lambda key, t: _factored(key, t, min_words, part_words), "anchor long, piece long, a int, b int")
    steps = pieces.join(whole.unionByName(found), ["anchor", "piece"]).select("doc_id", (F.col("first") + F.col("a")).alias("lo"), (F.col("first") + F.col("b")).alias("hi"))
    held = steps.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("steps"))
    return held.mapInArrow(_parsed(min_words), "doc_id long, first_word long, n_words long")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The duplicate passages of ``documents``; see ``duplicate_spans`` for nulls, empty and long texts, ties and repeated rows."""
    return duplicate_spans(table(spark, sf_dir, "documents"))


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"
OP6_SQL = f"""
WITH texts AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), stretches AS (
  SELECT doc_id, unnest(range(0, len(w) - {MIN_WORDS - 1})) AS lo,
    unnest(list_transform(range(1, len(w) - {MIN_WORDS - 2}), lambda i: array_to_string(w[i:i + {MIN_WORDS - 1}], ' '))) AS s
  FROM texts WHERE len(w) >= {MIN_WORDS}
), shared AS (
  SELECT s FROM stretches GROUP BY s HAVING min(doc_id) <> max(doc_id)
), hits AS (
  SELECT doc_id, lo, lo - coalesce(lag(lo) OVER (PARTITION BY doc_id ORDER BY lo), lo - {MIN_WORDS + 1}) > {MIN_WORDS} AS new
  FROM stretches JOIN shared USING (s)
), runs AS (
  SELECT doc_id, lo, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY lo) AS run FROM hits
)
SELECT doc_id, min(lo)::BIGINT AS first_word, (max(lo) - min(lo) + {MIN_WORDS})::BIGINT AS n_words FROM runs GROUP BY doc_id, run
"""
