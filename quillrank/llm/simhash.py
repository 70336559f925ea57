"""SimHash near-duplicate detection by a binary trie self-join.

Signature: 128 bits, each the majority over the hashes of the document's distinct normalised words
(maximal runs of letters, digits and non-ASCII characters, in lower case). Near copies that replace a few
per cent of the words differ in some 10 of 128 bits, unrelated documents in about 60.

Two documents are near-duplicates when their signatures differ in at most ``max_bits`` bits and the smaller has
at least ``min_ratio`` as many distinct words as the larger. All such pairs are found, not a sample of them: the
signature is read as a number of bands of equal width, and if at most ``max_bits`` < bands * (budget + 1) bits differ, some
band differs in at most ``budget`` bits. Per band a binary trie over the band's bits is joined with itself:
pairs of nodes at the same depth are carried down together with the number of differing bits so far, and a pair
is dropped as soon as that number exceeds the error budget. Surviving leaf pairs are confirmed on all 128 bits. Few wide bands leave
fewer candidates and many narrow ones fewer nodes: ``bands_for`` takes the number with the least work for the number of signatures, from 8
bands of 16 bits for a hundred thousand to 4 of 32 beyond a hundred million. It changes the work and never the result.

Distribution: copies, which have equal signatures, meet once and go on as one row. Signatures are keyed by (size bucket, band). A bucket spans
a factor 1 / min_ratio of sizes, so a pair lies in one bucket or in neighbours; each signature is its bucket's own and the next one's guest.
Where buckets hold more than ``split_rows``, a band is read as budget + r pieces, of which a pair within the budget has r equal
at least, and the signatures that share r pieces are a group, so only the subtries that can hold such pairs travel together: a row is copied to at most 50 groups
for r = 1. A group that is too large still, as its signatures are alike, is cut into chunks, and its pairs of chunks are tasks. A link that several
groups find is counted in the first of them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import mix64, slices, spread, text_buffers, words
from ._shared import cut, table
from .components import components

MAX_BITS = 22
MIN_RATIO = 0.85
#: Numbers of bands to choose from.
BANDS = (8, 6, 5, 4)
SPLIT_ROWS = 1_000_000
_SLICE = 4 << 20
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def signatures_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((rows, 2) uint64 signatures, number of distinct words) of texts; a row without words has 0 of them."""
    n = len(offsets) - 1
    starts, _, hashes = words(data, offsets)
    key = np.unique((np.searchsorted(offsets, starts, side="right") - 1).astype(np.uint64) << np.uint64(48) | hashes >> np.uint64(16))
    row = (key >> np.uint64(48)).astype(np.int64)
    size = np.bincount(row, minlength=n)
    feature = key & np.uint64((1 << 48) - 1)
    first = np.searchsorted(row, np.arange(n))
    # byte counters hold up to 255 votes: long rows are summed in runs of 255 words
    runs = -(-size // 255)
    run_row = np.repeat(np.arange(n), runs)
    run_at = first[run_row] + 255 * (np.arange(len(run_row)) - np.repeat(np.cumsum(runs) - runs, runs))
    out = np.zeros((n, 2), np.uint64)
    for half in range(2):
        votes = np.zeros((n, 64), np.int64)
        if len(run_row):
            octets = mix64(feature + np.uint64(0x51ED270B * (half + 1))).view(np.uint8).reshape(-1, 8)
            sums = np.empty((len(run_row), 8), np.uint64)
            for j in range(8):
                sums[:, j] = np.add.reduceat(_SPREAD[octets[:, j]], run_at)
            begins = np.flatnonzero(np.r_[True, run_row[1:] != run_row[:-1]])
            votes[run_row[begins]] = np.add.reduceat(sums.view(np.uint8).reshape(len(run_row), 64).astype(np.int32), begins, axis=0)
        out[:, half] = np.packbits(votes * 2 > size[:, None], axis=1).view(np.uint64).ravel()
    return out, size


def _signature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for a, b in slices(offsets, _SLICE):
            for a in range(a, b, 65536):
                z = min(b, a + 65536)
                sig, size = signatures_of(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
                some = size > 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a).filter(pa.array(some)), pa.array(sig[some, 0].view(np.int64)), pa.array(sig[some, 1].view(np.int64)), pa.array(size[some].astype(np.int32))], ["doc_id", "h1", "h2", "n_words"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n_words) of every document that has an id and at least one word."""
    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(_signature_batches, "doc_id long, h1 long, h2 long, n_words int")


def edges_of(bands: int) -> list[tuple[int, int]]:
    """The first bit of each band, and the one after its last."""
    at = [round(128 * i / bands) for i in range(bands + 1)]
    return list(zip(at, at[1:]))


def bands_for(n: int, max_bits: int) -> int:
    """The number of bands with which ``n`` signatures make the least work: visited pairs of nodes, and candidates to be confirmed."""

    def work(bands: int) -> float:
        width, budget = 128 // bands, max_bits // bands
        near = [sum(math.comb(d, i) for i in range(budget + 1)) for d in range(width + 1)]
        nodes = sum(min(2.0**d, n) * min(near[d], near[d] / 2.0**d * n) for d in range(width + 1))
        return bands * (nodes + n * n * near[width] / 2.0**width)

    return min(BANDS, key=work)


def trie_pairs(values: np.ndarray, budget: int, depth: int = 16, piece: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i <= j, of all pairs in the sorted, distinct ``depth``-bit ``values`` that differ in at most ``budget`` bits, by the trie self-join.

    A node at depth d is a d-bit prefix; it exists if some value begins with it, and is known by its place among those of its depth.
    """
    if not len(values):
        return
    left, right = [], []  # for the nodes of each depth the place of the child, -1 for none
    below = values
    for _ in range(depth):
        above = below >> 1
        above = above[np.r_[True, above[1:] != above[:-1]]]
        at = np.searchsorted(below, 2 * above)
        has = below[at] == 2 * above
        other = at + has
        also = (other < len(below)) & (below[np.minimum(other, len(below) - 1)] == 2 * above + 1)
        left.append(np.where(has, at, -1).astype(np.int32))
        right.append(np.where(also, other, -1).astype(np.int32))
        below = above
    left.reverse(), right.reverse()
    todo = [(0, np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int8))]
    while todo:
        d, p, q, err = todo.pop()
        if len(p) > piece:
            half = len(p) // 2
            todo += [(d, p[:half], q[:half], err[:half]), (d, p[half:], q[half:], err[half:])]
            continue
        if d == depth:
            yield p, q
            continue
        pl, pr, ql, qr = left[d][p], right[d][p], left[d][q], right[d][q]
        more = err < budget
        parts = []
        for take, a, b, add in (((pl >= 0) & (ql >= 0), pl, ql, 0), ((pr >= 0) & (qr >= 0), pr, qr, 0), ((pl >= 0) & (qr >= 0) & more, pl, qr, 1), ((pr >= 0) & (ql >= 0) & more & (p != q), pr, ql, 1)):
            i = np.flatnonzero(take)
            if len(i):
                parts.append((a[i], b[i], err[i] + np.int8(add)))
        if parts:
            todo.append((d + 1, *(np.concatenate(x) for x in zip(*parts))))


def bits_of(sig: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Bits lo to hi (up to 63 of them) of (rows, 2) signatures as numbers; bit 0 is the first of the first word."""
    one = np.uint64(1)
    mask = (one << np.uint64(hi - lo)) - one
    if hi <= 64:
        out = sig[:, 0] >> np.uint64(64 - hi)
    elif lo >= 64:
        out = sig[:, 1] >> np.uint64(128 - hi)
    else:
        out = sig[:, 0] << np.uint64(hi - 64) | sig[:, 1] >> np.uint64(128 - hi)
    return (out & mask).astype(np.int64)


def bits_column(lo: int, hi: int) -> Column:
    """``bits_of`` over the columns h1 and h2."""
    if hi <= 64:
        out = F.shiftrightunsigned("h1", 64 - hi)
    elif lo >= 64:
        out = F.shiftrightunsigned("h2", 128 - hi)
    else:
        out = F.shiftleft("h1", hi - 64).bitwiseOR(F.shiftrightunsigned("h2", 128 - hi))
    return out.bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))


def pieces_of(lo: int, hi: int, budget: int, equal: int) -> list[list[tuple[int, int]]]:
    """Choices of ``equal`` out of budget + equal pieces of the bits lo to hi: two numbers within the budget agree on all pieces of some choice."""
    if not equal:
        return [[]]
    m = budget + equal
    at = [lo + round((hi - lo) * i / m) for i in range(m + 1)]
    return [list(x) for x in itertools.combinations(list(zip(at, at[1:])), equal)]


def _find(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        label = _find(label)
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))


def join_group(sig: np.ndarray, size: np.ndarray, guest: np.ndarray, side: np.ndarray, band: int, choice: int, bands: int, equal: int, max_bits: int, min_ratio: float, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(row's label: the least row that it is linked with by near-duplicate pairs of this group, its number of links that no group before finds).

    ``side``: all 0, or of two chunks, of which only pairs across count.
    """
    budget, edges = max_bits // bands, edges_of(bands)
    lo, hi = edges[band]
    choices = pieces_of(lo, hi, budget, equal)
    value = bits_of(sig, lo, hi)
    order = np.argsort(value, kind="stable")
    unique, counts = np.unique(value[order], return_counts=True)
    begin = np.concatenate([[0], np.cumsum(counts)])
    sig, size, guest, side = sig[order], size[order], guest[order], side[order]
    label, links = np.arange(len(order)), np.zeros(len(order), np.int64)
    across = bool(side.any())
    for p, q in trie_pairs(unique, budget, hi - lo):
        # row i of p's rows is compared with all of q's rows: a list of (i, first, count)
        reps = counts[p]
        i = spread(begin[p], reps)
        own = np.repeat(p == q, reps)
        first = np.where(own, i + 1, np.repeat(begin[q], reps))
        count = np.repeat(begin[q] + counts[q], reps) - first
        ends = np.cumsum(count)
        a = 0
        while a < len(i):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + piece, side="right")))
            for low in range(0, int(count[a]) if b == a + 1 else 1, piece):
                n = count[a:b] if b > a + 1 else np.minimum(count[a:b] - low, piece)
                left = np.repeat(i[a:b], n)
                right = spread(first[a:b] + low, n)
                bits = np.bitwise_count(sig[left, 0] ^ sig[right, 0]) + np.bitwise_count(sig[left, 1] ^ sig[right, 1])
                near = bits <= max_bits
                if across:
                    near &= side[left] != side[right]
                left, right = left[near], right[near]
                fit = (np.minimum(size[left], size[right]) >= min_ratio * np.maximum(size[left], size[right])) & ~(guest[left] & guest[right])
                left, right = left[fit], right[fit]
                if len(left):
                    label = _unite(label, left, right)
                    apart = sig[left] ^ sig[right]
                    new = np.ones(len(left), bool)
                    for x, y in edges[:band]:
                        new &= np.bitwise_count(bits_of(apart, x, y)) > budget
                    for before in choices[:choice]:
                        new &= np.any([bits_of(apart, x, y) != 0 for x, y in before], axis=0)
                    links += np.bincount(np.concatenate([left[new], right[new]]), minlength=len(links))
            a = b
    out, own_links = np.arange(len(order)), np.zeros(len(order), np.int64)
    # the least original row of each component
    label = _find(label)
    least = np.full(len(order), len(order))
    np.minimum.at(least, label, order)
    out[order] = least[label]
    own_links[order] = links
    return out, own_links


def near_links(sigs: DataFrame, max_bits: int = MAX_BITS, min_ratio: float = MIN_RATIO, split_rows: int = SPLIT_ROWS, bands: int | None = None) -> DataFrame:
    """(u, v, links) for distinct signatures (doc_id, h1, h2, n_words): edges u to v <= u that connect every pair of near-duplicates, a spanning forest
    per group, and numbers of links that add up by u to those of each signature."""
    if not 0 <= max_bits < 64:
        raise ValueError("max_bits must be from 0 to 63")
    width = -math.log(min_ratio) if min_ratio < 1 else 1e-9
    rows = sigs.withColumn("bucket", F.floor(F.log(F.col("n_words")) / width).cast("long"))
    most = 2 * (rows.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0)
    bands = bands or bands_for(most, max_bits)
    budget = max_bits // bands
    equal = next((r for r in range(3) if most / 2 ** (128 / bands * r / (budget + r) if r else 0) <= split_rows), 2)
    keys = []
    for band, (lo, hi) in enumerate(edges_of(bands)):
        for choice, parts in enumerate(pieces_of(lo, hi, budget, equal)):
            value = F.lit(0).cast("long")
            for x, y in parts:
                value = F.shiftleft(value, y - x).bitwiseOR(bits_column(x, y))
            keys.append(F.struct(F.lit(band).alias("band"), F.lit(choice).alias("choice"), value.alias("value")))
    rows = rows.withColumn("g", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("bucket", F.col("bucket") + F.col("g").cast("long"))
    rows = rows.withColumn("key", F.explode(F.array(*keys))).select("bucket", "key.band", "key.choice", "key.value", "doc_id", "h1", "h2", "n_words", "g")
    group = ["bucket", "band", "choice", "value"]
    # groups too large for a task: their rows by chunk, once for every pair of chunks
    large = cut(rows.groupBy(*group).count().filter(F.col("count") > split_rows).withColumn("chunks", F.ceil(F.col("count") * 2 / split_rows).cast("int")).drop("count"), "simhash-large")
    if large.isEmpty():
        rows = rows.withColumn("a", F.lit(0)).withColumn("b", F.lit(0)).withColumn("chunk", F.lit(0))
    else:
        rows = rows.join(large, group, "left").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.coalesce("chunks", F.lit(1))).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
        rows = rows.withColumn("a", F.least("chunk", "other")).withColumn("b", F.greatest("chunk", "other")).drop("chunks", "other")
    group += ["a", "b"]

    def joined(key: tuple, t: pa.Table) -> pa.Table:
        _, band, choice, _, a, b = (x.as_py() for x in key)
        ids = t.column("doc_id").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        sig = np.stack([t.column(c).to_numpy()[order].view(np.uint64) for c in ("h1", "h2")], axis=1)
        side = (t.column("chunk").to_numpy()[order] != a).astype(np.int8)
        label, links = join_group(sig, t.column("n_words").to_numpy()[order], t.column("g").to_numpy()[order], side, band, choice, bands, equal, max_bits, min_ratio)
        linked = np.flatnonzero((label != np.arange(len(ids))) | (links > 0))
        return pa.table({"u": ids[linked], "v": ids[label[linked]], "links": links[linked]})

    return rows.select(*group, "chunk", "doc_id", "h1", "h2", "n_words", "g").groupBy(*group).applyInArrow(joined, "u long, v long, links long")


def classes(docs: DataFrame, max_bits: int = MAX_BITS, min_ratio: float = MIN_RATIO, split_rows: int = SPLIT_ROWS, bands: int | None = None) -> DataFrame:
    """(doc_id, class_id, n_links): a row for every document that has a near-duplicate or a copy; documents without a row are alone.

    A class is a connected component of near-duplicate pairs, named by its least doc_id. ``n_links`` counts the other signatures within
    the distance; copies (equal signatures and sizes) aren't expanded into pairs and have the links that one of them has.
    ``docs`` needs doc_id and text; other columns are ignored, whatever their names. Null or word-less texts and rows with a null
    doc_id belong to no class. Rows that share a doc_id are one document, which links what its texts are near to and has the most links of any of them. Very
    long texts count whole. An empty table gives no rows.
    """
    same = ["h1", "h2", "n_words"]
    sigs = cut(signatures(docs), "simhash")
    distinct = cut(sigs.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhash-distinct")
    found = cut(near_links(distinct.select(F.col("rep").alias("doc_id"), *same), max_bits, min_ratio, split_rows, bands), "simhash-links")
    # ids with several texts tie these together
    kind = F.struct(*same)
    several = sigs.groupBy("doc_id").agg(F.min(kind).alias("low"), F.max(kind).alias("high")).filter("low <> high").select("doc_id")
    several = cut(sigs.join(several, "doc_id").join(distinct, same).select("doc_id", "rep").distinct(), "simhash-several")
    tied = several.join(several.groupBy("doc_id").agg(F.min("rep").alias("least")), "doc_id").select(F.col("rep").alias("u"), F.col("least").alias("v"))
    # a rep of two signatures stands for both
    roots = components(found.select("u", "v").union(tied).union(several.select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))))
    links = found.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("n_links"))
    known = distinct.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    known = known.filter("n > 1 OR root IS NOT NULL OR n_links > 0").select(*same, F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = sigs.join(known, same).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    # a document repeated under its own id only is no class
    return rows.filter("doc_id <> class_id OR n_links > 0").unionByName(rows.filter("doc_id = class_id AND n_links = 0").join(rows.filter("doc_id <> class_id").select("class_id").distinct(), "class_id", "left_semi")).select("doc_id", "class_id", "n_links")


def near_duplicates(docs: DataFrame, **how: object) -> DataFrame:
    """(doc_id, duplicate_of): every document to be dropped and the one that stays for its class; see ``classes``."""
    return classes(docs, **how).filter("doc_id <> class_id").select("doc_id", F.col("class_id").alias("duplicate_of"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents``; see ``classes`` for nulls, empty and long texts, ties and repeated rows."""
    return classes(table(spark, sf_dir, "documents"))
