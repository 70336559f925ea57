"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built of labelled text. A document is parsed greedily against each automaton:
from where the last phrase ended, the longest match with any substring of the labelled text is the next phrase.
The fewer phrases, the more alike; ``phrases * log2(length of the labelled text) / length of the document`` estimates the
cross entropy in bits a byte (Ziv and Merhav), and the language with the least wins. A text is accepted when its complete phrases, all but
the last, which ends where the text does, cost at most ``MAX_BITS`` a byte, whatever its length.

The automata are turned into tables of bytes: for each state and byte the next state and the number of phrases that
end there. All documents of a record batch go through the tables side by side, a byte per step, in numpy. Long texts are parsed in
blocks at the same time, each as if a phrase began with it. Then the parse that arrives from the block before is carried on
beside that one until both are in the same state, from where on they are the same: the counts are those of one parse of the whole text.

Labelled text is a sample bounded by ``SAMPLE_BYTES`` for each language: the documents that come first by hash. The tables
of all languages go to the workers in one broadcast variable, bounded by that parameter and not by the corpus. At most ``MAX_LANGUAGES``
values of ``lang`` are taken for languages, those with most text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import LOWER_BYTE, slices, text_buffers
from ._shared import fresh, table

SAMPLE_BYTES = 24_000
#: Dirty labels beyond so many (each by a typing error, say) name no language.
MAX_LANGUAGES = 200
#: Above so many bits a byte no language explains a text: prose of a known language needs under 3, text that mixes languages or holds
#: keys and numbers up to 6, and bytes that no labelled text has 14.
MAX_BITS = 6.0
#: Texts are parsed in blocks of so many bytes side by side; the counts don't depend on it.
BLOCK = 4096
_SLICE = 8 << 20
#: Addresses, which are numbers of cells times 4, of larger tables don't fit in 32 bits.
_SMALL_CELLS = 1 << 29
_SPACE = 32


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with every run of other ASCII characters as one space, none at a text's start."""
    kind = LOWER_BYTE.copy()
    letter = np.zeros(256, bool)
    letter[97:123] = letter[128:] = True
    kind[~letter[kind]] = _SPACE
    if len(data) == 0:
        return data, offsets
    out = kind[data]
    space = out == _SPACE
    before = np.empty(len(out), bool)
    before[0] = True
    before[1:] = space[:-1]
    before[offsets[:-1][np.diff(offsets) > 0]] = True
    keep = ~(space & before)
    at = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], at[offsets]


class Automaton:
    """Suffix automaton of a byte string: state 0 is the empty match, and walking from it spells every substring."""

    def __init__(self, text: bytes) -> None:
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        self.next = nxt


@dataclass
class Model:
    """languages in order; symbol: byte to column; table: (next state's first cell) * 4 + phrases that end, for all languages."""

    languages: list[str]
    symbol: np.ndarray
    cells: np.ndarray
    roots: np.ndarray
    log_size: np.ndarray


def train(texts: dict[str, bytes]) -> Model:
    """A model of normalised labelled text per language; languages without text are left out."""
    languages = sorted(k for k, v in texts.items() if v)
    seen = sorted(set().union(*[set(texts[k]) for k in languages])) if languages else []
    width = len(seen) + 1  # column 0: a byte that no labelled text has
    symbol = np.zeros(256, np.uint8)
    symbol[seen] = np.arange(1, width)
    tables, roots, base = [], [], 0
    for k in languages:
        auto = Automaton(texts[k]).next
        states = np.zeros((len(auto), width), np.int64)
        target = np.full((len(auto), width), -1, np.int64)
        for s, edges in enumerate(auto):
            for c, t in edges.items():
                target[s, symbol[c]] = t
        restart = np.where(target[0] >= 0, target[0], 0)
        missing = target < 0
        # a failed step ends the phrase so far; a byte that can't begin one is a phrase by itself
        ended = missing * ((np.arange(len(auto)) > 0)[:, None] + 0 + (target[0] < 0)[None, :])
        states = (base + np.where(missing, restart[None, :], target) * width) * 4 + ended
        tables.append(states.ravel())
        roots.append(base)
        base += states.size
    kind = np.int32 if base <= _SMALL_CELLS else np.int64
    cells = np.concatenate(tables).astype(kind, copy=False) if tables else np.zeros(0, kind)
    return Model(languages, symbol, cells, np.array(roots, kind), np.array([math.log2(max(2, len(texts[k]))) for k in languages]))


def phrases(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, languages) numbers of phrases of normalised texts."""
    n, k = len(offsets) - 1, len(model.languages)
    counts = np.zeros((n, k), np.int64)
    size = np.diff(offsets)
    if not k or not len(data):
        return counts
    blocks = -(-size // BLOCK)
    row = np.repeat(np.arange(n), blocks)
    number = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = offsets[row] + BLOCK * number
    length = np.minimum(offsets[row + 1] - at, BLOCK)
    symbols = model.symbol[data]
    total, end = _parse(model, symbols, at, length)
    inner = np.flatnonzero(number > 0)
    if len(inner):
        _join(model, symbols, at, length, inner, total, end)
    last = np.append(row[1:] != row[:-1], True)
    total[:, last] += end[:, last] != model.roots[:, None]  # the phrase that ends with the text
    np.add.at(counts, row, total.T)
    return counts


def _parse(model: Model, symbols: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(languages, lanes) numbers of phrases that end in stretches of bytes, each parsed from the root, and states at their ends."""
    order = np.argsort(-length, kind="stable")
    here, sizes = at[order], length[order]
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) + 1), side="left")  # lanes longer than t
    k, lanes = len(model.roots), len(at)
    all_total, all_state = np.zeros((k, lanes), np.int64), np.empty((k, lanes), model.cells.dtype)
    state = np.repeat(model.roots[:, None], lanes, axis=1)
    total = np.zeros((k, lanes), np.int32)
    cells, live = model.cells, lanes
    for t in range(int(sizes[0])):
        live = int(active[t])
        if live < state.shape[1] // 2:
            done = order[live : state.shape[1]]
            all_total[:, done], all_state[:, done] = total[:, live:], state[:, live:]
            total, state = np.ascontiguousarray(total[:, :live]), np.ascontiguousarray(state[:, :live])
        step = cells[state[:, :live] + symbols[here[:live]]]
        total[:, :live] += step & 3
        np.right_shift(step, 2, out=state[:, :live])
        here[:live] += 1
    done = order[: state.shape[1]]
    all_total[:, done], all_state[:, done] = total, state
    return all_total, all_state


def _join(model: Model, symbols: np.ndarray, at: np.ndarray, length: np.ndarray, inner: np.ndarray, total: np.ndarray, end: np.ndarray) -> None:
    """Corrects numbers of phrases and states at the ends of blocks (lanes ``inner``) by what arrives from the block before each."""
    k = len(model.roots)
    lang, lane = (x.ravel() for x in np.meshgrid(np.arange(k), inner, indexing="ij"))
    own, own_end = total.copy(), end.copy()  # as parsed from the root
    goes_on = np.zeros(total.shape[1] + 1, bool)
    goes_on[inner] = True
    while len(lane):
        real, guess = end[lang, lane - 1].copy(), model.roots[lang].copy()
        more = np.zeros(len(lane), np.int64)
        here, stop = at[lane].copy(), at[lane] + length[lane]
        live = np.flatnonzero(real != guess)
        total[lang, lane] = own[lang, lane]
        while len(live):
            byte = symbols[here[live]]
            a, b = model.cells[real[live] + byte], model.cells[guess[live] + byte]
            more[live] += (a & 3).astype(np.int64) - (b & 3)
            real[live], guess[live] = a >> 2, b >> 2
            here[live] += 1
            live = live[(real[live] != guess[live]) & (here[live] < stop[live])]
        total[lang, lane] += more
        # a block that ends in another state than it did: the next one begins otherwise
        final = np.where(real == guess, own_end[lang, lane], real)
        apart = np.flatnonzero(final != end[lang, lane])
        end[lang[apart], lane[apart]] = final[apart]
        apart = apart[goes_on[lane[apart] + 1]]
        lang, lane = lang[apart], lane[apart] + 1


def identify(model: Model, data: np.ndarray, offsets: np.ndarray, max_bits: float = MAX_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the best language or -1, bits a byte, its phrases, accepted or not) of raw texts in small letters. Ties go to the first language by name."""
    data, offsets = normalise(data, offsets)
    n = len(offsets) - 1
    size = np.diff(offsets)
    if not model.languages:
        return np.full(n, -1), np.full(n, np.nan), np.zeros(n, np.int64), np.zeros(n, bool)
    counts = phrases(model, data, offsets)
    bits = counts * model.log_size[None, :] / np.maximum(size, 1)[:, None]
    best = np.where(size > 0, np.argmin(bits, axis=1), -1)
    pick = np.maximum(best, 0)
    rows = np.arange(n)
    number = np.where(size > 0, counts[rows, pick], 0)
    return best, np.where(size > 0, bits[rows, pick], np.nan), number, (best >= 0) & ((number - 1) * model.log_size[pick] <= max_bits * size)


def labelled_text(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Up to ``sample_bytes`` of normalised text for each value of ``lang``: whole documents in the order of a hash, the last one cut."""
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.lower("text").alias("text"), F.xxhash64("doc_id").alias("h"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).orderBy(F.col("size").desc(), "lang").limit(MAX_LANGUAGES)
    numbers = [(r["lang"], r["n"], r["size"]) for r in sizes.collect()]
    if not numbers:
        return {}
    # the share of a language's documents that holds some four times the bytes wanted
    shares = {lang: max(4 * sample_bytes / max(1, size), min(1.0, 40 / n)) for lang, n, size in numbers}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    known = rows.withColumn("share", F.element_at(share, F.col("lang")))
    chosen = known.filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "h", F.substring("text", 1, sample_bytes).alias("text")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["h"] % (1 << 30), r["h"], r["text"])):
        have = out.setdefault(r["lang"], b"")
        if len(have) < sample_bytes:
            raw = np.frombuffer(r["text"].encode(), np.uint8)
            clean, _ = normalise(raw, np.array([0, len(raw)]))
            out[r["lang"]] = (have + clean.tobytes() + b" ")[:sample_bytes]
    return {k: v for k, v in out.items() if v.strip()}


def classify(docs: DataFrame, labelled: DataFrame | None = None, sample_bytes: int = SAMPLE_BYTES, max_bits: float = MAX_BITS) -> DataFrame:
    """(doc_id, lang, guess, phrases, bits, accepted) for every row of ``docs``, which needs doc_id, text and lang.

    ``labelled`` (default: ``docs``) gives the labelled text. A text that is null, empty or without letters has a null
    guess and isn't accepted, nor is one whose complete phrases in its best language need over ``max_bits`` bits a byte. With no labelled text
    at all (or an empty table) nothing is accepted. Long texts are parsed whole. Null ids pass through, repeated rows are judged alike, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled_text(docs if labelled is None else labelled, sample_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            best, bits, count, good = _judge(model, batch.column(2), max_bits)
            guess = pa.array(model.languages, pa.string()).take(pa.array(np.maximum(best, 0), mask=best < 0)) if model.languages else pa.nulls(len(batch), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), guess, pa.array(count), pa.array(bits, mask=best < 0), pa.array(good)], ["doc_id", "lang", "guess", "phrases", "bits", "accepted"])

    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.lower("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang string, guess string, phrases long, bits double, accepted boolean")


def _judge(model: Model, column: pa.Array, max_bits: float) -> tuple[np.ndarray, ...]:
    data, offsets = text_buffers(column)
    parts = [identify(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], max_bits) for a, b in slices(offsets, _SLICE)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts))


def accepted(docs: DataFrame, labelled: DataFrame | None = None, sample_bytes: int = SAMPLE_BYTES, max_bits: float = MAX_BITS, relabel: bool = False) -> DataFrame:
    """The rows of ``docs`` that ``classify`` accepts, all columns as they were; with ``relabel`` the guess stands in ``lang``.

    No join or shuffle: each row is judged where it is. Nulls, empty texts, repeated rows and empty tables as in ``classify``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled_text(docs if labelled is None else labelled, sample_bytes)))
    (small,) = fresh(docs.columns, "small_text")
    at = docs.columns.index("lang") if relabel else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            best, _, _, good = _judge(model, batch.column(batch.num_columns - 1), max_bits)
            columns = batch.columns[:-1]
            if relabel and model.languages:
                columns[at] = pa.array(model.languages, pa.string()).take(pa.array(np.maximum(best, 0), mask=best < 0))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1]).filter(pa.array(good))

    return docs.withColumn(small, F.lower("text")).mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every row of ``documents``; see ``classify`` for nulls, empty and long texts, ties and repeated rows."""
    return classify(table(spark, sf_dir, "documents"))
