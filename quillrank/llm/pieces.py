"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking.

The merge procedure of a SentencePiece BPE model has exactly one result for a text, and a sequence of pieces is that
result if and only if every two adjacent pieces are compatible: merging their characters anew gives the two again. So encoding
is a search for a path of compatible pieces. An Aho-Corasick automaton of all pieces gives the matches; the search
takes the longest match at a position, falls back to shorter ones if it isn't compatible with the piece before, and
goes back a piece if none is. A bitfield holds positions from which no path leads on, so none is tried twice.

Pieces never hold a space other than at their start (this is checked), so spaces with the characters up to the next space
form units that are encoded each by itself. All units of a record batch are found, hashed and numbered in numpy; only units
a worker hasn't met go through the search, and ids are gathered in numpy. Decoding gathers the pieces' bytes the same way.

The model's path is a parameter. The driver reads pieces and scores and broadcasts them: their size is the
vocabulary's, whatever the corpus.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

from ._bytes import mix64, run_hashes, slices, spread, text_buffers
from ._shared import fresh, table

#: Bytes encoded at once: the arrays of a slice take about 50 bytes for each of them in every worker.
_SLICE = 1 << 20
#: Units that a worker remembers; when there are more it forgets all and begins anew.
_REMEMBER = 400_000
SPACE = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, merge ranks and merge history of a model."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.unknown = sp.unk_id()
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if byte[i]}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and not byte[i]}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after another character")
        score = {i: sp.get_score(i) for i in self.ids.values()}
        words = [i for p, i in self.ids.items() if len(p) > 1 and p.strip(SPACE)]
        if len({score[i] for i in words}) < len(words):
            raise ValueError("two pieces have the same score")
        self.score = score
        # rank: place in the order of merges, -1 for single characters
        self.rank = [-1] * n
        for r, i in enumerate(sorted(words, key=lambda i: -score[i])):
            self.rank[i] = r
        self.left, self.right = [-1] * n, [-1] * n
        self.usable = {i for p, i in self.ids.items() if len(p) == 1}
        for i in words:
            last = self._history(self.pieces[i])
            if last:
                self.left[i], self.right[i] = last
                self.usable.add(i)
        self.bytes = [b"" if special[i] else bytes([int(self.pieces[i][3:5], 16)]) if byte[i] else self.pieces[i].replace(SPACE, " ").encode() for i in range(n)]

    def _history(self, piece: str) -> tuple[int, int] | None:
        """The last merge that makes ``piece`` out of its characters; None if merging ends otherwise."""
        parts = [self.ids.get(c, -1) for c in piece]
        if -1 in parts:
            return None
        last = None
        while len(parts) > 1:
            options = [(-self.score[m], k, m) for k in range(len(parts) - 1) if (m := self.ids.get(self.pieces[parts[k]] + self.pieces[parts[k + 1]])) is not None]
            if not options:
                return None
            _, k, m = min(options)
            last = parts[k], parts[k + 1]
            parts[k : k + 2] = [m]
        return last


class Encoder:
    def __init__(self, vocab: Vocabulary) -> None:
        self.v = vocab
        self.auto = ahocorasick.Automaton()
        for i in vocab.usable:
            self.auto.add_word(vocab.pieces[i], (len(vocab.pieces[i]), i))
        if len(self.auto):
            self.auto.make_automaton()
        self.fits: dict[int, bool] = {}
        self.runs: dict[int, list[int]] = {}
        self.units: dict[int, bytes] = {}
        self.piece_size = np.array([len(b) for b in vocab.bytes], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.piece_data = np.frombuffer(b"".join(vocab.bytes), np.uint8)
        # ASCII bytes that no piece holds: each stands alone
        held = {c for p in vocab.ids for c in p}
        self.lone = np.array([b < 128 and b != 32 and chr(b) not in held for b in range(256)])

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of pieces a and b gives a and b again: takes back their merges, latest first,
        and looks for a merge across the border that would have come earlier."""
        key = a << 32 | b
        known = self.fits.get(key)
        if known is not None:
            return known
        v = self.v
        rank, pieces, ids = v.rank, v.pieces, v.ids
        limit, good = 1 << 60, True
        while True:
            m = ids.get(pieces[a] + pieces[b])
            if m is not None and rank[m] < limit:
                good = False
                break
            if rank[a] > rank[b]:
                limit = rank[a]
                a = v.right[a]
            elif rank[b] >= 0:
                # of two equal merges the left one comes first, so here the one across the border would
                limit = rank[b] + 1
                b = v.left[b]
            else:
                break
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = good
        return good

    def _segment(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces, with a space at most at its start."""
        n = len(text)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (size, i) in self.auto.iter(text):
            at[end - size + 1].append((size, i))
        fits, compatible = self.fits, self.compatible
        failed = 0
        out: list[int] = []
        path: list[tuple[int, int]] = []  # (position, index of the piece among the matches there)
        pos, k, before = 0, len(at[0]) - 1, -1
        while pos < n:
            options = at[pos]
            while k >= 0:
                size, i = options[k]
                if not failed >> (pos + size) & 1:
                    if before < 0:
                        break
                    good = fits.get(before << 32 | i)
                    if compatible(before, i) if good is None else good:
                        break
                k -= 1
            if k >= 0:
                path.append((pos, k))
                out.append(i)
                pos += size
                before = i
                if pos < n:
                    k = len(at[pos]) - 1
            else:
                failed |= 1 << pos
                if not path:
                    raise ValueError(f"no encoding of {text!r}")
                pos, k = path.pop()
                k -= 1
                out.pop()
                before = out[-1] if out else -1
        return out

    def _long(self, text: str) -> list[int]:
        """``_segment`` for very long texts without spaces: the bitfield is kept short by cutting where no piece crosses."""
        out: list[int] = []
        a, reach = 0, 0
        ends = np.zeros(len(text) + 1, np.int64)
        for end, (size, _) in self.auto.iter(text):
            if ends[end - size + 1] < end + 1:
                ends[end - size + 1] = end + 1
        for i in range(len(text)):
            reach = max(reach, int(ends[i]))
            if reach == i + 1:
                out += self._segment(text[a : i + 1])
                a = i + 1
        return out + (self._segment(text[a:]) if a < len(text) else [])

    def _run(self, k: int) -> list[int]:
        """Ids of k spaces: the plain merge procedure, as pieces of spaces may share a score."""
        known = self.runs.get(k)
        if known is not None:
            return known
        ids, pieces, score = self.v.ids, self.v.pieces, self.v.score
        one = ids[SPACE]
        token, size = [one] * k, [1] * k
        nxt, prev = list(range(1, k + 1)), list(range(-1, k - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < k and (m := ids.get(SPACE * (size[i] + size[j]))) is not None:
                heap.append((-score[m], i, m, size[i] + size[j]))

        for i in range(k - 1):
            offer(i)
        heapq.heapify(heap)
        while heap:
            _, i, m, total = heapq.heappop(heap)
            j = nxt[i]
            if size[i] == 0 or j >= k or size[i] + size[j] != total:
                continue
            token[i], size[i], size[j] = m, total, 0
            nxt[i] = nxt[j]
            if nxt[i] < k:
                prev[nxt[i]] = i
            for x in (prev[i], i):
                if x >= 0 and (y := nxt[x]) < k and (m := ids.get(SPACE * (size[x] + size[y]))) is not None:
                    heapq.heappush(heap, (-score[m], x, m, size[x] + size[y]))
        self.runs[k] = [t for t, s in zip(token, size) if s]
        return self.runs[k]

    def unit(self, spaces: int, word: str) -> list[int]:
        """Ids of ``spaces`` spaces and a word without any."""
        ids = self.v.ids
        segments: list[str | int] = []
        part: list[str] = [SPACE] if spaces else []
        for c in word:
            if c in ids:
                part.append(c)
            else:
                if part:
                    segments.append("".join(part))
                part = []
                low = [self.v.byte_id.get(b, self.v.unknown) for b in c.encode()]
                segments += low if self.v.byte_id else [self.v.unknown]
        if part:
            segments.append("".join(part))
        out: list[int] = []
        for s in segments:
            if isinstance(s, int):
                out.append(s)
            else:
                out += self._segment(s) if len(s) < 512 else self._long(s)
        if spaces > 1:
            # spaces merge with each other last: a word that takes in its space leaves the others
            alone = out[0] == ids[SPACE]
            out[: int(alone)] = self._run(spaces - 1 + alone)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of one text, without the batch machinery."""
        data = np.frombuffer(text.replace(SPACE, " ").encode(), np.uint8)
        return self.encode_all(data, np.array([0, len(data)]))[0].tolist()

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the texts in them) of UTF-8 texts; a space is put before each text that isn't empty."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        space, lone = data == 32, self.lone[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first = edge[:n] | lone
        first[1:] |= lone[:-1] | (space[1:] & ~space[:-1])
        start = np.flatnonzero(first)
        end = np.append(start[1:], n)
        gone = np.concatenate([[0], np.cumsum(space)])
        blanks = gone[end] - gone[start]
        key = run_hashes(data, start + blanks, end)
        blanks = blanks + edge[start]
        key = mix64(key ^ (blanks + (start + blanks - edge[start] == end) * (1 << 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        code, unique = pd.factorize(key)
        if len(self.units) > _REMEMBER:
            self.units.clear()
        packed = [self.units.get(u) for u in unique.tolist()]
        missing = [i for i, p in enumerate(packed) if p is None]
        if missing:
            where = np.empty(len(unique), np.int64)
            where[code[::-1]] = np.arange(len(code))[::-1]
            raw = data.tobytes()
            for i in missing:
                w = where[i]
                k = int(blanks[w])
                word = raw[int(start[w]) + k - int(edge[start[w]]) : int(end[w])].decode()
                packed[i] = self.units[int(unique[i])] = np.array(self.unit(k, word), np.int32).tobytes()
        size = np.array([len(p) for p in packed], np.int64) // 4
        flat = np.frombuffer(b"".join(packed), np.int32)
        each = size[code]
        ids = flat[spread((np.cumsum(size) - size)[code], each)]
        total = np.concatenate([[0], np.cumsum(each)])
        return ids, total[np.searchsorted(start, offsets)]

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of ids, without the space put before each."""
        size = self.piece_size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        data = self.piece_data[spread(self.piece_at[ids], size)]
        at = total[offsets]
        begins = at[:-1][np.diff(at) > 0]
        begins = begins[data[begins] == 32]
        keep = np.ones(len(data), bool)
        keep[begins] = False
        return data[keep], at - np.searchsorted(begins, at, side="left")


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary, kept with what it remembers for the tasks to come."""
    found = _encoders.get(shared.key)
    if found is None:
        _encoders.clear()
        found = _encoders[shared.key] = Encoder(shared.variable.value)
    return found


class _Shared:
    def __init__(self, spark: SparkSession, model_file: str) -> None:
        self.key = hash(model_file)
        self.variable = spark.sparkContext.broadcast(Vocabulary(model_file))


def _encoded(enc: Encoder, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(ids, numbers of ids, whether decoding gives the text back) of a column of texts."""
    import pyarrow.compute as pc

    mask = column.is_null().to_numpy(zero_copy_only=False)
    data, offsets = text_buffers(column)
    if SPACE.encode() in data.data:
        data, offsets = text_buffers(pc.replace_substring(column, SPACE, " "))
    all_ids, ends, same = [], [np.zeros(1, np.int64)], np.ones(len(column), bool)
    done = 0
    for a, b in slices(offsets, _SLICE):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        ids, id_at = enc.encode_all(part, at)
        back, back_at = enc.decode_all(ids, id_at)
        if not (np.array_equal(back_at, at) and np.array_equal(back, part)):
            same[a:b] = [back[back_at[i] : back_at[i + 1]].tobytes() == part[at[i] : at[i + 1]].tobytes() for i in range(b - a)]
        all_ids.append(ids)
        ends.append(done + id_at[1:])
        done += len(ids)
    at = np.concatenate(ends)
    values = pa.array(np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32), pa.int32())
    offs = pa.array(at.astype(np.int32), mask=np.append(mask, False)) if mask.any() else pa.array(at.astype(np.int32))
    return pa.ListArray.from_arrays(offs, values), np.diff(at), same


def encode(docs: DataFrame, model_file: str | None = None, ids: str = "ids", n_tokens: str = "n_tokens", round_trip: str = "round_trip") -> DataFrame:
    """``docs`` with the ids of ``text``, their number, and whether decoding them gives the text back.

    A null text has null ids, 0 of them, and a null round_trip; an empty one has none. New columns get another name
    (a trailing underscore) if ``docs`` has it already. U+2581 in a text is taken for a space, as the model can't tell them apart,
    and compared as such. Each row is handled by itself, so repeated rows and null ids need no rule. No shuffle.
    """
    shared = _Shared(docs.sparkSession, model_file or default_model())
    names = fresh(docs.columns, ids, n_tokens, round_trip)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for whole in batches:
            for a, b in slices(text_buffers(whole.column(at))[1], _SLICE):
                batch = whole.slice(a, b - a)
                column = batch.column(at)
                out, number, same = _encoded(enc, column)
                null = column.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*batch.columns, out, pa.array(number), pa.array(same, mask=null)], [*batch.schema.names, *names])

    schema = StructType(list(docs.schema.fields))  # add() changes its list
    for name, kind in zip(names, (ArrayType(IntegerType()), LongType(), BooleanType())):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, model_file: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of the column ``ids``; null ids give null. Ids outside the vocabulary raise an error."""
    shared = _Shared(df.sparkSession, model_file or default_model())
    (name,) = fresh(df.columns, text)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for batch in batches:
            column = batch.column(at)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) and not (0 <= flat.min() and flat.max() < len(enc.v.pieces)):
                raise ValueError("an id is outside the vocabulary")
            import pyarrow.compute as pc

            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            data, offs = enc.decode_all(flat, np.concatenate([[0], np.cumsum(sizes)]))
            raw = data.tobytes()
            texts = [None if null else raw[offs[i] : offs[i + 1]].decode(errors="replace") for i, null in enumerate(column.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return df.mapInArrow(run, StructType(list(df.schema.fields)).add(name, StringType()))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every row of ``documents``, their number, and whether they decode to the text; see ``encode`` for nulls, empty and long texts and repeated rows."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
