"""Vectorised helpers over Arrow string buffers, shared by the text operators.

Nothing here creates one Python object per word: a record batch's UTF-8 bytes are viewed as one
``uint8`` array and words are (start, end, hash) triples of numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))

#: 1 for bytes that belong to a word: ASCII letters and digits, and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD_BYTE[_lo:_hi] = True

#: 1 for bytes other than ASCII white space.
NON_SPACE_BYTE = np.ones(256, bool)
NON_SPACE_BYTE[[9, 10, 11, 12, 13, 32]] = False

#: Maps ASCII capitals to small letters, other bytes to themselves.
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null row is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) whose texts hold about ``budget`` bytes; at least one row each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + budget, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 4096)
        a, b = np.full(size, _P), np.full(size, _P_INV)
        a[0] = b[0] = 1
        _powers, _inverses = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _powers, _inverses


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = WORD_BYTE, fold: np.ndarray | None = LOWER_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of all maximal runs of ``member`` bytes; a text's end also ends a run.

    The hash is a polynomial over the folded bytes, so equal words have equal hashes wherever they stand.
    Works through the bytes in pieces cut between words, so a very long text costs no more memory than many short ones.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    inside = member[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    ends = np.flatnonzero(last) + 1
    return starts, ends, run_hashes(data, starts, ends, fold)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A polynomial hash of the bytes of each [start, end), which must be sorted and not overlap; empty runs hash alike."""
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + CHUNK_BYTES)))
        lo, hi = int(starts[a]), int(ends[b - 1])
        power, inverse = _tables(hi - lo + 1)
        piece = data[lo:hi]
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(((fold[piece] if fold is not None else piece).astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        hashes[a:b] = (sums[e] - sums[s]) * inverse[s]
        a = b
    return mix64(hashes)


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row of each word start."""
    return np.searchsorted(offsets, starts, side="right") - 1


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[0], first[0] + 1, ... (count[0] of them), first[1], ... in one array."""
    total = np.cumsum(count)
    return np.repeat(first - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)
