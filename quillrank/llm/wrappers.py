"""HTML extraction by inferring a union-free regular expression, the wrapper, from the pages of each host.

A page is a stream of tags, each with the text that follows it (maybe none). A wrapper is a sequence of tags, elements and groups, each of
which may be optional ``(...)?`` or repeated ``(...)+`` and holds a sequence in its turn, never an alternative; the text after a tag is a slot.
Token streams are aligned level by level, from the outermost: what stands between a tag and its closing tag is the stream of the next
level, tags without a partner stand alone. On each level a mismatch is resolved

* into repeated items: tags or elements of one name that follow each other are one item, whatever they hold, and equal blocks of
  any length that follow each other become a group, inner ones first. A group found in one stream is applied to all streams of its place, so that
  a single block is a group of one;
* into optional items: the streams of a place are aligned by longest common subsequences, and what one of them lacks is optional;
* into slots: a text that is the same in every page that has it, and in two pages of different content at least, belongs to the template
  and is left out; the others are extracted. Content is what a page holds beside texts that two pages of different text have in common,
  so copies of one page (under another script, or with a box of the template in one of them) don't make their text template.

What an item holds is then aligned over all its occurrences, in all pages: a list item that lacks a part makes that part optional.
Streams are aligned in an order of their own (longest first, then by their symbols), so neither the order nor the
partitioning of the pages matters.

Inference takes two steps: a page's own wrapper, its shape, and the wrapper of all distinct shapes of its host. Shapes are made where the pages
are and only distinct ones are shuffled, so a host with most of the pages costs no more than others there. Hosts with more than
``MAX_SHAPES`` of them are inferred in parts chosen by a hash of the shape, whose wrappers are inferred from in their turn, so no task gets an
unbounded group. Pages meet their host's wrapper in a join and are parsed by mapping their shape's places to the wrapper's.
"""

from __future__ import annotations

import html
import json
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, table

#: Blocks of up to so many symbols are found by a regular expression, longer ones by ``long_blocks``.
MAX_BLOCK = 24
#: So many shapes of a host are aligned in one task.
MAX_SHAPES = 5000
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!?(/?[a-zA-Z][a-zA-Z0-9:-]*)[^<>]*>", re.S | re.I)
_TANDEM = re.compile(r"(.{2,%d}?)\1+" % MAX_BLOCK, re.S)
_SPACE = re.compile(r"\s+")
_BASE = 0x4E00
_ALONE = frozenset("area base br col embed hr img input link meta source track wbr doctype".split()) | {""}


def host_of(url: Column) -> Column:
    """The host of a URL in small letters, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def tokens(page: str) -> tuple[list[str], list[str]]:
    """Tags in small letters, and the text after each with entities decoded and white space as single spaces.

    Text before the first tag belongs to the tag "". Comments, scripts and styles are taken out of the text.
    """
    tags, parts, at = [""], [[]], 0
    for m in _TOKEN.finditer(page):
        parts[-1].append(page[at : m.start()])
        at = m.end()
        if m.group(2):
            tags.append(m.group(2).lower())
            parts.append([])
    parts[-1].append(page[at:])
    texts = [_SPACE.sub(" ", html.unescape("".join(p))).strip() if p else "" for p in parts]
    return tags, texts


def tag_names(page: str) -> list[str]:
    """The tags of ``tokens``."""
    return ["", *[m.group(2).lower() for m in _TOKEN.finditer(page) if m.group(2)]]


def nested(tags: list[str]) -> list[list]:
    """The stream as a forest of [name, place of the tag, place of the closing tag or -1, what stands between]; tags without a partner stand alone."""
    top: list[list] = []
    now, stack = top, []
    waiting: dict[str, int] = {}

    def leave() -> None:
        """The innermost open tag has no partner: what follows it stands beside it."""
        nonlocal now
        node = stack.pop()
        waiting[node[0]] -= 1
        now = stack[-1][3] if stack else top
        now += node[3]
        node[3] = []

    for i, t in enumerate(tags):
        if t[:1] != "/":
            node = [t, i, -1, []]
            now.append(node)
            if t not in _ALONE:
                stack.append(node)
                waiting[t] = waiting.get(t, 0) + 1
                now = node[3]
        elif waiting.get(t[1:]):
            while stack[-1][0] != t[1:]:
                leave()
            node = stack.pop()
            waiting[node[0]] -= 1
            node[2] = i
            now = stack[-1][3] if stack else top
        else:
            now.append([t, i, -1, []])
    while stack:
        leave()
    return top


#: A stretch of a stream: (name, optional, repeated, what the caller knows it by).
Unit = tuple[str, bool, bool, object]


@lru_cache(100_000)
def body_of(name: str) -> tuple[str, ...]:
    """The names in a group's: "(dt,dd)" is ("dt", "dd")."""
    out, depth, begin = [], 0, 1
    for i in range(1, len(name) - 1):
        c = name[i]
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(name[begin:i])
            begin = i + 1
    return (*out, name[begin:-1])


def _rank(body: tuple[str, ...]) -> tuple:
    """Inner groups come first, then short ones."""
    return max((sum(1 for c in x if c == "(") for x in body), default=0), len(body), body


class _Folder:
    """Streams as strings, a character for each name; optional units have characters of their own, which no group holds."""

    def __init__(self) -> None:
        self.code: dict[str, str] = {}
        self.name: dict[str, str] = {}

    def char(self, name: str) -> str:
        c = self.code.get(name)
        if c is None:
            n = _BASE + len(self.code)
            c = self.code[name] = chr(n if n < 0xD800 else n + 0x2800)
            self.name[c] = name
        return c

    def string(self, units: list[Unit]) -> str:
        return "".join([self.char(u[0] + "?" if u[1] else u[0]) for u in units])

    def fold(self, s: str, entries: list, bodies: list[tuple[str, ...]]) -> tuple[str, list]:
        """``s`` and its entries (name, unit) with all groups applied in order, again until nothing changes.

        The entry of a group is (name, members), where a member is a list of the entries of whole occurrences, or the unit of a group found before.
        """
        rules = [("(" + ",".join(b) + ")", "".join(map(self.char, b))) for b in bodies]
        while True:
            before = s
            for name, body in rules:
                c = self.char(name)
                if body in s:
                    parts, out, at = [], [], 0
                    while (i := s.find(body, at)) >= 0:
                        j = i + len(body)
                        while s.startswith(body, j):
                            j += len(body)
                        parts += [s[at:i], c]
                        out += entries[at:i]
                        out.append((name, [entries[i:j]]))
                        at = j
                    s, entries = "".join(parts) + s[at:], out + entries[at:]
                if c + c in s:
                    parts, out = [], []
                    for x, e in zip(s, entries):
                        if x == c and parts and parts[-1] == c:
                            out[-1] = name, _members(out[-1]) + _members(e)
                        else:
                            parts.append(x)
                            out.append(e)
                    s, entries = "".join(parts), out
            if s == before:
                return s, entries

    def discover(self, s: str) -> set[tuple[str, ...]]:
        """Groups of equal blocks that follow each other, inner ones first, until there are none."""
        found: set[tuple[str, ...]] = set()
        entries: list = [None] * len(s)
        while True:
            blocks = {_unit(m.group(1)) for m in _TANDEM.finditer(s)} or set(long_blocks(s, MAX_BLOCK + 1))
            bodies = {tuple(self.name[c] for c in b) for b in blocks if len(b) > 1}
            bodies = {b for b in bodies if not any(x[-1:] == "?" for x in b)} - found
            if not bodies:
                return found
            found |= bodies
            s, entries = self.fold(s, entries, sorted(bodies, key=_rank))


def _members(entry: tuple[str, object]) -> list:
    return entry[1] if isinstance(entry[1], list) else [entry[1]]


def _unit(s: str) -> str:
    """The shortest block of which ``s`` is a repetition."""
    n = (s + s).find(s, 1)
    return s[:n]


def long_blocks(s: str, least: int) -> list[str]:
    """Blocks of at least ``least`` symbols that stand in ``s`` twice or more in a row. Of stretches that overlap, that with the shorter block counts.

    A stretch of period p and length 2p or more holds two places that are p apart and multiples of p, around which ``s`` agrees with itself
    over p symbols. There are n log n such pairs; their agreement is looked up in ranks of all substrings of 1, 2, 4, ... symbols.
    """
    n = len(s)
    if n < 2 * least:
        return []
    ranks = [np.unique(np.frombuffer(s.encode("utf-32-le"), np.uint32), return_inverse=True)[1].astype(np.int64)]
    while len(ranks[-1]) > (w := 1 << (len(ranks) - 1)):
        low, high = ranks[-1][:-w], ranks[-1][w:]
        held, rank = np.unique(low * (n + 1) + high, return_inverse=True)
        if len(held) == len(rank):  # no substring so long stands twice
            break
        ranks.append(rank)
    if 1 << len(ranks) <= least:
        return []
    runs: set[tuple[int, int, int]] = set()
    p = least
    while p <= n // 2:
        # some million pairs at a time
        to = p + 1
        pairs = n // p
        while to <= n // 2 and pairs < 1 << 20:
            pairs += n // to
            to += 1
        periods = np.arange(p, to)
        many = (n - 1) // periods  # places i = 0, p, 2p, ... with i + p < n
        period = np.repeat(periods, many)
        i = (np.arange(len(period)) - np.repeat(np.cumsum(many) - many, many)) * period
        j = i + period
        after, before = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            w, r = 1 << k, ranks[k]
            at = np.minimum(j + after, len(r) - 1)
            after += w * ((j + after < len(r)) & (r[np.minimum(i + after, len(r) - 1)] == r[at]))
            at = np.maximum(i - before - w, 0)
            before += w * ((i - before >= w) & (r[at] == r[np.minimum(at + period, len(r) - 1)]))
        hit = after + before >= period
        runs.update(zip(period[hit].tolist(), (i - before)[hit].tolist(), (j + after)[hit].tolist()))
        p = to
    used = np.zeros(n, bool)
    out = []
    for p, a, b in sorted(runs):
        if not used[a:b].any():
            used[a:b] = True
            out.append(s[a : a + p])
    return out


def common(x: list[str], y: list[str], limit: int = 1 << 29) -> list[tuple[int, int]]:
    """Places of a longest common subsequence.

    Rows of the table of lengths are bit strings (a 0 where the length grows), so a row takes some operations on long integers. Tables of more than ``limit`` bits are divided at the middle of ``x`` and the place of ``y`` that belongs to it.
    """
    n, m, lead, tail = len(x), len(y), 0, 0
    while lead < min(n, m) and x[lead] == y[lead]:
        lead += 1
    while tail < min(n, m) - lead and x[n - 1 - tail] == y[m - 1 - tail]:
        tail += 1
    out = [(i, i) for i in range(lead)]
    todo = [(lead, n - tail, lead, m - tail)]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) > limit and b - a > 1:
            mid = (a + b) // 2
            ahead, behind = _row(x[a:mid], y[c:d])[-1], _row(x[mid:b][::-1], y[c:d][::-1])[-1]
            k = c + int(np.argmax(_lengths(ahead, d - c) + _lengths(behind, d - c)[::-1]))
            todo += [(mid, b, k, d), (a, mid, c, k)]
            continue
        rows = _row(x[a:b], y[c:d], True)
        part: list[tuple[int, int]] = []
        i, j = b - a, d - c
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or rows[i - 1] >> (j - 1) & 1:
                    j -= 1
                    part.append((a + i, c + j))
        out += part[::-1]
    return out + [(n - t, m - t) for t in range(tail, 0, -1)]


def _row(x: list[str], y: list[str], every: bool = False) -> list[int]:
    """The last row of the table of lengths, or every row."""
    at: dict[str, int] = {}
    for j, c in enumerate(y):
        at[c] = at.get(c, 0) | 1 << j
    whole = (1 << len(y)) - 1
    row, out = whole, []
    for c in x:
        met = row & at.get(c, 0)
        row = (row + met | row - met) & whole
        if every:
            out.append(row)
    return out if every else [row]


def _lengths(row: int, m: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(row.to_bytes(m // 8 + 1, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def placed(names: list[str], s: list[str]) -> list[int] | None:
    """The first places of ``names`` at which ``s`` stands in its order; None where there are none."""
    out, at = [], 0
    for c in s:
        try:
            at = names.index(c, at) + 1
        except ValueError:
            return None
        out.append(at - 1)
    return out


def align(names: list[str], s: list[str]) -> list[str]:
    """The shortest stream in which both stand in their order."""
    out: list[str] = []
    i = j = 0
    for p, q in [*common(names, s), (len(names), len(s))]:
        out += names[i:p] + s[j:q] + names[p : p + 1]
        i, j = p + 1, q + 1
    return out


def _level(streams: list[list[Unit]]) -> tuple[list[str], list[bool], list[list], list[tuple[str, ...]]]:
    """(names, optional or not, the entries at each, groups) of the streams of one place, aligned."""
    keys = [tuple([u[0] + "?" if u[1] else u[0] for u in x]) for x in streams]
    distinct = dict.fromkeys(keys)
    first = next(iter(distinct))
    if len(distinct) == 1 and len(set(first)) == len(first):
        names = [u[0] for u in streams[0]]
        return names, [u[1] for u in streams[0]], [[(name, x[j]) for x in streams] for j, name in enumerate(names)], [body_of(x) for x in names if x[:1] == "("]
    folder = _Folder()
    text = {k: "".join(map(folder.char, k)) for k in distinct}
    bodies = {body_of(x) for k in distinct for y in k if (x := y.removesuffix("?"))[:1] == "("}
    for _ in range(2):  # once more with the groups of the others applied
        order = sorted(bodies, key=_rank)
        more = set()
        for k in distinct:
            s = folder.fold(text[k], [None] * len(k), order)[0]
            if len(set(s)) < len(s):
                more |= folder.discover(s)
        if more <= bodies:
            break
        bodies |= more
    order = sorted(bodies, key=_rank)
    forms: dict[tuple, tuple[list[str], list[bool]]] = {}
    for k in distinct:
        entries = folder.fold(text[k], [(x.removesuffix("?"), (x.removesuffix("?"), x[-1:] == "?")) for x in k], order)[1]
        forms[k] = [e[0] for e in entries], [not isinstance(e[1], list) and e[1][1] for e in entries]
    names: list[str] = []
    for s in sorted({tuple(f[0]) for f in forms.values()}, key=lambda f: (-len(f), f)):
        if placed(names, list(s)) is None:
            names = align(names, list(s)) if names else list(s)
    where = {k: placed(names, f[0]) for k, f in forms.items()}
    optional = [False] * len(names)
    for k, f in forms.items():
        at = set(where[k])
        for j in range(len(names)):
            optional[j] |= j not in at
        for j, maybe in zip(where[k], f[1]):
            optional[j] |= maybe
    members: list[list] = [[] for _ in names]
    for k, x in zip(keys, streams):
        entries = folder.fold(text[k], [(u[0], u) for u in x], order)[1] if order else [(u[0], u) for u in x]
        for j, e in zip(where[k], entries):
            members[j].append(e)
    return names, optional, members, order


def grow(streams: list[list[Unit]], below: Callable[[object], list[list[Unit]]], meet: Callable[[object, int, int], None]) -> list[list]:
    """The wrapper of ``streams``: sequences of items [name, optional, repeated, number of the sequence it holds or -1], each with its groups, the first
    of them the outermost. ``below`` gives the streams that a unit holds, ``meet`` is told the sequence and place of every unit."""
    out: list = [None]
    work: deque = deque([(0, streams, None)])
    while work:
        number, held, body = work.popleft()
        if body is None:
            names, optional, members, groups = _level(held)
        else:
            names, optional, members, groups = list(body), [False] * len(body), held, []
        items = []
        for j, name in enumerate(names):
            repeated, child = False, -1
            if name[:1] == "(":
                inner = body_of(name)
                parts: list[list] = [[] for _ in inner]
                for entry in members[j]:
                    for member in _members(entry):
                        if isinstance(member, list):
                            repeated = True
                            for k in range(len(inner)):
                                parts[k] += member[k :: len(inner)]
                        else:
                            repeated |= member[2]
                            meet(member[3], number, j)
                            for k, u in enumerate(below(member[3])[0]):
                                parts[k].append((u[0], u))
                child = len(out)
                out.append(None)
                work.append((child, parts, inner))
            else:
                inside = []
                for _, unit in members[j]:
                    repeated |= unit[2]
                    meet(unit[3], number, j)
                    inside += below(unit[3])
                if any(inside):
                    child = len(out)
                    out.append(None)
                    work.append((child, inside, None))
            items.append([name, int(optional[j]), int(repeated), child])
        out[number] = [items, groups]
    return out


def _runs(nodes: list[list]) -> list[Unit]:
    """Nodes of one name that follow each other as one unit."""
    out: list[Unit] = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            out[-1][3].append(node)
            if not out[-1][2]:
                out[-1] = (node[0], False, True, out[-1][3])
        else:
            out.append((node[0], False, False, [node]))
    return out


def shape_of(tags: list[str]) -> tuple[str, list[tuple[int, int, bool]]]:
    """(the page's own wrapper as JSON, for each tag its sequence, place and whether it closes the item)."""
    slots: list = [None] * len(tags)

    def meet(nodes: list[list], number: int, j: int) -> None:
        for _, i, end, _ in nodes:
            slots[i] = number, j, False
            if end >= 0:
                slots[end] = number, j, True

    made = grow([_runs(nested(tags))], lambda nodes: [_runs(x[3]) for x in nodes], meet)
    return json.dumps(made, separators=(",", ":")), slots


def _units(shape: list, number: int, key: int) -> list[Unit]:
    return [(x[0], bool(x[1]), bool(x[2]), (key, number, j)) for j, x in enumerate(shape[number][0])]


def infer(shapes: Iterable[str]) -> str:
    """The wrapper of shapes or wrappers, whatever their order."""
    held = [json.loads(x) for x in sorted(set(shapes))]

    def below(ref: tuple[int, int, int]) -> list[list[Unit]]:
        key, number, j = ref
        child = held[key][number][0][j][3]
        return [_units(held[key], child, key) if child >= 0 else []]

    return json.dumps(grow([_units(x, 0, key) for key, x in enumerate(held)], below, lambda *_: None), separators=(",", ":"))


def mapping(wrapper: list, shape: list) -> dict[tuple[int, int], str] | None:
    """The wrapper's slot for each (sequence, place) of a shape; None if the wrapper doesn't accept it."""
    out: dict[tuple[int, int], str] = {}
    work: list[tuple[int, int, object]] = [(0, 0, _units(shape, 0, 0))]
    while work:
        number, _, stream = work.pop()
        items, groups = wrapper[number]
        names = [x[0] for x in items]
        folder = _Folder()
        entries = [(u[0], u) for u in stream]
        if groups:
            entries = folder.fold(folder.string(stream), entries, [tuple(b) for b in groups])[1]
        at = placed(names, [e[0] for e in entries])
        if at is None:
            return None
        missed = set(range(len(items))).difference(at)
        if any(not items[j][1] for j in missed):
            return None
        parts = [(number, j, e) for j, e in zip(at, entries)]
        while parts:
            n, j, entry = parts.pop()
            _, optional, repeated, child = wrapper[n][0][j]
            for member in _members(entry):
                if isinstance(member, list):
                    size = len(wrapper[child][0])
                    if not repeated:
                        return None
                    parts += [(child, k % size, e) for k, e in enumerate(member)]
                    continue
                if member[1] > optional or member[2] > repeated:
                    return None
                _, a, b = member[3]
                out[a, b] = f"{n}.{j}"
                below = shape[a][0][b][3]
                inner = _units(shape, below, 0) if below >= 0 else []
                if entry[0][:1] == "(":
                    parts += [(child, k, (u[0], u)) for k, u in enumerate(inner)]
                elif child >= 0:
                    work.append((child, 0, inner))
                elif inner:
                    return None
    return out


def show(wrapper: list) -> str:
    """The wrapper as a regular expression. An element that only some occurrences close, or hold anything, is shown as if all did."""

    def of(number: int) -> str:
        out = []
        for name, optional, repeated, child in wrapper[number][0]:
            inner = of(child) if child >= 0 else ""
            text = inner if name[:1] == "(" else f"<{name}>{inner}" + (f"</{name}>" if child >= 0 else "")
            text = f"({text})+" if repeated else text
            out.append(f"({text})?" if optional else text)
        return "".join(out)

    return of(0)


class Wrapper:
    """A host's wrapper; ``text`` is how it travels. Remembers how it accepts the shapes that it met."""

    def __init__(self, text: str) -> None:
        self.sequences = json.loads(text)
        self._known: dict[str, dict[tuple[int, int], str] | None] = {}

    def slots(self, tags: list[str]) -> list[tuple[str, int]] | None:
        """(slot, place in ``tags``) of a page in its order; None if the wrapper doesn't accept it."""
        shape, places = _shape(tuple(tags))
        if shape not in self._known:
            if len(self._known) > 10_000:
                self._known.clear()
            self._known[shape] = mapping(self.sequences, json.loads(shape))
        met = self._known[shape]
        return None if met is None else [(met[n, j] + "/" if closing else met[n, j], i) for i, (n, j, closing) in enumerate(places)]

    def __str__(self) -> str:
        return show(self.sequences)


_shapes: dict[tuple[str, ...], tuple[str, list]] = {}


def _shape(tags: tuple[str, ...]) -> tuple[str, list[tuple[int, int, bool]]]:
    """``shape_of``, remembered for short streams, of which pages have many equal ones."""
    found = _shapes.get(tags)
    if found is None:
        found = shape_of(list(tags))
        if len(tags) < 1000:
            if len(_shapes) > 2000:
                _shapes.clear()
            _shapes[tags] = found
    return found


_wrappers: dict[str, Wrapper] = {}


def _wrapper(text: str) -> Wrapper:
    if text not in _wrappers:
        if len(_wrappers) > 1000:
            _wrappers.clear()
        _wrappers[text] = Wrapper(text)
    return _wrappers[text]


def _shape_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = sorted({(host, _shape(tuple(tag_names(page)))[0]) for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())})
        yield pa.RecordBatch.from_pydict({"host": pa.array([r[0] for r in rows], pa.string()), "shape": pa.array([r[1] for r in rows], pa.string())})


def _digest(texts: Iterable[str]) -> str:
    return xxhash.xxh64_hexdigest("\0".join(x for x in texts if x))


def _slot_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple[str, str], tuple[str, str, str, str]] = {}
        for host, page, wrapper in zip(*(c.to_pylist() for c in batch.columns)):
            tags, held = tokens(page)
            one = _digest(held)
            for slot, i in _wrapper(wrapper).slots(tags) or []:
                x = held[i]
                low, high, first, last = seen.get((host, slot), (x, x, one, one))
                seen[host, slot] = min(low, x), max(high, x), min(first, one), max(last, one)
        # only whether two texts differ matters, so long ones needn't travel
        rows = sorted((h, s, *(x if low == high or len(x) < 64 else x[:64] + "\0" + str(k) for k, x in enumerate((low, high))), *pages) for (h, s), (low, high, *pages) in seen.items())
        yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("host", "slot", "low", "high", "first", "last"))})


def _content_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple[str, str], tuple[str, str]] = {}
        fixed_sets: dict[str, set[str]] = {}
        for host, page, wrapper, fixed in zip(*(c.to_pylist() for c in batch.columns)):
            if fixed not in fixed_sets:
                fixed_sets[fixed] = set(json.loads(fixed))
            skip = fixed_sets[fixed]
            tags, held = tokens(page)
            slots = _wrapper(wrapper).slots(tags) or []
            one = _digest(held[i] for slot, i in slots if slot not in skip)
            for slot, i in slots:
                if held[i] and slot in skip:
                    first, last = seen.get((host, slot), (one, one))
                    seen[host, slot] = min(first, one), max(last, one)
        rows = sorted((*k, *v) for k, v in seen.items())
        yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], pa.string()) for i, k in enumerate(("host", "slot", "first", "last"))})


def wrappers(pages: DataFrame, max_shapes: int = MAX_SHAPES) -> DataFrame:
    """(host, wrapper, fixed): the wrapper of every host of ``pages`` (host, html) and a JSON list of its slots that hold template text."""
    shapes = cut(pages.mapInArrow(_shape_batches, "host string, shape string").distinct(), "page-shapes")

    def inferred_of(t: pa.Table) -> pa.Table:
        return pa.table({"host": t.column("host")[:1], "shape": pa.array([infer(t.column("shape").to_pylist())], pa.string())})

    while (many := shapes.groupBy("host").count().filter(F.col("count") > max_shapes)).count():
        # parts of such hosts, as many as they need
        parts = shapes.join(many, "host", "left").withColumn("part", F.pmod(F.xxhash64("shape"), F.coalesce(F.ceil(F.col("count") * 2 / max_shapes), F.lit(1)).cast("int")))
        shapes = cut(parts.groupBy("host", "part").applyInArrow(inferred_of, "host string, shape string").distinct(), "page-shapes")
    inferred = cut(shapes.groupBy("host").applyInArrow(inferred_of, "host string, shape string").withColumnRenamed("shape", "wrapper"), "page-wrappers")
    slots = pages.join(inferred, "host").select("host", "html", "wrapper").mapInArrow(_slot_batches, "host string, slot string, low string, high string, first string, last string")
    fixed = slots.groupBy("host", "slot").agg(((F.min("low") == F.max("high")) & (F.min("first") != F.max("last"))).alias("same"))
    fixed = fixed.groupBy("host").agg(F.bool_and("same").alias("all"), F.sort_array(F.collect_list(F.when(F.col("same"), F.col("slot")))).alias("fixed"))
    # where no text differs, nothing tells template from content
    fixed = fixed.select("host", F.to_json(F.when(F.col("all"), F.array().cast("array<string>")).otherwise(F.col("fixed"))).alias("fixed"))
    likely = cut(inferred.join(fixed, "host"), "page-templates")
    contents = pages.join(likely.filter("fixed != '[]'"), "host").select("host", "html", "wrapper", "fixed").mapInArrow(_content_batches, "host string, slot string, first string, last string")
    fixed = contents.groupBy("host", "slot").agg((F.min("first") != F.max("last")).alias("differ")).filter("differ").groupBy("host").agg(F.to_json(F.sort_array(F.collect_list("slot"))).alias("fixed"))
    return likely.drop("fixed").join(fixed, "host", "left").select("host", "wrapper", F.coalesce("fixed", F.lit("[]")).alias("fixed"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, host, title, text, links, n_slots): what the slots of its host's wrapper hold, for every row of ``pages``.

    ``pages`` needs page_id, url and html; other columns are ignored, whatever their names. ``title`` is the title's text, ``links`` the texts
    of links, ``text`` the other texts by line, each where the template doesn't hold it. A host with one page (or with pages of
    equal text only) shows no difference between template and content, so all its texts are content. Copies of one article whose menus or
    ads have different texts look like two pages of a template: what only such copies reach is lost from all of them. A page with a null or
    malformed url belongs to the host "". A null html gives a null title, text and links and 0 slots; an empty one empty ones. Null ids pass through,
    repeated rows are given as often. Pages cut off anywhere are read as far as they go. A page that the wrapper of a host inferred in parts doesn't
    accept is content as a whole. The result depends neither on the order nor on the partitioning of the pages.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), F.col("html"))
    made = cut(wrappers(rows.filter("html IS NOT NULL").select("host", "html")), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed_sets: dict[str, set[str]] = {}
        for batch in batches:
            titles, texts, links, numbers = [], [], [], []
            for page, wrapper, fixed in zip(*(c.to_pylist() for c in batch.columns[2:])):
                if page is None:
                    titles.append(None), texts.append(None), links.append(None), numbers.append(0)
                    continue
                if fixed not in fixed_sets:
                    fixed_sets[fixed] = set(json.loads(fixed))
                tags, held = tokens(page)
                skip = fixed_sets[fixed]
                slots = _wrapper(wrapper).slots(tags)
                if slots is None:
                    slots = [("", i) for i in range(len(tags))]
                got = [i for slot, i in slots if held[i] and slot not in skip]
                titles.append(" ".join(held[i] for i in got if tags[i] == "title"))
                texts.append("\n".join(held[i] for i in got if tags[i] not in ("title", "a")))
                links.append([held[i] for i in got if tags[i] == "a"])
                numbers.append(len(got))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(titles, pa.string()), pa.array(texts, pa.string()), pa.array(links, pa.list_(pa.string())), pa.array(numbers, pa.int64())],
                ["page_id", "host", "title", "text", "links", "n_slots"],
            )

    joined = rows.join(made, "host", "left").select("page_id", "host", "html", "wrapper", "fixed")
    return joined.mapInArrow(run, "page_id long, host string, title string, text string, links array<string>, n_slots long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the templates of their hosts leave of ``pages``; see ``extract`` for nulls, empty and long pages, ties and repeated rows."""
    return extract(table(spark, sf_dir, "pages"))
