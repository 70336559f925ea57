"""SimHash, line and substring deduplication against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillrank.llm import linededup, simhash, substrings
from quillrank.llm._bytes import text_buffers
from quillrank.llm.components import components

import pyarrow as pa


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F

        for name in ("h", "n", "d", "piece", "anchor", "line_hashes", "small_text", "TEXT_", "n_words"):
            df = df.withColumn(name, F.lit("x"))
    return df


def prose(rnd, n, vocabulary=2000):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    rnd = random.Random(seed)
    docs = {i: prose(rnd, rnd.randrange(60, 300)) for i in range(40)}
    for i in range(40, 70):
        w = list(docs[rnd.randrange(20)])
        for j in rnd.sample(range(len(w)), len(w) // 40):
            w[j] = f"w{rnd.randrange(2000)}"
        docs[i] = w
    docs[70] = docs[3]
    shared = prose(rnd, 60)
    for i in (71, 72, 73):
        docs[i] = prose(rnd, 80) + shared + prose(rnd, 30)
    docs[74] = prose(rnd, 40) + shared[:49] + prose(rnd, 40)
    return {i: " ".join(w) for i, w in docs.items()}


def simhash_brute(docs):
    ids = sorted(docs)
    data, offsets = text_buffers(pa.array([docs[i].lower() for i in ids]))
    sig, size = simhash.signatures_of(data, offsets)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            bits = int(np.bitwise_count(sig[a] ^ sig[b]).sum())
            if size[a] and size[b] and bits <= simhash.MAX_BITS and min(size[a], size[b]) >= simhash.MIN_RATIO * max(size[a], size[b]):
                x, y = find(ids[a]), find(ids[b])
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids if find(i) != i}


def links_brute(docs):
    """{doc: number of other signatures within the distance}."""
    ids = sorted(docs)
    data, offsets = text_buffers(pa.array([docs[i].lower() for i in ids]))
    sig, size = simhash.signatures_of(data, offsets)
    kinds = {(int(a), int(b), int(n)) for (a, b), n in zip(sig, size) if n}
    near = lambda x, y: x != y and (x[0] ^ y[0]).bit_count() + (x[1] ^ y[1]).bit_count() <= simhash.MAX_BITS and min(x[2], y[2]) >= simhash.MIN_RATIO * max(x[2], y[2])
    return {i: sum(near((int(a), int(b), int(n)), x) for x in kinds) for i, (a, b), n in zip(ids, sig, size)}


@pytest.mark.parametrize(("split_rows", "bands"), [(1_000_000, None), (40, None), (4, 8), (4, 6), (30, 5), (30, 4), (1_000_000, 4)])
def test_simhash_is_brute_force(spark, split_rows, bands):
    docs = corpus()
    rows = simhash.classes(frame(spark, list(docs.items()), True), split_rows=split_rows, bands=bands).collect()
    root, links = simhash_brute(docs), links_brute(docs)
    assert {r["doc_id"]: r["class_id"] for r in rows} == root | {i: i for i in root.values()} and len(rows) == len({r["doc_id"] for r in rows}) and len(root) >= 30
    assert {r["doc_id"]: r["n_links"] for r in rows} == {r["doc_id"]: links[r["doc_id"]] for r in rows}


def test_bands_are_chosen_by_work():
    assert [simhash.bands_for(n, simhash.MAX_BITS) for n in (0, 1000, 100_000)] == [8, 8, 8]
    assert simhash.bands_for(10**8, simhash.MAX_BITS) < 8
    for bands in simhash.BANDS:
        edges = simhash.edges_of(bands)
        budget = simhash.MAX_BITS // bands
        assert edges[0][0] == 0 and edges[-1][1] == 128 and bands * (budget + 1) > simhash.MAX_BITS
        # copies of a row, own and guest
        assert 2 * sum(len(simhash.pieces_of(lo, hi, budget, 1)) for lo, hi in edges) <= 50


def test_signature_is_a_majority():
    data, offsets = text_buffers(pa.array(["a b c", "", "c b a A", "x"]))
    sig, size = simhash.signatures_of(data, offsets)
    assert size.tolist() == [3, 0, 3, 1] and (sig[0] == sig[2]).all() and (sig[0] != sig[3]).any()


def test_trie_pairs_are_all_pairs():
    rnd = np.random.default_rng(0)
    values = np.unique(rnd.integers(0, 1 << 10, 200))
    for budget in (0, 1, 2):
        got = [(int(values[a]), int(values[b])) for p, q in simhash.trie_pairs(values, budget, 10, 50) for a, b in zip(p, q)]
        assert len(got) == len(set(got))
        got = set(got)
        assert got == {(int(a), int(b)) for a in values for b in values if a <= b and int(a ^ b).bit_count() <= budget}


def test_simhash_edges(spark):
    long = " ".join(prose(random.Random(3), 30_000, 9000))
    rows = [(5, "same old words here"), (2, "same old words here"), (2, "same old words here"), (None, "same old words here"), (7, None), (8, ""), (9, "..."), (10, "..."), (11, long), (12, long + " end"), (20, "alone twice"), (20, "alone twice"), (31, "one text of two under an id"), (31, "and the other text of that id there"), (30, "one text of two under an id"), (32, "and the other text of that id there")]
    got = {(r["doc_id"], r["duplicate_of"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(5, 2), (12, 11), (31, 30), (32, 30)}
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}


def lines_brute(rows, max_docs, keep_first=False):
    key = lambda x: re.sub(r"\s+", " ", x).strip().lower()
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if key(x) and d is not None:
                held[key(x)].add(d)
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0))
            continue
        keep = [x for x in t.split("\n") if not (len(held[key(x)]) > max_docs and not (keep_first and d is not None and d == min(held[key(x)])))]
        out.append((d, "\n".join(keep), len(t.split("\n")) - len(keep)))
    return Counter(out)


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_are_brute_force(spark, keep_first):
    rnd = random.Random(4)
    pool = ["Home  | About", "home | about", " ", "", "a line", "A LINE ", "rare one", "\tb\t", "c"]
    rows = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.5 else f"own {i} {j}" for j in range(rnd.randrange(1, 9)))) for i in range(60)]
    rows += [(3, rows[3][1]), (61, None), (62, ""), (None, "a line\nown"), (63, "a line"), (64, "x\n" * 20_000 + "a line")]
    got = linededup.drop_common_lines(frame(spark, rows, True), 3, keep_first, "gone")
    assert Counter((r["doc_id"], r["text"], r["gone"]) for r in got.collect()) == lines_brute(rows, 3, keep_first)
    assert got.columns == [*frame(spark, rows[:1], True).columns, "gone"]
    assert linededup.drop_common_lines(frame(spark, rows).limit(0)).count() == 0


def spans_brute(rows, n):
    words = [(d, re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())) for d, t in rows if d is not None]
    held = defaultdict(set)
    for d, w in words:
        for i in range(len(w) - n + 1):
            held[tuple(w[i : i + n])].add(d)
    out = set()
    marked = defaultdict(set)
    for d, w in words:
        for i in range(len(w) - n + 1):
            if len(held[tuple(w[i : i + n])]) > 1:
                marked[d].add(i)
    for d, starts in marked.items():
        begin = end = None
        for i in sorted(starts):
            if begin is None or i > end:
                if begin is not None:
                    out.add((d, begin, end - begin))
                begin = i
            end = i + n
        out.add((d, begin, end - begin))
    return out


@pytest.mark.parametrize(("n", "anchor", "part"), [(50, 8, 1_000_000), (12, 4, 1_000_000), (12, 4, 40), (5, 5, 1_000_000)])
def test_substrings_are_brute_force(spark, n, anchor, part):
    rows = list(corpus(2).items()) + [(None, corpus(2)[0]), (3, corpus(2)[3]), (100, None), (101, ""), (102, "a " * 300), (103, "b a " + "a " * 200)]
    got = {(r["doc_id"], r["first_word"], r["n_words"]) for r in substrings.duplicate_spans(frame(spark, rows, True), n, anchor, part).collect()}
    assert got == spans_brute(rows, n)
    assert {71, 72, 73} <= {d for d, _, _ in got} and (n < 50 or 74 not in {d for d, _, _ in got})


def test_substrings_of_few_symbols(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 60)))) for i in range(40)]
    got = {(r["doc_id"], r["first_word"], r["n_words"]) for r in substrings.duplicate_spans(frame(spark, rows), 9, 3).collect()}
    assert got == spans_brute(rows, 9)


def test_substring_edges(spark):
    same_id = [(1, "x y z " * 30), (1, " ".join(f"q{i}" for i in range(90))), (2, " ".join(f"q{i}" for i in range(90)))]
    got = {(r["doc_id"], r["first_word"], r["n_words"]) for r in substrings.duplicate_spans(frame(spark, same_id)).collect()}
    assert got == {(1, 0, 90), (2, 0, 90)}
    assert substrings.duplicate_spans(frame(spark, same_id).limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.duplicate_spans(frame(spark, same_id), 5, 6)


def test_match_lengths():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(1, 15, 30)
    symbols, begins, owner = rnd.integers(0, 3, sizes.sum()), np.cumsum(sizes) - sizes, rnd.integers(0, 9, 30)
    got = substrings.match_lengths(symbols, begins, sizes, owner)
    for p in range(30):
        for i in range(sizes[p]):
            best = 0
            for q in range(30):
                if owner[q] != owner[p]:
                    for j in range(sizes[q]):
                        k = 0
                        while i + k < sizes[p] and j + k < sizes[q] and symbols[begins[p] + i + k] == symbols[begins[q] + j + k]:
                            k += 1
                        best = max(best, k)
            assert got[begins[p] + i] == best
