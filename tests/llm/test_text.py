"""Language ID, SentencePiece, decontamination, chats, HTML and WARC."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quillrank.llm._bytes import text_buffers
from quillrank.llm import chat, langid, pieces, topk, warc, wrappers, wumanber

SF = "/root/testdata/sf0.001"


def frame(spark, rows, kind):
    df = spark.createDataFrame(rows, kind)
    for name in ("small_text", "ids", "n_tokens", "round_trip", "guess", "wrapper", "fixed", "slot"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


# language ID


def phrases_brute(text, labelled):
    n, at = 0, 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in labelled:
            size += 1
        at += max(1, size)
        n += 1
    return n


def test_phrases_are_cross_parsing():
    rnd = random.Random(1)
    labelled = {k: bytes(rnd.choice(b"abcd ") for _ in range(200)) for k in ("x", "y")}
    labelled["z"] = b"abababab"
    model = langid.train(labelled)
    texts = [bytes(rnd.choice(b"abcde ") for _ in range(rnd.randrange(0, 80))) for _ in range(50)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = langid.phrases(model, np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert got.tolist() == [[phrases_brute(t, labelled[k]) for k in model.languages] for t in texts]


def test_long_texts_are_parsed_whole():
    model = langid.train({"x": b"abc"})
    text = b"abc" * 5000
    got = langid.phrases(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0, 0]
    assert got == phrases_brute(text, b"abc") == 5000


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = langid.classify(docs)
    assert judged.count() == docs.count()
    held_out = judged.join(docs.select("doc_id", "n_chars"), "doc_id").filter("n_chars > 200")
    right, n = held_out.agg(F.count_if(F.col("guess") == F.col("lang")), F.count("*")).first()
    assert right / n > 0.97
    assert judged.filter("accepted").count() > 0.95 * docs.count()


def test_language_edges(spark):
    rows = [(i, "the cat sat on the mat and the dog ran " * 4, "en") for i in range(3)] + [(i, "der hund und die katze sind nicht im haus " * 4, "de") for i in range(3, 6)]
    odd = [(None, "the cat and the dog", "en"), (7, None, "en"), (8, "", "en"), (9, "123 !!", None), (10, "Ωψξ жщю 漢字 " * 40, None), (1, rows[1][1], "en"), (11, "der hund im haus " * 20_000, None)]
    docs = frame(spark, rows + odd, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.classify(docs).collect()}
    assert [got[i]["guess"] for i in range(6)] == ["en"] * 3 + ["de"] * 3 and got[11]["guess"] == "de"
    assert not any(got[i]["accepted"] for i in (7, 8, 9, 10)) and got[7]["guess"] is None
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 3, 4, 5, 11, None}
    assert langid.classify(docs.limit(0)).count() == 0 and langid.accepted(docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0


# SentencePiece


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.Vocabulary(pieces.default_model()))


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_encoding_is_the_libarys(encoder, model):
    rnd = random.Random(8)
    letters = "abcdefgh  etaoin.,\n\t0123éßñ漢字😀aaaa"
    texts = ["", " ", "  ", "Hello world", "naïve  café\n\n x", "a" * 1200, "▁x▁", "ab" * 700, "   lead", "trail   "] + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 200))) for _ in range(400)]
    for t in texts:
        assert encoder.encode(t) == model.encode(t), t


def test_documents_round_trip(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = pieces.encode(docs)
    assert out.filter("NOT round_trip").count() == 0
    for r in out.orderBy(F.length("text").desc()).limit(3).unionByName(out.limit(40)).collect():
        assert list(r["ids"]) == model.encode(r["text"]) and r["n_tokens"] == len(r["ids"])
    assert pieces.decode(out).filter("decoded <> text").count() == 0


def test_piece_edges(spark, model):
    rows = [(1, None), (2, ""), (None, "x y"), (4, "word " * 50_000), (4, "word " * 50_000), (5, "é" * 3000)]
    df = frame(spark, rows, "doc_id long, text string")
    out = pieces.encode(df)
    assert out.columns == [*df.columns, "ids_", "n_tokens_", "round_trip_"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["ids_"] is None and got[1]["round_trip_"] is None and got[2]["ids_"] == [] and list(got[None]["ids_"]) == model.encode("x y")
    assert list(got[4]["ids_"]) == model.encode("word " * 50_000) and list(got[5]["ids_"]) == model.encode("é" * 3000)
    assert pieces.decode(out, ids="ids_").filter("doc_id = 1").first()["decoded"] is None
    assert pieces.encode(df.limit(0)).count() == 0


# decontamination


def contamination_brute(docs, items, n, least=wumanber.MIN_WORDS):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    out = set()
    tests = {}
    for item, text in items:
        w = words(text)
        if len(w) >= max(1, least):
            tests.setdefault(item, set()).update(" " + " ".join(w[i : i + n]) + " " for i in range(max(1, len(w) - n + 1)))
    for d, t in docs:
        whole = " " + " ".join(words(t)) + " "
        for item, strings in tests.items():
            hits = sum(s in whole for s in strings)
            if hits:
                out.add((d, item, hits))
    return out


@pytest.mark.parametrize(("n", "least", "parts"), [(13, 3, 4 << 20), (13, 1, 4 << 20), (3, 1, 1 << 20), (1, 1, 4 << 20), (3, 3, 30)])
def test_contamination_is_brute_force(spark, monkeypatch, n, least, parts):
    monkeypatch.setattr(wumanber, "PASS_WINDOWS", parts)
    rnd = random.Random(9)
    text = lambda k: " ".join(rnd.choice("alpha beta gamma delta été x 7".split()) for _ in range(k))
    items = [(i, text(rnd.randrange(0, 25))) for i in range(12)] + [(12, None), (13, "..."), (0, text(15)), (None, text(14)), (14, "Yes")]
    docs = [(i, text(rnd.randrange(0, 60))) for i in range(40)] + [(i + 40 if i is not None else 80, text(9) + "  " + (t or "").upper().replace(" ", ", ") + "! " + text(9)) for i, t in items]
    docs += [(90, None), (91, ""), (None, items[3][1]), (92, text(30_000) + " " + items[5][1]), (93, "yes, yes please")]
    docs = list(dict(docs).items())
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = wumanber.contamination(frame(spark, docs, "doc_id long, text string"), asked, n, least)
    found = sorted(map(repr, map(tuple, got.collect())))
    assert found == sorted(map(repr, contamination_brute(docs, items, n, least)))
    kept = wumanber.clean(frame(spark, docs, "doc_id long, text string"), asked, n, least)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _, _ in contamination_brute(docs, items, n, least)}


def test_test_strings_are_small_and_whole(monkeypatch):
    rnd = random.Random(3)
    text = [" ".join(f"w{rnd.randrange(50_000)}" for _ in range(200)) for _ in range(1000)]
    data, offsets = wumanber.normalise(*text_buffers(pa.array([*text, text[0]])))
    pats = wumanber.build(data, offsets)
    assert len(pats.start) == 1000 * 188 and np.diff(pats.first)[pats.item[pats.first[:-1]] == 0].tolist() == [2] * 188
    assert sum(x.nbytes for x in (pats.start, pats.size, pats.first, pats.item, pats.suffix)) < 30 * len(pats.start)
    # all hashes equal: bytes alone tell strings apart
    monkeypatch.setattr(wumanber, "_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    few, offsets = wumanber.normalise(*text_buffers(pa.array(["a b c d", "b c d", "a b c", "a b c d"])))
    pats = wumanber.build(few, offsets, 3)
    assert sorted((pats.string(j), pats.item[pats.first[j] : pats.first[j + 1]].tolist()) for j in range(len(pats.start))) == [(b" a b c ", [0, 2, 3]), (b" b c d ", [0, 1, 3])]


def test_contamination_edges(spark):
    docs, items = frame(spark, [(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert wumanber.contamination(docs, items.limit(0)).count() == 0 and wumanber.clean(docs, items.limit(0)).count() == 1
    assert wumanber.contamination(docs.limit(0), items).count() == 0 and wumanber.contamination(docs.union(docs), items).count() == 2


# top-k


def nearest_brute(vectors, k, asked=None):
    out = {}
    for i, v in vectors.items():
        if asked is None or i in asked:
            found = []
            for j, w in vectors.items():
                if j != i:
                    total = 0.0
                    for x, y in zip(v, w):
                        total += (x - y) * (x - y)
                    found.append((math.sqrt(total), j))
            out[i] = [(j, d) for d, j in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("scale", [1e-8, 1.0, 1e8])
def test_top_k_at_any_scale(spark, scale):
    rng = np.random.default_rng(3)
    vectors = {i: (rng.normal(size=8) * scale).tolist() for i in range(200)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i,) for i in (0, 20, 40, 40, 777)], "vec_id long")
    for block in (30, 40_000):
        got = {}
        for r in topk.top_k(df, 5, queries, 16, block, 8).orderBy("vec_id", "rank").collect():
            got.setdefault(r["vec_id"], []).append((r["neighbour_id"], r["distance"]))
        assert got == nearest_brute(vectors, 5, {0, 20, 40})


@pytest.mark.parametrize(("n", "dim", "k", "pivots", "block", "ring"), [(300, 6, 5, 8, 60, 16), (300, 3, 4, 128, 1000, 1024), (120, 2, 200, 4, 50, 8), (40, 1, 3, 1, 7, 2)])
def test_top_k_is_brute_force(spark, n, dim, k, pivots, block, ring):
    rnd = np.random.default_rng(n + dim)
    x = np.round(rnd.normal(size=(n, dim)) + rnd.integers(0, 3, (n, 1)) * 4, 1 if dim < 4 else 6)
    vectors = {i: v.tolist() for i, v in enumerate(x)}
    df = frame(spark, list(vectors.items()), "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, k, None, pivots, block, ring).orderBy("vec_id", "rank").collect():
        got.setdefault(r["vec_id"], []).append((r["neighbour_id"], pytest.approx(r["distance"], abs=2e-6)))
    assert got == nearest_brute(vectors, k)


def test_top_k_edges(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [0.0, 0.0]), (8, [1.0]), (9, [float("inf"), 0.0]), (10, [1e9, 1e9]), (11, [1e9, 1e9])]
    df = frame(spark, rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, 2).orderBy("vec_id", "rank").collect():
        got.setdefault(r["vec_id"], []).append((r["neighbour_id"], r["distance"]))
    assert got[1] == [(3, 0.0), (2, 5.0)] and got[2] == [(1, 5.0), (3, 5.0)] and got[10][0] == (11, 0.0) and set(got) == {1, 2, 3, 10, 11}
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.filter("vec_id = 2")).count() == 0
    with pytest.raises(ValueError):
        topk.top_k(df, 0)


# chats


def test_chats(spark):
    rows = [(1, 1, "assistant", "Hi <|im_end|> <\\|im_start|> there"), (1, 0, "user", "Hello"), (1, 0, "user", "Hello"), (2, 0, "assistant", None), (2, 1, None, ""), (None, 0, "user", "lost"), (3, None, "assistant", "b"), (3, None, "assistant", "a"), (4, 0, "user", "word " * 40_000)]
    got = {r["conv_id"]: r for r in chat.format_chats(frame(spark, rows, "conv_id long, turn long, role string, text string")).collect()}
    enc = chat.encoding(chat.default_ranks())
    start, end = enc.encode_single_token(chat.START), enc.encode_single_token(chat.END)
    assert set(got) == {1, 2, 3, 4} and got[1]["n_turns"] == 2
    ids, mask = list(got[1]["ids"]), list(got[1]["mask"])
    assert ids.count(start) == 2 and ids.count(end) == 2 and len(ids) == len(mask) == got[1]["n_tokens"] and sum(mask) == got[1]["n_learned"]
    text = enc.decode(ids)
    assert text == "<|im_start|>user\nHello<|im_end|>\n<|im_start|>assistant\nHi <\\|im_end|> <\\\\|im_start|> there<|im_end|>\n"
    learned = [i for i, m in zip(ids, mask) if m]
    assert learned[-1] == end and chat.unescape(enc.decode(learned[:-1])) == rows[0][3]
    assert [i for i, m in zip(got[2]["ids"], got[2]["mask"]) if m] == [end] and enc.decode(list(got[3]["ids"])).index("a<|im_end|>") < enc.decode(list(got[3]["ids"])).index("b<|im_end|>")
    assert got[4]["n_learned"] == 0 and chat.format_chats(frame(spark, rows, "conv_id long, turn long, role string, text string").limit(0)).count() == 0


def test_chats_are_segments_put_together(spark):
    talks = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    enc = chat.encoding(chat.default_ranks())
    start, end, line = enc.encode_single_token(chat.START), enc.encode_single_token(chat.END), enc.encode_ordinary("\n")
    for r in chat.op7_chat(spark, SF).collect():
        ids, mask = [], []
        for _, role, text in sorted(set(talks.pop(r["conv_id"]))):
            head, body = [start, *enc.encode_ordinary(role), *line], enc.encode_ordinary(chat.escape(text))
            ids += head + body + [end, *line]
            mask += [0] * len(head) + [int(role == "assistant")] * (len(body) + 1) + [0] * len(line)
        assert (list(r["ids"]), list(r["mask"])) == (ids, mask)
    assert not talks


def test_escape():
    for t in ("<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>", "<|other|>", "plain <| |>"):
        assert chat.unescape(chat.escape(t)) == t and not re.search(r"<\|im_(start|end)\|>", chat.escape(t))


# HTML


def page(items, extra=""):
    return "<html><head><title>T %d</title><style>p{}</style></head><body><div>Menu</div>%s<ul>%s</ul><p>End</p></body></html>" % (len(items), extra, "".join(f"<li><b>{x}</b></li>" for x in items))


def test_wrappers(spark):
    rows = [(1, "http://A.example/1", page(["x", "y"])), (2, "https://u@a.example:80/2", page(["z"], "<h2>Note &amp; more</h2>")), (3, "http://a.example/3", page(["q", "r", "s"])), (4, "http://b.example/", "<p>only one</p>"), (5, "not a url", "text <i>here"), (6, None, None), (7, "http://a.example/7", ""), (None, "http://a.example/1", page(["x", "y"])), (8, "http://c.example", "<p>é</p>" * 3000), (9, "http://a.example/9", page(["x"])[:90])]
    got = {r["page_id"]: r for r in wrappers.extract(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and got[1]["text"] == "x\ny" and got[1]["title"] == "T 2" and got[2]["text"] == "Note & more\nz" and got[3]["text"] == "q\nr\ns"
    assert got[None]["text"] == "x\ny" and got[4]["text"] == "only one" and got[5]["text"] == "text\nhere" and got[6]["text"] is None and got[7]["text"] == "" and got[8]["n_slots"] == 3000
    assert wrappers.extract(frame(spark, rows, "page_id long, url string, html string").limit(0)).count() == 0


def card(k, price, tail="", depth=15):
    """An item of 30 different tags and more: name, label, price, label of a link."""
    return f"<li><h3>{k}</h3><em>Price</em><i>{price}</i>" + "".join(f"<t{d}>" for d in range(depth)) + "<a>Read more</a>" + "".join(f"</t{d}>" for d in reversed(range(depth))) + tail + "</li>"


def test_long_items_are_repeated_groups(spark):
    counts = [1, 2, 3, 7, 1]
    rows = [(i, f"http://a.example/{i}", f"<title>T{i}</title><h1>Shop</h1><ul>" + "".join(card(f"n{i}.{k}", f"{i}{k}0") for k in range(n)) + "</ul><p>End</p>") for i, n in enumerate(counts)]
    # items of items, the outer ones with a label and inner ones in other numbers
    rows += [(10 + i, f"http://b.example/{i}", "".join(f"<section><h2>s{i}.{j}</h2><b>Section</b>" + "".join(f"<u{d}></u{d}>" for d in range(15)) + "".join(card(f"m{i}.{j}.{k}", f"{i}{j}{k}") for k in range(1 + (i + j) % 3)) + "</section>" for j in range(1 + i % 3))) for i in range(4)]
    got = {r["page_id"]: r for r in wrappers.extract(frame(spark, rows, "page_id long, url string, html string")).collect()}
    for i, n in enumerate(counts):
        assert (got[i]["title"], got[i]["links"], got[i]["n_slots"]) == (f"T{i}", [], 2 * n + 1)
        assert got[i]["text"].split("\n") == [x for k in range(n) for x in (f"n{i}.{k}", f"{i}{k}0")]
    for i in range(4):
        assert got[10 + i]["text"].split("\n") == [x for j in range(1 + i % 3) for x in [f"s{i}.{j}"] + [y for k in range(1 + (i + j) % 3) for y in (f"m{i}.{j}.{k}", f"{i}{j}{k}")]]
        assert got[10 + i]["links"] == []


def test_long_blocks_are_all_tandems():
    rnd = random.Random(13)
    for _ in range(300):
        least = rnd.randrange(1, 6)
        s = "".join("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 12))) * rnd.choice([1, 1, 2, 3]) for _ in range(rnd.randrange(1, 8)))
        runs = []
        for p in range(least, len(s) // 2 + 1):
            same = [i + p < len(s) and s[i] == s[i + p] for i in range(len(s))]
            runs += [(p, m.start(), m.end() + p) for m in re.finditer("1{%d,}" % p, "".join("01"[x] for x in same))]
        held, out = set(), []
        for p, a, b in sorted(runs):
            if not held & set(range(a, b)):
                held |= set(range(a, b))
                out.append(s[a : a + p])
        assert wrappers.long_blocks(s, least) == out
    once = "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))
    assert wrappers.long_blocks(once, 25) == [] and wrappers.long_blocks(once + once, 25) == [once] and wrappers.long_blocks("ab" + once * 3, 25) == [once]


def test_copies_dont_make_template(spark):
    def of(title, script="", box="", table="the article"):
        return f"<title>{title}</title><h1>Site</h1>{box}" + (f"<table>{table}</table>" if table else "") + f"<p>End</p><script>{script}</script>"

    box = "<aside>Subscribe</aside>"
    pages = {
        # copies under another script, and another page that hasn't their group
        "a": [of("A", "1"), of("A", "2"), of("B", table=""), of("C", table="")],
        # a box of the template in one copy
        "b": [of("A", box=box), of("A"), of("B", box=box, table=""), of("C", table="")],
        # only copies
        "c": [of("A", "1"), of("A", "2")],
        # copies with different ads can't be told from two pages of a template, see ``extract``
        "d": [of("A", box="<aside>one</aside>"), of("A", box="<aside>two</aside>")],
    }
    rows = [(100 * k + i, f"http://{host}.example/{i}", x) for k, (host, held) in enumerate(pages.items()) for i, x in enumerate(held)]
    got = {r["page_id"]: (r["title"], r["text"]) for r in wrappers.extract(frame(spark, rows, "page_id long, url string, html string")).collect()}
    for k in (0, 100):
        assert [got[k + i] for i in range(4)] == [("A", "the article"), ("A", "the article"), ("B", ""), ("C", "")]
    assert got[200] == got[201] == ("A", "Site\nthe article\nEnd")
    assert got[300] == ("", "one") and got[301] == ("", "two")


def as_regex(sequences):
    """The wrapper as Python's regular expression over its tags, one letter each; closing tags may be missing."""
    tag = {}

    def letter(name):
        return tag.setdefault(name, chr(0x100 + len(tag)))

    def of(number):
        out = ""
        for name, optional, repeated, child in sequences[number][0]:
            inner = of(child) if child >= 0 else ""
            one = inner if name[:1] == "(" else letter(name) + inner + f"{letter('/' + name)}?"
            one = f"(?:{one})+" if repeated else one
            out += f"(?:{one})?" if optional else one
        return out

    return re.compile(of(0)), letter


def test_every_page_is_accepted(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(wrappers.host_of(F.col("url")).alias("host"), "html")
    made = {r["host"]: wrappers.Wrapper(r["wrapper"]) for r in wrappers.wrappers(pages).collect()}
    for r in pages.collect():
        tags, _ = wrappers.tokens(r["html"])
        w = made[r["host"]]
        assert wrappers.tag_names(r["html"]) == tags
        assert sorted(i for _, i in w.slots(tags)) == list(range(len(tags)))
        pattern, letter = as_regex(w.sequences)
        assert pattern.fullmatch("".join(map(letter, tags))), str(w)


def test_random_streams_are_accepted():
    rnd = random.Random(11)
    for n in range(400):
        names = ["a", "b", "c", "/a", "/b"][: 3 if n % 2 else 5]
        streams = [["", *[rnd.choice(names) for _ in range(rnd.randrange(0, 25))]] for _ in range(rnd.randrange(1, 9))]
        shapes = [wrappers.shape_of(s)[0] for s in streams]
        text = wrappers.infer(shapes)
        assert wrappers.infer(rnd.sample(shapes, len(shapes)) + shapes[:1]) == text
        w = wrappers.Wrapper(text)
        tag_of = {}
        for s in streams:
            slots = w.slots(s)
            assert slots is not None and [i for _, i in slots] == list(range(len(s)))
            for slot, i in slots:
                assert tag_of.setdefault(slot, s[i]) == s[i]


def test_mismatches_become_optional_and_repeated():
    def wrapper(*pages):
        return str(wrappers.Wrapper(wrappers.infer(wrappers.shape_of(wrappers.tag_names(p))[0] for p in pages)))

    # items of which one lacks a part
    assert wrapper("<ul><li><b>1</b><i>x</i></li><li><b>2</b></li><li><b>3</b><i>y</i></li></ul>") == "<><ul>(<li><b>(<i>)?</li>)+</ul>"
    # a single item in one page, several in another
    assert wrapper("<ul><li>1</li></ul>", "<ul><li>1</li><li>2</li></ul>") == "<><ul>(<li>)+</ul>"
    # groups of several tags, one of them repeated in its turn
    assert wrapper("<dl><dt>a</dt><dd>b</dd></dl>", "<dl><dt>a</dt><dd>b</dd><dd>c</dd><dt>d</dt><dd>e</dd></dl>") == "<><dl>(<dt>(<dd>)+)+</dl>"
    # parts that pages lack
    assert wrapper("<h1>a</h1><p>b</p>", "<p>b</p><hr>", "<h1>a</h1><p>b</p><hr>") == "<>(<h1>)?<p>(<hr>)?"
    # a repeated group with an optional part on the same level
    assert wrapper("<h2>a</h2><p>b</p><ul></ul><h2>a</h2><p>b</p><h2>a</h2><p>b</p><ul></ul>") == "<>((<h2><p>)+<ul>)+"


@pytest.mark.parametrize("limit", [1 << 29, 4])
def test_common_is_a_longest_common_subsequence(limit):
    rnd = random.Random(5)
    for _ in range(200):
        x, y = ([rnd.choice("abcd") for _ in range(rnd.randrange(0, 20))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, c in enumerate(x):
            for j, d in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if c == d else max(best[i][j + 1], best[i + 1][j])
        pairs = wrappers.common(x, y, limit)
        assert len(pairs) == best[-1][-1] and all(x[i] == y[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))


def test_very_long_pages_are_aligned_in_seconds(spark):
    import time

    rnd = random.Random(1)
    began = time.perf_counter()
    words = [f"x{i}" for i in range(50)]
    flat = ["".join(f"<{rnd.choice(words)}>t" for _ in range(20_000)) for _ in range(2)]
    deep = "<div>" * 10_000 + "x" + "</div>" * 10_000
    stray = "<p>" * 10_000 + "</q>" * 10_000
    rows = [(i, "http://a.example/", x) for i, x in enumerate([*flat, deep, stray])]
    got = {r["page_id"]: r for r in wrappers.extract(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert got[0]["text"] == "\n".join(["t"] * 20_000) and got[2]["text"] == "x"
    assert time.perf_counter() - began < 60


def test_partitions_and_parts_make_no_difference(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet").select(wrappers.host_of(F.col("url")).alias("host"), "html")
    made = [{tuple(r) for r in wrappers.wrappers(x).collect()} for x in (df.coalesce(1), df.repartition(7, "html"), df.orderBy(F.col("html").desc()).coalesce(1))]
    assert made[0] == made[1] == made[2]
    # few shapes to a task: pages are still accepted, or content as a whole
    whole = {r["host"]: r["wrapper"] for r in wrappers.wrappers(df, 3).collect()}
    assert set(whole) == {r[0] for r in made[0]}
    accepted = [wrappers.Wrapper(whole[r["host"]]).slots(wrappers.tag_names(r["html"])) is not None for r in df.collect()]
    assert sum(accepted) > 0.9 * len(accepted)


def test_tokens():
    tags, texts = wrappers.tokens("a<!-- <p> --><script>if (a<b) '</p>'</script> b<P class='x'> c &lt; \n d<br/>e</p")
    assert tags == ["", "p", "br"] and texts == ["a b", "c < d", "e</p"]


# WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, None, ""), (3, "http://a/ 3", None), (None, "x", "y"), (4, "http://b", "z" * 500_000), (4, "http://b", "z" * 500_000)]
    files = warc.write_files(frame(spark, rows, "page_id long, url string, html string"), f"file://{tmp_path}/w", 1000)
    held = files.collect()
    assert sum(r["records"] for r in held) == 5
    index = warc.index(spark.createDataFrame(held))
    assert index.count() == 5 and index.filter("url IS NULL").count() == 1
    got = sorted((r["record_id"], r["url"] or "", r["payload"], r["digest_ok"]) for r in warc.read_records(index).collect())
    assert [(a, b, len(c), d) for a, b, c, d in got] == [("urn:page:", "x", 1, True), ("urn:page:1", "http://a/1", 8, True), ("urn:page:2", "", 0, True), ("urn:page:4", "http://b", 500_000, True), ("urn:page:4", "http://b", 500_000, True)]
    some = warc.read_records(index.filter("url = 'http://a/1'")).collect()
    assert len(some) == 1 and some[0]["payload"] == "<p>é</p>"
    assert warc.index(spark.createDataFrame(held).limit(0)).count() == 0 and warc.read_records(index.limit(0)).count() == 0


def test_plain_and_broken_warc(spark, tmp_path):
    raw = warc.record_bytes("a", "http://x", b"one") + warc.record_bytes("b", "http://y", b"two" * 1_000_000) + warc.record_bytes("c", "http://z", b"")
    (tmp_path / "p.warc").write_bytes(raw)
    index = warc.index(spark.createDataFrame([(f"file://{tmp_path}/p.warc",)], "file string"))
    assert [len(r["payload"]) for r in warc.read_records(index).orderBy("offset").collect()] == [3, 3_000_000, 0]


def records(spark, path):
    index = warc.index(spark.createDataFrame([(f"file://{path}",), (f"file://{path}",), (None,)], "file string"))
    got = warc.read_records(index).orderBy("offset").collect()
    sizes = [(r["offset"], r["length"]) for r in got]
    assert [a + n for a, n in sizes[:-1]] == [a for a, _ in sizes[1:]] and sizes[0][0] == 0 and sum(sizes[-1]) == path.stat().st_size
    return [(r["record_id"], r["payload"], r["digest_ok"]) if r["problem"] is None else None for r in got]


def test_records_that_cant_be_read(spark, tmp_path):
    rows = [warc.record_bytes(x, f"http://{x}", x.encode() * 3000) for x in "abcdef"]
    good = lambda x: (x, x * 3000, True)
    packed = [warc._member(r) for r in rows]
    hurt = bytearray(packed[1])
    hurt[40:60] = b"\0" * 20
    (tmp_path / "p.warc.gz").write_bytes(packed[0] + bytes(hurt) + packed[2] + packed[3][:30] + packed[4] + packed[5][:-5])
    assert records(spark, tmp_path / "p.warc.gz") == [good("a"), None, good("c"), None, good("e"), None]
    (tmp_path / "q.warc").write_bytes(rows[0] + rows[1].replace(b"Content-Length: 3", b"Content-Length: x") + rows[2] + rows[3][200:] + rows[4] + rows[5][:-100])
    assert records(spark, tmp_path / "q.warc")[0] == good("a") and records(spark, tmp_path / "q.warc")[2] == good("c")
    assert good("e") in records(spark, tmp_path / "q.warc") and records(spark, tmp_path / "q.warc")[-1] is None
    (tmp_path / "r.warc.gz").write_bytes(warc._member(b"no record at all") + packed[0])
    assert records(spark, tmp_path / "r.warc.gz") == [None, good("a")]
    (tmp_path / "s.warc").write_bytes(b"")
    assert warc.index(spark.createDataFrame([(f"file://{tmp_path}/s.warc",)], "file string")).count() == 0


def test_encodings_and_missing_digests(spark, tmp_path):
    import gzip

    def record(http, body, digest):
        block = b"HTTP/1.1 200 OK\r\n" + http + b"\r\n" + body
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Target-URI: http://x\r\n{digest}Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    packed = gzip.compress(b"packed text")
    chunks = b"%x\r\n%s\r\n%x;a=b\r\n%s\r\n0\r\n\r\n" % (5, packed[:5], len(packed) - 5, packed[5:])
    rows = [record(b"Content-Encoding: gzip\r\n", packed, ""), record(b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n", chunks, f"WARC-Payload-Digest: {warc._digest(packed)}\r\n"), record(b"Content-Encoding: br\r\n", b"as it is", "WARC-Payload-Digest: md5:x\r\n"), record(b"", b"other", f"WARC-Payload-Digest: {warc._digest(b'x')}\r\n")]
    (tmp_path / "e.warc").write_bytes(b"".join(rows))
    assert [r[1:] for r in records(spark, tmp_path / "e.warc")] == [("packed text", True), ("packed text", True), ("as it is", None), ("other", False)]
    index = warc.index(spark.createDataFrame([(f"file://{tmp_path}/e.warc",)], "file string")).orderBy("offset")
    assert index.first()["digest"] == warc._digest(packed)



def test_ranges_are_coalesced():
    assert warc.coalesce([(0, 10), (10, 10), (25, 5), (100, 10)], gap=5, most=1000) == [(0, 30, 0, 3), (100, 10, 3, 4)]
    assert warc.coalesce([(0, 10), (10, 10)], gap=5, most=15) == [(0, 10, 0, 1), (10, 10, 1, 2)]
    assert warc.coalesce([(0, 100)], most=10) == [(0, 100, 0, 1)] and warc.coalesce([]) == []
