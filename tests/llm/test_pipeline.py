"""The registered queries and the pipeline over whole tables, against SQL or brute force."""

import random
from urllib.parse import urlsplit

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from quillrank.llm import langid, linededup, pieces, queries, wrappers, wumanber
from test_dedup import lines_brute, links_brute, simhash_brute
from test_text import card, contamination_brute, phrases_brute

SF = "/root/testdata/sf0.001"


def tidy(v):
    return tuple(map(tidy, v)) if isinstance(v, (list, tuple)) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr(tidy([r[c] for c in columns])) for r in df.collect()) == sorted(repr(tidy(r)) for r in found.fetchall())


def test_op10_keeps_null_pages_and_blanks_in_urls(spark, tmp_path):
    rows = [(1, "http://a/b c\td", "<p>x</p>"), (2, "http://a/%20 ", "é"), (3, "http://a/ b", None), (4, None, None), (5, None, ""), (6, "\u00a0http://a/ü%2", "y"), (7, "http://a/%41", "z"), (None, "http://a\r\nX: y", None), (-8, "http://a", "x"), (None, None, "no id")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(queries.ORACLE_SQL["op10_warc"])
    columns = [d[0] for d in found.description]
    got = queries.QUERIES["op10_warc"](spark, str(tmp_path)).select(columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, found.fetchall())) and len(got) == len(rows)


def phrases_fast(text, held):
    """As ``phrases_brute``, with the length of each match by halving."""
    n = at = 0
    while at < len(text):
        low, high = 0, min(16, len(text) - at)
        while high < len(text) - at and text[at : at + high] in held:
            low, high = high, min(2 * high, len(text) - at)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if text[at : at + mid] in held else (low, mid - 1)
        at += max(1, low)
        n += 1
    return n


def judged_brute(model, labelled, text):
    """(best language, accepted) of one text."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    clean, _ = langid.normalise(raw, np.array([0, len(raw)]))
    clean = clean.tobytes()
    if not clean:
        return None, False
    best = None
    for k, size in zip(model.languages, model.log_size):
        n = phrases_fast(clean, labelled[k])
        if best is None or n * size / len(clean) < best[0]:
            best = n * size / len(clean), k, (n - 1) * size
    return best[1], best[2] <= langid.MAX_BITS * len(clean)


def test_op1_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labelled = langid.labelled_text(docs)
    model = langid.train(labelled)
    got = {r["doc_id"]: (r["guess"], r["accepted"]) for r in queries.QUERIES["op1_language_id"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(got) == set(texts) and max(map(len, texts.values())) > 2 * langid.BLOCK
    assert got == {i: judged_brute(model, labelled, t) for i, t in texts.items()}


@pytest.mark.parametrize("block", [3, 7, 64, 4096])
def test_op1_counts_dont_depend_on_blocks(spark, monkeypatch, block):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labelled = langid.labelled_text(docs)
    model = langid.train(labelled)
    whole = "".join(" ".join(r["text"] for r in docs.orderBy("doc_id").limit(60).collect()).split("\n")).lower().encode()
    whole = langid.normalise(np.frombuffer(whole, np.uint8), np.array([0, len(whole)]))[0].tobytes()
    sizes = [block - 1, block, block + 1, 2 * block, 2 * block + 1, 3 * block + 100, 50, 0, 700]
    texts = [whole[a : a + n] for a, n in zip(range(0, 9000, 1000), sizes)]
    texts += [labelled["en"][100:6000], labelled["de"][:50] * 20, labelled["en"][5:5000] + labelled["fr"][:5000], b"\xff" * 300, b"a" * 1000]
    offsets = np.cumsum([0, *map(len, texts)])
    monkeypatch.setattr(langid, "BLOCK", block)
    counts = langid.phrases(model, np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert [phrases_fast(x, labelled["en"]) for x in texts[6:9]] == [phrases_brute(x, labelled["en"]) for x in texts[6:9]]
    assert counts.tolist() == [[phrases_fast(x, labelled[k]) for k in model.languages] for x in texts]


def test_op1_many_labels(spark):
    rows = [(i, "the same prose in one language " * 3, f"x{i}") for i in range(langid.MAX_LANGUAGES + 20)] + [(900, "the prose in one language", "x1"), (901, "more of the prose", None)]
    out = langid.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=200)
    assert out.count() == len(rows) and out.filter("accepted").count() == len(rows)


def test_op1_tables_of_many_cells(spark, monkeypatch):
    texts = {"a": b"one two three ", "b": b"eins zwei drei "}
    data = np.frombuffer(b"one zwei three drei x", np.uint8)
    small = langid.train(texts)
    monkeypatch.setattr(langid, "_SMALL_CELLS", 100)
    large = langid.train(texts)
    assert (small.cells.dtype, large.cells.dtype, large.roots.dtype) == (np.int32, np.int64, np.int64)
    assert langid.phrases(small, data, np.array([0, 9, 21])).tolist() == langid.phrases(large, data, np.array([0, 9, 21])).tolist()


def test_op2_is_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in queries.QUERIES["op2_sentencepiece"](spark, SF).collect()}
    assert got == {i: sp.encode(t) for i, t in texts.items()}


def test_op3_is_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op3_simhash"](spark, SF).collect()
    root, links = simhash_brute(texts), links_brute(texts)
    assert len(rows) == len({r["doc_id"] for r in rows})
    assert {r["doc_id"]: r["class_id"] for r in rows} == root | {i: i for i in root.values()}
    assert {r["doc_id"]: r["n_links"] for r in rows} == {r["doc_id"]: links[r["doc_id"]] for r in rows}


def test_op8_gives_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = queries.QUERIES["op8_html"](spark, SF)
    assert got.count() == pages.count() and got.filter("text = '' OR text IS NULL").count() == 0


def html_plain(pages):
    """{page_id: (title, text, links, n_slots)} of (page_id, url, html): groups, alignment and acceptance of ``wrappers`` without Spark, and template by counting pages."""
    hosts = {}
    for i, url, page in pages:
        hosts.setdefault(urlsplit(url or "").hostname or "", []).append((i, *wrappers.tokens(page)))
    out = {}
    for held in hosts.values():
        w = wrappers.Wrapper(wrappers.infer(wrappers.shape_of(tags)[0] for _, tags, _ in held))
        parsed = [(i, [(slot, tags[k], texts[k]) for slot, k in w.slots(tags)]) for i, tags, texts in held]
        assert all(len(x) == len(tags) for (_, x), (_, tags, _) in zip(parsed, held))

        def template(slots, content):
            kept = set()
            for slot in slots:
                having = [x for _, x in parsed if any(s == slot for s, _, _ in x)]
                if len({t for x in having for s, _, t in x if s == slot}) == 1 and len(set(map(content, having))) > 1:
                    kept.add(slot)
            return kept

        every = {s for _, x in parsed for s, _, _ in x}
        likely = template(every, lambda x: tuple(t for _, _, t in x if t))
        fixed = set() if likely == every else template(likely, lambda x: tuple(t for s, _, t in x if t and s not in likely))
        for i, x in parsed:
            got = [(tag, t) for s, tag, t in x if t and s not in fixed]
            out[i] = " ".join(t for tag, t in got if tag == "title"), "\n".join(t for tag, t in got if tag not in ("title", "a")), [t for tag, t in got if tag == "a"], len(got)
    return out


def test_op8_is_plain_python(spark):
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    box = "<aside>Subscribe</aside>"
    made = [(i, f"http://a.example/{i}", f"<title>T{i}</title><h1>Shop</h1>{box if i % 2 else ''}<ul>" + "".join(card(f"n{i}.{k}", f"{i}{k}0") for k in range(1 + i % 4)) + f"</ul>{'<h2>Note</h2>' if i % 3 else ''}<p>End</p>") for i in range(8)]
    made += [(20 + i, "http://a.example/c", made[i % 2][2] + "<table>of copies</table><script>%d</script>" % i) for i in range(4)]
    for rows in (real, made):
        got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
        assert {r["page_id"]: (r["title"], r["text"], list(r["links"]), r["n_slots"]) for r in got.collect()} == html_plain(rows)
    got = queries.QUERIES["op8_html"](spark, SF)
    assert {r["page_id"]: (r["title"], r["text"], list(r["links"]), r["n_slots"]) for r in got.collect()} == html_plain(real)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with documents of every kind that the stages look for, and a benchmark."""
    rnd = random.Random(12)
    words = {"en": "the of and to in is was for on that with as at by from this have not are be".split(), "de": "der die und das nicht ein ist mit auf von sich dem werden eine auch wird bei nach aus noch".split()}
    def prose(lang, n):
        return " ".join(rnd.choice(words[lang]) + rnd.choice(["", "", "er", "ing" if lang == "en" else "ung"]) + str(rnd.randrange(300)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))

    items = [(i, prose("en", 20)) for i in range(4)]
    rows = []
    for i in range(60):
        lang = rnd.choice(["en", "de"])
        rows.append((i, "\n".join(prose(lang, 40) for _ in range(4)), lang, f"s{i % 3}"))
    for i in range(60, 90):  # near copies
        base = rows[rnd.randrange(20)]
        w = base[1].split(" ")
        w[rnd.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), base[2], "s9"))
    rows += [(i, prose("en", 60) + "\nA line  that all have\n" + prose("en", 30), "en", "s1") for i in range(90, 110)]
    rows += [(110 + i, prose("en", 30) + " " + t.upper() + " " + prose("en", 30), "en", "s2") for i, t in items]
    rows += [(120, None, "en", None), (121, "", None, "s1"), (122, "12 34 !!", None, "s1"), (123, "ωψξ жщю 漢字 かな " * 60, None, "s1"), (124, "a line that all have", "en", "s1"), (125, rows[3][1], rows[3][2], "s2")]
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("line_hashes", F.lit(1))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_is_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    now = {r["doc_id"]: r["text"] for r in docs.collect()}
    labelled = langid.labelled_text(docs)
    model = langid.train(labelled)
    guess = {i: judged_brute(model, labelled, t)[0] for i, t in now.items() if t is not None}
    now = {i: t for i, t in now.items() if t is not None and judged_brute(model, labelled, t)[1]}
    assert set(range(114)) <= set(now) and not {120, 121, 122, 123} & set(now)
    now = {i: t for i, t, _ in lines_brute(list(now.items()), linededup.MAX_DOCS, True) if t.strip()}
    assert 124 not in now
    gone = simhash_brute(now)
    assert len(gone) >= 25 and gone[125] == 3
    now = {i: t for i, t in now.items() if i not in gone}
    dirty = {d for d, _, _ in contamination_brute(list(now.items()), items, wumanber.N_WORDS)}
    assert dirty == {110, 111, 112, 113}
    now = {i: t for i, t in now.items() if i not in dirty}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    out = corpus_pipeline.run(spark, small)
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: r["text"] for i, r in got.items()} == now
    assert {i: r["lang"] for i, r in got.items()} == {i: guess[i] for i in now}
    assert all(list(r["ids"]) == sp.encode(r["text"]) and r["round_trip"] and r["n_chars"] == len(r["text"]) for r in got.values())
    assert out.columns == [*docs.columns, "ids", "n_tokens", "round_trip"]


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.simpleString() == docs.schema.simpleString() and out.count() > 0.7 * docs.count()
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0 and empty.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
