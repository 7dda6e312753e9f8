"""Cases in which an operator once did less than its whole job."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, backoff, chat, html_text, mixing, suffix
from tests.llm.test_order import brute_nearest


def test_copies_of_a_vector_find_each_other(spark):
    rng = np.random.default_rng(11)
    hot = rng.standard_normal(64).astype(np.float32)
    x = np.concatenate([np.tile(hot, (500, 1)), rng.standard_normal((1000, 64)).astype(np.float32)]).astype(np.float64)
    ids = rng.permutation(len(x)).astype(np.int64)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    want, got = brute_nearest(ids, x, 10, 20), {}
    for r in sorted(ann.nearest(df, every=20).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert {q: len(v) for q, v in got.items()} == {q: 10 for q in want}
    copies = {int(i) for i in ids[:500] if i % 20 == 0}
    assert len(copies) > 10 and all(got[q] == want[q] for q in copies)


def test_block_with_few_collisions_is_verified_whole():
    x = np.random.default_rng(12).standard_normal((1000, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    q = np.full(64, 1e-6)
    d, i = ann.Block(np.arange(1000), x).search(-1, q, float(ann.distances(x, q).max()), 1000)
    assert sorted(i.tolist()) == list(range(1000)) and (np.diff(d) >= 0).all()


def test_mix_of_more_sources_than_a_period_has_slots(spark):
    df = spark.range(12000).selectExpr("id AS doc_id", "concat('h', id % 5000) AS source")
    out = mixing.mix_sources(df, block_rows=1).toPandas()
    assert len(out) == 12000 and out["_m_position"].is_unique and out["doc_id"].is_unique
    assert ((out["_m_release"] <= out["_m_slot"]) & (out["_m_slot"] < out["_m_deadline"])).all()
    weight = out.groupby("source").size() ** 0.5
    weight /= weight.sum()
    w = out["source"].map(weight)
    assert (out["_m_block"] - w * out["_m_slot"]).abs().max() < 1 + 1e-9
    assert (out["_m_block"] + 1 - w * (out["_m_slot"] + 1)).abs().max() < 1 + 1e-9


def test_mix_meets_given_weights_over_a_long_mix(spark):
    weights = {"a": Fraction(1, 3), "b": Fraction(1, 7), "c": 0.0003, "d": Fraction(1) - Fraction(1, 3) - Fraction(1, 7) - Fraction(3, 10000)}
    df = spark.range(44000).selectExpr("id AS doc_id", "element_at(array('a', 'b', 'c', 'd'), cast(id % 4 + 1 AS int)) AS source")
    df = df.unionAll(spark.range(44000, 44050).selectExpr("id", "'unweighted'"))
    out = mixing.mix_sources(df, weights, block_rows=1).toPandas().sort_values("_m_position")
    assert len(out) == 44050 and out["_m_position"].is_unique
    assert (out["source"].iloc[-50:] == "unweighted").all()
    head = out[out["_m_slot"] < 20000]
    assert len(head) == 20000
    t = np.arange(1, 20001)
    for name, w in weights.items():
        assert np.abs((head["source"] == name).cumsum().to_numpy() - float(w) * t).max() < 1


def test_backoff_tells_words_apart_whose_names_begin_alike(spark):
    words = [f"w{k}" for k in range(60000)]
    name = backoff.Grams(pa.array(words)).names[0]
    head = name >> np.uint64(39)
    order = np.argsort(head, kind="stable")
    at = np.flatnonzero(head[order][1:] == head[order][:-1])[0]
    pair = [words[k] for k in order[at : at + 2]]
    assert pair[0] != pair[1]
    out = backoff.backoff_scores(spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")).collect()
    # neither word occurs in the other document
    assert [r["log_score"] for r in out] == [-0.6931, -0.6931]


def test_backoff_stays_finite_where_names_clash():
    text = pa.array(["a b c", "d e f"])
    grams = backoff.Grams(text)
    names, counts = backoff.distinct(*grams.names[:2])
    none = np.zeros(0, np.uint64)
    # the pair b c is counted as if another one had its name
    totals = counts + 5 * (names == grams.names[1][1])
    _, clash = backoff.score_block(text, totals.astype(np.uint64), none, 6)
    _, clear = backoff.score_block(text, counts.astype(np.uint64), none, 6)
    assert np.isfinite(clash).all() and (clash == clear).all()


def test_backoff_asks_only_for_likely_triples(spark):
    rows = [(1, "a b c d"), (2, "x b c y"), (3, "q r s"), (4, "a b z c d"), (4, "a b z c d"), (None, "a b z c d"), (None, None), (None, None)]
    grams = backoff.Grams(pa.array([t for _, t in rows]))
    names, counts = backoff.distinct(*grams.names[:2])
    pairs = backoff.words_and_pairs(grams, len(rows), counts.astype(np.uint64))[1]
    likely = grams.likely(pairs)
    # b c d and a b c of the first document, and all triples of the three copies
    assert len(likely) == 2 + 3 * 3 and grams.doc[grams.at[2][likely]].tolist() == [0, 0, 3, 3, 3, 4, 4, 4, 5, 5, 5]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1, 40, 1 << 20):
        out = backoff.backoff_scores(df, block_bytes=size, part_bytes=size).collect()
        assert len(out) == len(rows)
        got = sorted((str(r["doc_id"]), r["n_words"], r["log_score"]) for r in out)
        assert size == 1 or got == last
        last = got


def test_copies_of_a_page_keep_their_text(spark):
    page = "<html><body><div>Top line</div><p>{}</p><p>{}</p><div>Bottom line</div></body></html>"
    story = "A long story that is told in many words and fills the page " * 5
    rows = [(k, f"http://h/a?print={k}", page.format(story, "the end")) for k in range(3)]
    rows += [(3, "http://h/b", page.format("Something else altogether", "fin")), (4, "http://n/1", page.format(story, "read 1 time")),
             (5, "http://n/2", page.format(story, "read 2 times")), (6, "http://n/3", page.format("Other", "things"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    text = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    story = story.strip()
    assert [text[k] for k in range(3)] == [f"{story}\n\nthe end"] * 3
    assert text[3] == "Something else altogether\n\nfin" and text[5] == f"{story}\n\nread 2 times"
    assert story in text[4]


def main_lines(page):
    return [t for m, t in html_text.lines(page) if m == html_text.ARTICLE]


def test_marks_of_wrappers_do_not_empty_a_page():
    body = "<p>First part</p><p>Second part</p>"
    want = ["First part", "Second part"]
    for page in (f'<div class="page no-sidebar"><article>{body}</article></div>', f'<main class="with-sidebar">{body}</main>',
                 f'<article class="post search-result">{body}</article>', f'<div class="content-sidebar-wrap"><article>{body}</article></div>',
                 f'<div class="social"><div><article>{body}</article></div></div>', f'<div id="promo"><p>Buy</p><main>{body}</main></div>'):
        assert main_lines(page) == want, page
    only = '<div class="sidebar"><p>All there is</p></div>'
    assert [(m, t) for m, t in html_text.lines(only)] == [(html_text.PLAIN, "All there is")]
    assert main_lines('<aside><article><p>Teaser</p></article></aside>') == []


def test_marked_pieces_of_an_article_go_and_its_title_stays():
    page = ('<article><div class="entry-header"><h1 class="page-header">Title</h1></div><p>One <span class="share">Tweet <span>now</span></span>two</p>'
            '<p class="ad">Buy this<p>Three <math><mi>x</mi></math><h2 class="related">More</h2><p>Four</p><ol class="commentlist"><li>Me first</li></ol>'
            '<div id="comments"><article class="comment"><p>Reader</p></article></div><li class="menu-item">Home</li><p>Five</p></article>')
    assert main_lines(page) == ["Title", "One two", "Three x", "Four", "Five"]


def test_pages_with_a_long_menu_and_a_short_body_lose_the_menu(spark):
    menu = "".join(f"<p>Menu entry number {k}</p>" for k in range(30))
    rows = [(k, f"http://h/{k}", f"<html><body>{menu}<p>Own line of page {k}</p></body></html>") for k in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()} == {k: f"Own line of page {k}" for k in range(4)}


def test_alignment_in_bounded_space(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(0, 50)).tolist() for _ in range(2))
        whole = html_text.lcs(a, b)
        with monkeypatch.context() as m:
            m.setattr(html_text, "LCS_CELLS", 20)
            split = html_text.lcs(a, b)
        at = 0
        for k in split:  # a common subsequence, as long as the whole one
            at = b.index(a[k], at) + 1
        assert len(split) == len(whole) and split == sorted(set(split))
    rows = rng.integers(0, 40_000, 60_000).tolist()
    assert len(html_text.lcs(rows, rows[1:] + [1])) == 59_999


def plain_text_of(pages):
    """The query's rule without Spark: markup, else neighbours by path, else menus."""
    read = {p: html_text.lines(h) for p, _, h in pages}
    place = {p: html_text._place(u) for p, u, _ in pages}
    out = {}
    contents = {}
    for p, lines in read.items():
        contents.setdefault((place[p][0], tuple((t, m == html_text.PLAIN) for m, t in lines)), []).append(p)
    order = sorted(contents, key=lambda c: (c[0], min(place[p][1] for p in contents[c])))
    for n, c in enumerate(order):
        host, own = c
        main = [t for m, t in read[contents[c][0]] if m == html_text.ARTICLE]
        if not main:
            mine, gone = [t for t, _ in own], set()
            for other in (order[n - 1:n] if n else []) + order[n + 1:n + 2]:
                if other[0] != host:
                    continue
                theirs = [t for t, _ in other[1]]
                keep = html_text.lcs(mine, theirs)
                chars = [sum(len(t) for t, plain in x if plain) for x in (own, other[1])]
                near = max(chars) and sum(len(mine[k]) for k in keep if own[k][1]) >= html_text.NEAR * max(chars)
                pages_with = lambda t: sum(1 for d in order if d[0] == host and t in [x for x, _ in d[1]])
                gone |= {k for k in keep if not near or (len(mine[k]) if own[k][1] else 0) < html_text.SHORT and pages_with(mine[k]) >= html_text.TEMPLATE_PAGES}
            main = [t for k, (t, plain) in enumerate(own) if plain and k not in gone]
        for p in contents[c]:
            out[p] = "\n\n".join(main)
    return out


def test_query_equals_a_plain_version(spark):
    rng = np.random.default_rng(8)
    shared = [f"<div>{' '.join(['shared', 'line'] * int(n))} {k}</div>" for k, n in enumerate(rng.integers(1, 30, 12))]
    rows = []
    for k in range(80):
        parts = [shared[j] for j in sorted(rng.integers(0, 12, rng.integers(0, 9)))] + [f"<p>own {k} {j}</p>" for j in range(rng.integers(0, 3))]
        kind = rng.integers(0, 8)
        parts = parts + ["<nav><a>Menu</a></nav>"] if kind == 0 else ["<article>", *parts, "</article>"] if kind == 1 else parts
        rows.append((k, [f"http://h{k % 3}/p/{k // 3:02d}", None, "::bad::["][0 if k % 11 else 1 + k % 2], None if k == 17 else "".join(parts)))
    # distinct paths: ties of paths would be settled by a hash
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    want = plain_text_of(rows)
    named = [k for k, u, _ in rows if u and u.startswith("http")]
    assert [got[k] for k in named] == [want[k] for k in named] and len(got) == 80


def test_neighbours_decide_pages_with_articles_too(spark):
    own = "Page {} tells a story of its own in many words that no other page of the host has, for it is number {}"
    rows, want = [], {}

    def put(host, k, body, *text):
        rows.append((len(rows), f"http://{host}/a/{k}", f"<nav><a>Menu {k}</a></nav>{body}"))
        want[len(rows) - 1] = "\n\n".join(text)

    for k in range(7):  # a notice inside the article goes, a line that only two articles share stays
        put("notice", k, f"<article><h1>{own.format(k, k)}</h1>{'<p>Twice</p>' if k in (2, 3) else ''}<p>Subscribe to our letter</p></article>",
            own.format(k, k), *["Twice"] * (k in (2, 3)))
    for k in range(5):  # the article element is the same advert everywhere, the text lies beside it
        put("advert", k, f"<article><p>Join our club</p></article><div>{own.format(k, k)}</div><div>All rights reserved</div>", own.format(k, k))
    for k in range(5):  # versions of an article, and the same article under other menus
        put("versions", k, f"<article><p>{own.format('x', 'y')}</p><p>Read {k} times</p></article>", own.format("x", "y"), f"Read {k} times")
        put("same", k, "<article><p>Not found</p></article>", "Not found")
    for k in range(6):  # what a neighbour has in its menu only is no notice
        put("menu", k, f"<article><p>{own.format(k, k)}</p><p>Home</p></article>" if k % 2 else f"<div class='ad'>Home</div><article><p>{own.format(k, k)}</p></article>",
            own.format(k, k), *["Home"] * (k % 2))
    for k in range(3):  # too few pages to tell
        put("few", k, f"<article><p>{own.format(k, k)}</p><p>Subscribe to our letter</p></article>", own.format(k, k), "Subscribe to our letter")
    df = spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string").repartition(4)
    got = html_text.main_text(df).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and len(got) == len(rows) + 3


def test_pages_told_apart_by_query_are_neighbours(spark):
    rows = [(k, f"http://h/index?id={k + 10}", f"<p>Section {k // 2}</p><p>Own line of page {k}</p>") for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()} == {k: f"Own line of page {k}" for k in range(20)}
    paths = ["http://h/a", "http://h/a?x=1", "http://h/a-b", "http://h/a/b", "http://h/a0"]
    assert sorted(paths, key=html_text._place) == paths


def test_copies_of_a_row_are_cut_once(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randrange(900)}" for _ in range(70))
    body = " ".join(f"w{k}" for k in range(200)) + " " + passage
    table = [(1, body)] * 10_000 + [(2, "other start " + passage + " other end"), (3, "alone " * 3)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(8)
    found = suffix.repeats(suffix._keyed(df, "doc_id", "text").select("key", "text"))
    # what a row has found does not grow with its copies
    assert found.agg(F.max(F.size("found"))).first()[0] < 200
    out = suffix.suffix_dedup(df).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], r["count"]) for r in out} == {
        1: (len(body), 1, 10_000), 2: (len(passage) + 1, 1, 1), 3: (0, 0, 1)}


def test_rows_of_an_id_go_only_for_rows_with_their_words(spark):
    a, b = "one two three four five six", "quite other words stand in this text"
    rows = [(1, a, "en", "s", 1), (1, a.upper(), "en", "s", 1), (1, b, "en", "s", 2), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, a, "en", "s", 1),
            (3, "a b", "en", "t", 1), (3, "a b", "en", "s", 1), (None, a, "en", "s", 1), (None, a, "en", "s", 1)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
        out = sorted((tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()), key=str)
        assert out == sorted([rows[1], rows[2], rows[3], rows[4], rows[7], rows[8], rows[9]], key=str)


def test_the_last_stage_knows_the_order_of_the_mix(spark, scratch):
    rows = [(k, f"text {k}", "en", "abc"[k % 3], 6) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mixed_sources(spark, df, "")
    mixed.write.parquet(f"{scratch}/mix")
    want = [r["doc_id"] for r in mixing.mix_sources(df).orderBy("_m_position").collect()]
    out = corpus_pipeline.encoded(spark, spark.read.parquet(f"{scratch}/mix"), "").orderBy("mix_file", "mix_row").collect()
    assert [r["doc_id"] for r in out] == want
    assert corpus_pipeline.encoded(spark, df, "").where("mix_row is null and n_pieces > 0").count() == 300


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(k, "ab"[k % 2], "mine", k, -k, k * 2, "x") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, source string, _m_src string, _m_rank long, _m_position long, c0 long, _m_hash string")
    out = mixing.interleaved(df)
    assert out.columns == df.columns and sorted(tuple(r) for r in out.collect()) == sorted(rows)
    once = mixing.mix_sources(df)
    assert once.columns == [c for c in df.columns if c != "_m_position"] + list(mixing.PLACED)
    assert mixing.mix_sources(once).columns == once.columns
    assert {r["doc_id"]: (r["_m_src"], r["_m_rank"]) for r in once.collect()} == {r[0]: ("mine", r[3]) for r in rows}


def test_a_conversation_named_null_is_not_the_one_without_a_name(spark):
    df = spark.createDataFrame([(None, 1, "ann", "lost"), ("null", 1, "bob", "named"), ("-", 1, "eve", "dash")], "conv_id string, turn long, role string, text string")
    out = sorted((str(r["conv_id"]), r["perspective"], r["seq"]) for r in chat.perspectives(df).collect())
    assert out == [("-", "eve", 1), ("None", "ann", 1), ("null", "bob", 1)]


def test_the_last_stage_returns_the_pieces(spark):
    import hashlib

    from tessera.llm import pieces

    texts = ["One text of some words", "", None, "two\nlines", "日本 words"] * 120
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    out = corpus_pipeline.encoded(spark, df, "")
    back = {r["doc_id"]: r["text"] for r in pieces.decode_pieces(out).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    sha = lambda x: hashlib.sha256(np.array(x, np.int32).tobytes()).hexdigest()
    for r in out.collect():
        assert r["ids"] == r["nbest_ids"][0] and len(r["ids"]) == r["n_pieces"] and len(r["nbest_ids"]) == len(r["nbest_scores"])
        assert r["ids_sha256"] == sha(r["ids"]) and r["nbest_sha256"] == [sha(x) for x in r["nbest_ids"]]


def test_contexts_are_cut_a_few_rows_at_a_time(monkeypatch):
    want = [{"low": 1, "salt": 0, "s1": 0, "s2": 3, "repeated": False, "spread": 1}]
    batch = pa.RecordBatch.from_pydict({"key": [k // 2 for k in range(40)], "text": [f"{k // 2:04d}" * 60 for k in range(40)], "want": [want] * 40})
    whole = pa.Table.from_batches(suffix._cut([batch])).to_pydict()
    assert whole["key"] == list(range(20)) and whole["bytes"] == [(f"{k:04d}" * 60).encode()[:203] for k in range(20)]
    monkeypatch.setattr(suffix, "CUT_ROWS", 6)
    parts = list(suffix._cut([batch]))
    assert max(p.num_rows for p in parts) <= 6 and pa.Table.from_batches(parts).to_pydict() == whole


def test_op8_returns_the_ids_of_every_rank(spark, scratch):
    import hashlib

    from tessera.llm import pieces, queries

    texts = ["One text of some words", "", None, "two\nlines", "日本 words ☃", " "]
    rows = [(k % 5, t, "en", "s", 0) for k, t in enumerate(texts)] + [(None, "no id", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{scratch}/documents.parquet")
    vocabulary = pieces.Pieces(pieces._read(pieces.MODEL))
    sha = lambda x: hashlib.sha256(np.array(x, np.int32).tobytes()).hexdigest()
    found = []
    for r in queries.op8_sentencepiece(spark, scratch).collect():
        made = {vocabulary.decode(x) for x in r["nbest_ids"]}
        assert len(made) == 1 and r["round_trip"] and len(r["nbest_ids"]) == len(r["nbest_scores"]) == len(set(r["nbest_sha256"]))
        assert r["ids"] == r["nbest_ids"][0] and len(r["ids"]) == r["n_pieces"]
        assert r["ids_sha256"] == sha(r["ids"]) and r["nbest_sha256"] == [sha(x) for x in r["nbest_ids"]]
        found.append((r["doc_id"], made.pop()))
    assert sorted(found, key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)


def test_the_round_trip_is_read_from_the_ids_of_every_rank(monkeypatch):
    from types import SimpleNamespace

    from tessera.llm import pieces

    proto = pieces._read(pieces.MODEL)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["some words here", "", "other"]})
    encode = lambda: [x for b in pieces._encode([batch], SimpleNamespace(value=proto), 4, False, True) for x in b.column("round_trip").to_pylist()]
    assert encode() == [True, True, True]
    assert list(pieces._shares(pa.array(["ab", None, "c"]))) == [(0, 3)]
    monkeypatch.setattr(pieces, "TEXTS", 2)
    assert encode() == [True, True, True] and list(pieces._shares(pa.array(["ab"] * 5))) == [(0, 2), (2, 2), (4, 1)]
    # a last rank whose ids are those of another text
    real = pieces.Encoder.encode_units
    monkeypatch.setattr(pieces.Encoder, "encode_units", lambda self, units, n: ([*real(self, units, n)[0], (np.array([300], np.int32).tobytes(), 0.0)], True))
    assert encode() == [False, False, False]
