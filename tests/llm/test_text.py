"""Quality, scores, languages, pieces and pages against SQL or brute force."""

import itertools
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import backoff, chat, html_text, langid, pieces, quality, queries

DOCS = "/root/testdata/sf0.01/documents.parquet"


def canon(rows):
    fix = lambda v: None if v is None or v != v else round(float(v), 3) if isinstance(v, float) else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=str)


def by_sql(df, sql, columns, **tables):
    """The SQL's rows over ``tables`` (DataFrames) and the operator's."""
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    return canon(tuple(r) for r in df.select(*columns).collect()), canon(want)


def test_quality_on_awkward_rows(docs):
    # the SQL joins by id: rows without or with repeated ids are judged row by row below
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    a, b = by_sql(quality.quality(some), queries.OP2_SQL, ["doc_id", *quality.COUNTS, "base_failed", "kept"], documents=some)
    assert a == b
    assert quality.quality(docs).count() == docs.count()
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_rejects_a_bad_host(spark):
    good = "plain words that never come back in the very same order " * 1
    rows = [(k, good + str(k), "fine", None, 0) for k in range(60)] + [(100 + k, "too short", "bad", None, 0) for k in range(59)] + [(200, good, "bad", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(df).collect()}
    assert all(kept[k] for k in range(60)) and not kept[200]
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == set(range(60))


def test_empty_tables(no_docs, spark):
    assert quality.quality(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0
    assert backoff.backoff_scores(no_docs).count() == 0
    assert langid.identify(no_docs).count() == 0
    assert pieces.encode_pieces(no_docs).count() == 0
    assert chat.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_backoff_on_awkward_rows(docs):
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    # many small blocks and partitions
    mine = backoff.backoff_scores(some, block_bytes=2000, part_bytes=1500)
    a, b = by_sql(mine, queries.OP10_SQL, ["doc_id", "n_words", "log_score", "mean_log"], documents=some)
    assert a == b
    assert backoff.backoff_scores(docs).count() == docs.count()


def test_chat_on_awkward_rows(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi <|im_end|> x"), (1, 2, "bob", None), (1, 2, "ann", "again"), (1, 2, "ann", "again"),
            (1, None, "eve", "first"), (1, 700, "bob", "late"), (1, 1400, None, "who"), (2, 0, "system", "alone"), (None, 3, "ann", "lost"), (3, 1, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    columns = ["conv_id", "perspective", "turn", "seq", "speaker", "rendered", "start", "n_chars", "mask_start", "mask_end"]
    a, b = by_sql(chat.perspectives(df), queries.OP5_SQL, columns, conversations=df)
    assert a == b
    one = [r for r in chat.perspectives(df).collect() if r["conv_id"] == 1 and r["perspective"] == "bob"]
    whole = "".join(r["rendered"] for r in sorted(one, key=lambda r: r["seq"]))
    masked = [whole[r["mask_start"]:r["mask_end"]] for r in sorted(one, key=lambda r: r["seq"]) if r["mask_start"] is not None]
    assert masked == ["<|im_end|>", "late<|im_end|>"]


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(DOCS)
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() >= 0.97
    assert out.score.between(0, 1).all()


def test_languages_on_awkward_rows(docs):
    out = langid.identify(docs).toPandas()
    assert len(out) == docs.count()
    texts = docs.select("doc_id", "text").where("doc_id < 9").toPandas().set_index("doc_id").text
    pred = out[out.doc_id < 9].set_index("doc_id").lang_pred
    for k, t in texts.items():
        assert (pred[k] == "und") == (t is None or not any(c.isalpha() for c in t))
    assert set(out.lang_pred) <= {"en", "fr", "und"}


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet(DOCS)
    model = langid.fit(docs.where("lang in ('en', 'de')").select("doc_id", "text", "lang"))
    pick = {r["lang"]: " ".join(r["text"].split()[:60]) for r in docs.where("lang in ('en', 'de') and n_chars > 800").orderBy("doc_id").collect()}
    df = spark.createDataFrame([(1, pick["en"] + " " + pick["de"]), (2, None), (3, "")], "doc_id long, text string")
    spans = sorted(langid.language_spans(df, model).collect(), key=lambda r: r["first_word"])
    assert [r["lang"] for r in spans] == ["en", "de"] and abs(spans[0]["end_word"] - 60) <= 4


def test_scripts_by_code_point():
    words = {"Việt": "Latin", "ꓡꓲꓢ": "Lisu", "ไทย": "Thai", "हिन्दी": "Devanagari", "ქართული": "Georgian", "አማርኛ": "Ethiopic", "ខ្មែរ": "Khmer", "ᏣᎳᎩ": "Cherokee",
             "한국": "Hangul", "漢字": "Han", "かな": "Kana", "ελληνικά": "Greek", "русский": "Cyrillic", "हिन्दी".upper(): "Devanagari", "עברית": "Hebrew", "հայերեն": "Armenian",
             "𠀀": "Han", "abc": "Latin", "123": None, "“—”": None, "😀": None, "x": "Latin"}
    text = " ".join(words).encode()
    f = langid.Features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert [langid.SCRIPT_NAMES[k] for k in f.script.tolist()] == list(words.values())
    rng = random.Random(1)
    points = [rng.choice([rng.randrange(128), rng.randrange(0x800), rng.randrange(0xD800), rng.randrange(0xE000, 0x10000), rng.randrange(0x10000, 0x110000)]) for _ in range(5000)]
    data = "".join(map(chr, points)).encode()
    assert langid.code_points(np.frombuffer(data, np.uint8))[1].tolist() == [p for p in points if p >= 128]
    assert (langid._FIRST[1:] > langid._LAST[:-1]).all()


def plain_language(model, text):
    """The prediction of one text without arrays: word scores, then every path's best predecessor."""
    words = text.split() if text else []
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    best, back = None, []
    weights = []
    for w in (text or "").encode().split():
        low = b" " + w.translate(bytes(langid.LOWER.tolist())) + b" "
        codes = np.array([(low[k] << 16) | (low[k + 1] << 8) | low[k + 2] for k in range(len(w))], np.uint64)
        script = max([0, *langid.script_of(np.array([ord(c) for c in w.decode()])).tolist()])
        score = model.log[(langid.mix(codes + np.uint64(1)) >> np.uint64(48)).astype(np.int64)].sum(axis=0) * (script > 0) + model.alien[script]
        weights.append((len(w) * (script > 0), len(w)))
        if best is None:
            best, back = score.astype(float), [list(range(len(score)))]
        else:
            came = [max(range(len(score)), key=lambda x: best[x] - langid.SWITCH * (x != y)) for y in range(len(score))]
            best = np.array([best[x] - langid.SWITCH * (x != y) for y, x in enumerate(came)]) + score
            back.append(came)
    assert len(words) == len(weights)
    path = [int(best.argmax())]
    for came in back[:0:-1]:
        path.append(came[path[-1]])
    path.reverse()
    share = np.zeros(len(best))
    for x, (lettered, plain) in zip(path, weights):
        share[x] += lettered if any(a for a, _ in weights) else plain
    return model.names[int(share.argmax())], share.max() / share.sum()


def test_prediction_equals_a_plain_version(spark):
    docs = spark.read.parquet(DOCS)
    model = langid.fit(docs.where("crc32(cast(doc_id as string)) % 4 <> 2").select("doc_id", "text", "lang"))
    some = docs.where("n_chars < 900").orderBy("doc_id").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in some.collect()]
    by = {r["lang"]: r["text"] for r in docs.where("n_chars between 300 and 900").collect()}
    rows += [(90000, by["en"] + " " + by["de"] + " Việt漢 ไทย " + by["fr"]), (90001, "漢字 かな"), (90002, "12 34"), (90003, "ꓡꓲ")]
    got = langid._predict([pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])], model, 1)
    for batch in got:
        for (_, text), lang, score in zip(rows, batch.column("lang_pred").to_pylist(), batch.column("score").to_pylist()):
            want = plain_language(model, text)
            assert lang == want[0] and abs(score - want[1]) < 1e-9


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    for _ in range(40):
        first = np.r_[0, np.cumsum(rng.integers(0, 6, 4))]
        score = rng.normal(0, 9, (first[-1], 3))
        label = langid.viterbi(score, first)
        for a, b in zip(first[:-1], first[1:]):
            value = lambda path: sum(score[a + k, x] for k, x in enumerate(path)) - langid.SWITCH * sum(x != y for x, y in zip(path, path[1:]))  # noqa: B023,E731
            assert b == a or math.isclose(value(label[a:b]), max(map(value, itertools.product(range(3), repeat=int(b - a)))))


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Pieces(f.read())


def segmentations(p, unit):
    """All (score, ids) of a unit."""
    if not unit:
        return [(0.0, ())]
    return [(s + w, ids + more) for start, w, more in p.edges(unit, len(unit)) for s, ids in segmentations(p, unit[:start])]


@pytest.mark.parametrize("unit", [" the", " hello", "é☃", " ninth", "  ab", "\n", "漢字x"])
def test_nbest_lists_every_segmentation_in_order(vocabulary, unit):
    every = sorted((s for s, _ in segmentations(vocabulary, unit)), reverse=True)
    found = vocabulary.nbest(unit, 20)
    assert [s for s, _ in found] == every[:20] and len({ids for _, ids in found}) == len(found)
    enc = pieces.Encoder(vocabulary)
    enc.learn([unit])
    assert tuple(np.frombuffer(enc.ids[0], np.int32).tolist()) == found[0][1]
    assert enc.score[0] == every[0] and (len(every) == 1 or enc.loss[0] == every[0] - every[1])


@pytest.mark.parametrize("text", [" a bc\nthe tea", "the", "é☃ x\n\n y", "", "ab ab ab ab", "  two  spaces "])
def test_nbest_of_a_text_lists_ids_of_every_rank(vocabulary, text):
    units = pieces._UNITS.findall(" " + text) if text else []
    every = {}
    for choice in itertools.product(*[segmentations(vocabulary, u) for u in units]):
        every.setdefault(sum(s for s, _ in choice), set()).add(tuple(i for _, ids in choice for i in ids))
    best = sorted((s for s, found in every.items() for _ in found), reverse=True)
    for n in (1, 2, 4, 9):
        got = [(tuple(np.frombuffer(ids, np.int32).tolist()), score) for ids, score in pieces.Encoder(vocabulary).encode(text, n)]
        assert [score for _, score in got] == best[:n]
        assert all(ids in every[score] for ids, score in got) and len({ids for ids, _ in got}) == len(got)
        assert all(vocabulary.decode(ids) == text for ids, _ in got if ids)


def test_lanes_and_the_search_agree(vocabulary, monkeypatch):
    rng = random.Random(6)
    units = list(dict.fromkeys(rng.choice(["", " ", "   "]) + "".join(rng.choice("aeiotnsrh.,é漢☃😀AT") for _ in range(rng.randrange(1, 40))) for _ in range(1500)))
    units += ["\n", " " * 31, "a" * 32, "a" * 33]
    lanes, alone = pieces.Encoder(vocabulary), pieces.Encoder(vocabulary)
    lanes.learn(units)
    monkeypatch.setattr(pieces, "LANE", 0)
    alone.learn(units)
    assert lanes.ids == alone.ids and (lanes.score == alone.score).all() and (lanes.loss == alone.loss).all()
    assert lanes.same.all() and alone.same.all() and (lanes.size == alone.size).all()


def test_pieces_round_trip(docs, spark):
    out = pieces.encode_pieces(docs)
    assert out.where("not round_trip").count() == 0 and out.count() == docs.count()
    back = pieces.decode_pieces(out.select("doc_id", "ids"))
    want = sorted(((r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == want
    long = spark.createDataFrame([(1, "x" * 5000 + " " + "漢" * 3000)], "doc_id long, text string")
    assert pieces.encode_pieces(long).first()["round_trip"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></ul></nav><div class="ad">Buy</div>{body}<aside>Side</aside><form>Name <input></form>
<div id="comments"><p>First!</p></div><footer>&copy; me</footer></body></html>"""


def test_article_text():
    page = PAGE.format(body="<article><h1>A &amp; B</h1><p>one<br>two\n  &nbsp;three<p><b>bold 1 < 2 &#233; &lt;tag&gt;</b><div class='share'>Share</div></article>")
    assert [t for m, t in html_text.lines(page) if m == html_text.ARTICLE] == ["A & B", "one two three", "bold 1 < 2 é <tag>"]


def test_pages_are_told_apart_by_their_neighbours(spark):
    plain = "<div>Top line</div><p>Only {k}</p><div>Bottom line</div>"
    rows = [(k, f"http://h/a/{k}", PAGE.format(body=plain.format(k=k))) for k in range(5)]
    rows += [(10, "http://alone/x", PAGE.format(body=plain.format(k="here"))), (11, None, None), (12, "http://[bad", "<p>x"), (13, "http://h/z", ""),
             (20, "http://m/1", PAGE.format(body="<main><p>same</p></main>")), (21, "http://m/2", PAGE.format(body="<main><p>same</p></main>")), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    out = html_text.main_text(df).collect()
    assert len(out) == len(rows)
    text = {r["page_id"]: r["text"] for r in out}
    assert [text[k] for k in range(1, 5)] == [f"Only {k}" for k in range(1, 5)]
    assert text[10] == "Top line\n\nOnly here\n\nBottom line" and text[11] == "" and text[12] == "x" and text[13] == "" and text[20] == text[21] == "same"
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_lcs_length():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(0, 12)).tolist() for _ in range(2))
        size = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            size[i + 1, j + 1] = size[i, j] + 1 if a[i] == b[j] else max(size[i, j + 1], size[i + 1, j])
        keep = html_text.lcs(a, b)
        it = iter(b)
        assert len(keep) == size[-1, -1] and keep == sorted(set(keep)) and all(a[k] in it for k in keep)


