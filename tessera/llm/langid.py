"""Language identification of mixed text.

Learned from labelled rows: per language, how often each hashed byte trigram of
a word occurs, and which scripts its words are written in. A word's script
(from its lead bytes) narrows the languages it may belong to; its score for
each of them is the sum of its trigrams' log probabilities. A Viterbi pass
with a constant penalty for changing the language labels the words, so that a
text falls into spans of one language; the text's language is the one with the
most letters' bytes, its score that share.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, Words, chunks, count_between, mix

#: Labelled documents of a language that are counted, about; chosen by id hash.
TRAIN_DOCS = 4000
#: Trigram buckets (a power of two), smoothing, penalty of a switch and of a word
#: in a script that its language hardly uses; the share from which it does use it.
BUCKETS, SMOOTH, SWITCH, ALIEN, SCRIPT_SHARE = 1 << 16, 0.5, 12.0, 50.0, 0.01
#: Bytes whose words go through the Viterbi pass together.
LANES_BYTES = 8 << 20

#: Code point ranges (hexadecimal, both ends included) of scripts.
SCRIPT_RANGES = """
Latin 41-5A 61-7A AA-AA BA-BA C0-D6 D8-F6 F8-2AF 1D00-1D25 1D2C-1DBF 1E00-1EFF 2071-2071 207F-207F 2C60-2C7F A720-A7FF AB30-AB6F FB00-FB06 FF21-FF3A FF41-FF5A
Greek 370-3FF 1D26-1D2B 1F00-1FFF
Cyrillic 400-52F 1C80-1C8F 2DE0-2DFF A640-A69F
Armenian 530-58F FB13-FB17
Hebrew 590-5FF FB1D-FB4F
Arabic 600-6FF 750-77F 870-8FF FB50-FDFF FE70-FEFE
Syriac 700-74F 860-86F
Thaana 780-7BF
Nko 7C0-7FF
Devanagari 900-97F A8E0-A8FF
Bengali 980-9FF
Gurmukhi A00-A7F
Gujarati A80-AFF
Oriya B00-B7F
Tamil B80-BFF
Telugu C00-C7F
Kannada C80-CFF
Malayalam D00-D7F
Sinhala D80-DFF
Thai E00-E7F
Lao E80-EFF
Tibetan F00-FFF
Myanmar 1000-109F A9E0-A9FF AA60-AA7F
Georgian 10A0-10FF 1C90-1CBF 2D00-2D2F
Ethiopic 1200-139F 2D80-2DDF AB00-AB2F
Cherokee 13A0-13FF AB70-ABBF
Canadian 1400-167F 18B0-18FF
Khmer 1780-17FF 19E0-19FF
Mongolian 1800-18AF
Yi A000-A4CF
Lisu A4D0-A4FF
Kana 3041-30FF 31F0-31FF FF66-FF9F 1B000-1B16F
Bopomofo 3100-312F 31A0-31BF
Han 2E80-2FDF 3005-3007 3021-3029 3400-4DBF 4E00-9FFF F900-FAFF 20000-3FFFF
Hangul 1100-11FF 3130-318F A960-A97F AC00-D7FF FFA0-FFDC
Other 800-85F 1680-177F 1900-19DF 1A00-1C7F 1CC0-1CFF A500-A63F A6A0-A71F A800-A8DF A900-A95F A980-A9DF AA00-AA5F AA80-AAFF ABC0-ABFF 10000-1AFFF 1E000-1EFFF
"""
SCRIPT_NAMES = [None, *(line.split()[0] for line in SCRIPT_RANGES.split("\n") if line)]
SCRIPTS = len(SCRIPT_NAMES)


def _ranges() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, script) of the ranges, in order."""
    rows = [(int(x.split("-")[0], 16), int(x.split("-")[1], 16), k)
            for k, line in enumerate((line for line in SCRIPT_RANGES.split("\n") if line), 1) for x in line.split()[1:]]
    table = np.array(sorted(r for r in rows), np.int64)
    return table[:, 0], table[:, 1], table[:, 2]


_FIRST, _LAST, _SCRIPT = _ranges()
#: Script of the ASCII bytes.
_ASCII = np.zeros(256, np.int8)
_ASCII[65:91] = _ASCII[97:123] = 1


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the lead byte, code point) of the multibyte characters of UTF-8 text."""
    at = np.flatnonzero(data >= 0xC0)
    padded = np.r_[data, np.zeros(3, np.uint8)].astype(np.int64)
    lead = padded[at]
    more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
    point = lead & (0x3F >> more)
    for k in range(1, 4):
        point = np.where(more >= k, (point << 6) | (padded[at + k] & 0x3F), point)
    return at, point


def script_of(point: np.ndarray) -> np.ndarray:
    """Script of each code point; 0 for those that belong to none."""
    k = np.maximum(np.searchsorted(_FIRST, point, side="right") - 1, 0)
    return np.where((point >= _FIRST[k]) & (point <= _LAST[k]), _SCRIPT[k], 0).astype(np.int8)


def scripts(data: np.ndarray) -> np.ndarray:
    """Script of the character that begins at each byte; 0 at the others."""
    out = _ASCII[data]
    at, point = code_points(data)
    out[at] = script_of(point)
    return out


class Features:
    """Words of a chunk, their trigram buckets and scripts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = w = Words(data, offsets, hashed=False)
        low = LOWER[data]
        low = np.where(w.space, np.uint8(32), low)
        before, after = np.empty_like(low), np.empty_like(low)
        before[1:], after[:-1] = low[:-1], low[1:]
        inner = offsets[:-1][np.diff(offsets) > 0]
        if len(data):
            before[inner] = 32
            after[offsets[1:][np.diff(offsets) > 0] - 1] = 32
        at = np.flatnonzero(~w.space)
        code = (before[at].astype(np.uint64) << np.uint64(16)) | (low[at].astype(np.uint64) << np.uint64(8)) | after[at].astype(np.uint64)
        self.bucket = (mix(code + np.uint64(1)) >> np.uint64(48)).astype(np.int64)
        lengths = w.end - w.start
        self.first = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=self.first[1:])
        self.lengths = lengths
        script = scripts(data)[at]
        self.script = np.maximum.reduceat(script, self.first[:-1]) if len(lengths) else np.zeros(0, np.int8)


def _train(batches, names):
    """Rows (lang, key, n): trigram buckets, then scripts (as BUCKETS + script)."""
    index = {x: k for k, x in enumerate(names)}
    counts = np.zeros((len(names), BUCKETS + SCRIPTS), np.int64)
    for batch in batches:
        label = np.array([index.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
        for a, b, data, offsets in chunks(batch.column(0)):
            f = Features(data, offsets)
            own = label[a:b][f.words.doc]
            width = BUCKETS + SCRIPTS
            counts += np.bincount(np.repeat(own, f.lengths) * width + f.bucket, minlength=counts.size).reshape(counts.shape)
            lettered = f.script > 0
            counts += np.bincount(own[lettered] * width + BUCKETS + f.script[lettered], minlength=counts.size).reshape(counts.shape)
    lang, key = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(key), pa.array(counts[lang, key])], names=["lang", "key", "n"])


class Model:
    """Log probabilities per bucket, and languages in use per script."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        tri, scripts = counts[:, :BUCKETS].astype(np.float64), counts[:, BUCKETS:].astype(np.float64)
        total = tri.sum(1, keepdims=True) + SMOOTH * BUCKETS
        self.log = np.ascontiguousarray(np.log((tri + SMOOTH) / total).T.astype(np.float32))
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        used = (share >= SCRIPT_SHARE).T
        used[~used.any(1)] = True
        used[0] = True
        self.alien = np.where(used, 0, -ALIEN).astype(np.float32)


def fit(rows: DataFrame, per_language: int = TRAIN_DOCS) -> Model:
    """``rows`` (doc_id, text, lang): about ``per_language`` rows of each language are
    counted (all, where there are fewer)."""
    known = rows.where("lang is not null and text is not null")
    sizes = known.groupBy("lang").count()
    names = sorted(r["lang"] for r in sizes.collect())
    if not names:
        return Model([], np.zeros((0, BUCKETS + SCRIPTS)))
    place = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) / F.lit(1_000_000)
    chosen = known.join(F.broadcast(sizes.withColumnRenamed("count", "n_lang")), "lang").where(place * F.col("n_lang") < per_language)
    counted = (chosen.select("text", "lang").mapInArrow(partial(_train, names=names), "lang long, key long, n long")
               .groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros((len(names), BUCKETS + SCRIPTS))
    counts[counted.column("lang").to_numpy(), counted.column("key").to_numpy()] = counted.column("n").to_numpy()
    return Model(names, counts)


def viterbi(score: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best language of every word; ``score`` is words x languages, ``first`` the first
    word of each document (and the end). Documents run side by side, longest first."""
    n_lang = score.shape[1]
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    label = np.zeros(len(score), np.int16)
    if not len(size) or size[0] == 0:
        return label
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    v = score[start[: active[0]]].astype(np.float64)
    stay_all = np.ones((len(score), n_lang), bool)
    from_all = np.zeros(len(score), np.int16)
    ended = np.zeros(len(size), np.int16)
    for t in range(1, int(size[0])):
        n = active[t]
        if n < len(v):
            ended[n : len(v)] = v[n:].argmax(1)
            v = v[:n]
        at = start[:n] + t
        top = v.argmax(1)
        change = v[np.arange(n), top] - SWITCH
        stay = v >= change[:, None]
        stay_all[at] = stay
        from_all[at] = top
        v = np.where(stay, v, change[:, None]) + score[at]
    ended[: len(v)] = v.argmax(1)
    now = np.zeros(len(size), np.int16)
    for t in range(int(size[0]) - 1, -1, -1):
        n = active[t]
        longer = active[t + 1] if t + 1 < len(active) else 0
        now[longer:n] = ended[longer:n]
        at = start[:n] + t
        label[at] = now[:n]
        now[:n] = np.where(stay_all[at, now[:n]], now[:n], from_all[at])
    return label


def spans_of(model: Model, data: np.ndarray, offsets: np.ndarray):
    """(features, language per word) of a chunk."""
    f = Features(data, offsets)
    if not len(f.lengths):
        return f, np.zeros(0, np.int16)
    score = np.add.reduceat(model.log[f.bucket], f.first[:-1], axis=0)
    score[f.script == 0] = 0
    score += model.alien[f.script]
    return f, viterbi(score, f.words.first_word)


def _predict(batches, model, text_at):
    for batch in batches:
        pred, score = [], []
        column = batch.column(text_at)
        for a, b, data, offsets in chunks(column, LANES_BYTES):
            docs = b - a
            lettered = count_between(_ASCII[data] > 0, offsets) > 0
            foreign = np.flatnonzero(~lettered & (count_between(data >= 128, offsets) > 0))
            for k in foreign.tolist():
                lettered[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
            if not model.names:
                pred += ["und"] * docs
                score += [0.0] * docs
                continue
            f, label = spans_of(model, data, offsets)
            n = len(model.names)
            weight = np.where(f.script > 0, f.lengths, 0)
            share = np.bincount(f.words.doc.astype(np.int64) * n + label, weights=weight, minlength=docs * n).reshape(docs, n)
            total = share.sum(1)
            # letters outside the script table only: every word counts
            plain = np.bincount(f.words.doc.astype(np.int64) * n + label, weights=f.lengths, minlength=docs * n).reshape(docs, n)
            share = np.where(total[:, None] > 0, share, plain)
            best = share.argmax(1)
            part = share[np.arange(docs), best] / np.maximum(share.sum(1), 1)
            pred += [model.names[x] if ok else "und" for x, ok in zip(best.tolist(), lettered.tolist())]
            score += np.where(lettered, part, 0.0).tolist()
        keep = [c for k, c in enumerate(batch.columns) if k != text_at]
        names = [c for k, c in enumerate(batch.schema.names) if k != text_at]
        yield pa.RecordBatch.from_arrays(keep + [pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=names + ["lang_pred", "score"])


def _spans(batches, model):
    for batch in batches:
        rows = []
        ids = batch.column(0).to_pylist()
        for a, b, data, offsets in chunks(batch.column(1), LANES_BYTES):
            f, label = spans_of(model, data, offsets)
            w = f.words
            for k in range(b - a):
                i, j = int(w.first_word[k]), int(w.first_word[k + 1])
                if i == j:
                    continue
                cut = [i, *(np.flatnonzero(label[i + 1 : j] != label[i : j - 1]) + i + 1).tolist(), j]
                for x, y in zip(cut[:-1], cut[1:]):
                    body = data[w.start[x] : w.end[y - 1]].tobytes().decode("utf-8", "replace")
                    rows.append((ids[a + k], x - i, y - i, model.names[label[x]], body))
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()),
             pa.array(cols[4], pa.string())], names=["doc_id", "first_word", "end_word", "lang", "text"])


def language_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first_word, end_word, lang, text) of each run of words in one language;
    a text without words has no span, and a model without languages gives none."""
    if not model.names:
        return docs.sparkSession.createDataFrame([], "doc_id long, first_word long, end_word long, lang string, text string")
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(partial(_spans, model=model), "doc_id long, first_word long, end_word long, lang string, text string")


def identify(docs: DataFrame, per_language: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. Rows whose crc32(id as text)
    mod 4 is 2 are held out of training; a null id is not held out. A null text or one
    without a letter is ``und`` with score 0, and so is everything if no row has a
    language. Repeated rows are answered (and learned from) each; an empty table gives none."""
    held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       F.col(f"`{lang_col}`").alias("lang"), held.alias("held_out"))
    model = fit(rows.where("not held_out"), per_language)
    return rows.select("doc_id", "held_out", "text").mapInArrow(
        partial(_predict, model=model, text_at=2), "doc_id long, held_out boolean, lang_pred string, score double")
