"""Stupid-backoff scores, computed relationally.

Documents are dealt into blocks. A block asks for the corpus counts of its distinct
n-grams, the requests are partitioned by the n-gram's hash, each partition adds
up its counts and answers every request, and the answers are joined back to the
block's exploded n-grams and summed per document. Hot n-grams are counted in their
block first, so that one is asked for once a block, however often it occurs.

Words and pairs are asked for first. Three words that another document has too
are two pairs that it has: only triples whose pairs both occur in other documents
are asked for, in a second round, and no count that matters is missed.

A document is scored by the other documents: its own occurrences are taken
off the corpus counts. With ``c`` so reduced, a word w after u v scores
``c(uvw) / c(uv)`` if c(uvw) > 0, else ``0.4 c(vw) / c(v)`` if c(vw) > 0, else
``0.16 max(c(w), 0.5) / N``, where N is the number of words of the others.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CHAIN, Words, blob, chunks, mix, unblob

ORDER, ALPHA, UNSEEN = 3, 0.4, 0.5
#: Bytes of text in a block, and in the share of an n-gram partition.
BLOCK_BYTES, PART_BYTES = 10 << 20, 10 << 20


class Grams:
    """The n-grams of a block of documents: 64-bit name and document of each, by order."""

    def __init__(self, text: pa.Array):
        hashes, docs, first = [], [], 0
        for a, b, data, offsets in chunks(text):
            w = Words(data, offsets, lower=True)
            hashes.append(w.hash)
            docs.append(w.doc + a)
        word = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.doc = np.concatenate(docs).astype(np.int32) if docs else np.zeros(0, np.int32)
        del hashes, docs
        self.names, self.at = [], []
        chain = np.zeros(len(word), np.uint64)
        for n in range(1, ORDER + 1):
            size = max(0, len(word) - n + 1)
            chain = chain[:size] * CHAIN + word[n - 1 : n - 1 + size]
            at = np.flatnonzero(self.doc[:size] == self.doc[n - 1 : n - 1 + size]).astype(np.int32)
            self.names.append(mix(chain[at] + np.uint64(n)))
            self.at.append(at)

    def likely(self, pairs: np.ndarray) -> np.ndarray:
        """Triples (as places in their order) whose pairs have positive counts ``pairs``."""
        left = pairs[np.searchsorted(self.at[1], self.at[2])]
        right = pairs[np.searchsorted(self.at[1], self.at[2] + 1)]
        return np.flatnonzero((left > 0) & (right > 0))


def distinct(*names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct names, and how often each occurs in the block."""
    every = np.concatenate(names)
    every.sort()
    edge = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
    return every[edge], np.diff(np.r_[edge, len(every)])


def others(name: np.ndarray, doc: np.ndarray, docs: int, names: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Occurrences of each n-gram in the other documents; ``totals`` are the corpus counts of the
    block's distinct ``names``, ``counts`` its own."""
    # needles in order meet the sorted names one after the other
    order = np.argsort(name)
    code = np.empty(len(name), np.int32)
    code[order] = np.searchsorted(names, name[order])
    del order
    left = totals[code].astype(np.int64)
    # occurrences in the document itself: one, unless the block has more of them
    many = np.flatnonzero(counts[code] > 1)
    _, back, times = np.unique(code[many].astype(np.int64) * docs + doc[many], return_inverse=True, return_counts=True)
    inside = np.ones(len(code), np.int64)
    inside[many] = times[back]
    return left - inside


def words_and_pairs(grams: Grams, docs: int, totals: np.ndarray) -> list[np.ndarray]:
    """Counts in other documents of the words and the pairs of a block."""
    names, counts = distinct(*grams.names[:2])
    return [others(grams.names[n], grams.doc[grams.at[n]], docs, names, counts, totals) for n in range(2)]


def _pack(x: np.ndarray) -> bytes:
    """``blob`` with its uneven planes entropy-coded, after its length."""
    raw = blob(x)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(b: bytes, dtype) -> np.ndarray:
    return unblob(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), dtype)


def _cuts(names: np.ndarray, parts: int) -> np.ndarray:
    """Where the sorted names are cut into ``parts`` ranges of hash values."""
    step = (1 << 64) // parts
    edge = np.array([k * step for k in range(1, parts)], np.uint64)
    return np.r_[0, np.searchsorted(names, edge), len(names)]


def _blocks(batches):
    """(block, text) of each block in the partition."""
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    block = table.column("block").to_numpy()
    for k in np.unique(block):
        yield int(k), table.filter(pa.array(block == k)).column("text").combine_chunks()


_ASKED = "part int, block long, names binary, counts binary"


def _asked(block: int, names: np.ndarray, counts: np.ndarray, parts: int) -> pa.Table:
    cut = _cuts(names, parts)
    rows = [(p, a, b) for p, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a]
    return pa.table({"part": pa.array([p for p, _, _ in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int64()),
                     "names": pa.array([_pack(np.diff(names[a:b], prepend=np.uint64(0))) for _, a, b in rows], pa.binary()),
                     "counts": pa.array([_pack(counts[a:b].astype(np.uint32)) for _, a, b in rows], pa.binary())})


def _request(batches, parts):
    """Asks for the words and pairs of each block."""
    for block, text in _blocks(list(batches)):
        yield from _asked(block, *distinct(*Grams(text).names[:2]), parts).to_batches()


def _request_triples(key, docs: pa.Table, answers: pa.Table, parts: int) -> pa.Table:
    """Asks for the triples of a block that other documents may have."""
    grams = Grams(docs.column("text").combine_chunks())
    pairs = words_and_pairs(grams, docs.num_rows, _totals(answers))[1]
    return _asked(key[0].as_py(), *distinct(grams.names[2][grams.likely(pairs)]), parts)


def _totals(answers: pa.Table) -> np.ndarray:
    """Answers in the order of the names."""
    order = np.argsort(answers.column("part").to_numpy()) if answers.num_rows else []
    rows = answers.column("totals").to_pylist()
    return np.concatenate([_unpack(rows[k], np.uint64) for k in order]) if len(order) else np.zeros(0, np.uint64)


def _answer(batches):
    """Adds up the counts of the partition's names; answers in the order of the requests."""
    part, block, names, counts = [], [], [], []
    for batch in batches:
        part += batch.column(0).to_pylist()
        block += batch.column(1).to_pylist()
        names += [np.cumsum(_unpack(x, np.uint64)) for x in batch.column(2).to_pylist()]
        counts += [_unpack(x, np.uint32) for x in batch.column(3).to_pylist()]
    if not part:
        return
    size = [len(x) for x in names]
    name, count = np.concatenate(names), np.concatenate(counts)
    del names, counts
    order = np.argsort(name, kind="stable")
    name = name[order]
    edge = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    total = np.add.reduceat(count[order].astype(np.uint64), edge)
    answer = np.empty(len(name), np.uint64)
    answer[order] = np.repeat(total, np.diff(np.r_[edge, len(name)]))
    stop = np.cumsum(size).tolist()
    yield pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array([_pack(answer[b - n : b]) for n, b in zip(size, stop)], pa.binary())],
        names=["part", "block", "totals"])


def score_block(text: pa.Array, totals: np.ndarray, triples: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, log score) of each document; ``totals`` answers the block's distinct words and
    pairs, ``triples`` its likely triples."""
    grams = Grams(text)
    docs = len(text)
    own = np.bincount(grams.doc, minlength=docs)
    other = words_and_pairs(grams, docs, totals)
    likely = grams.likely(other[1])
    name, doc = grams.names[2][likely], grams.doc[grams.at[2][likely]]
    other.append(np.zeros(len(grams.at[2]), np.int64))
    other[2][likely] = others(name, doc, docs, *distinct(name), triples)
    grams.names.clear()
    n_other = np.maximum(words - own, 1)
    log = np.log(ALPHA**2 * np.maximum(other[0], UNSEEN) / n_other[grams.doc])
    first = np.searchsorted(grams.doc, grams.doc)
    place = np.arange(len(grams.doc)) - first
    log[place == 0] -= np.log(ALPHA**2)
    log[place == 1] -= np.log(ALPHA)
    for n in (2, 3):
        at, seen = grams.at[n - 1], other[n - 1]
        hit = np.flatnonzero(seen > 0)
        context = other[n - 2][np.searchsorted(grams.at[n - 2], at[hit])]
        # an n-gram met more often than its context is not itself but shares a name
        hit, context = hit[context >= seen[hit]], context[context >= seen[hit]]
        end = at[hit] + n - 1
        log[end] = np.log(seen[hit] / context) + np.where((n == 2) & (place[end] >= 2), np.log(ALPHA), 0.0)
    return own, np.bincount(grams.doc, weights=log, minlength=docs)


def _scored(key, docs: pa.Table, answers: pa.Table, words: int) -> pa.Table:
    of = answers.column("n").to_numpy()
    totals, triples = (_totals(answers.filter(pa.array(of == n))) for n in (2, 3))
    own, log = score_block(docs.column("text").combine_chunks(), totals, triples, words)
    log = log.astype(np.float64)
    mean = np.where(own > 0, log / np.maximum(own, 1), np.nan)
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(own, pa.int64()), "log_score": pa.array(np.round(log, 4), pa.float64()),
                     "mean_log": pa.array(np.round(mean, 4), mask=own == 0)})


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logs) and mean_log (null without words).

    Words are lower-cased (A-Z) runs of non-space. A null or empty text has no words
    and scores 0; rows with a null or repeated id, and repeated rows, are documents
    of their own (each counts for the others); an empty table gives none. Rows are dealt
    to blocks by their place in ``docs``, so that copies spread: ``docs`` is to be a table,
    or another frame that gives the same partitions when it is computed again."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = F.octet_length("text")
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    total, words = src.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(n_words), F.lit(0))).first()
    blocks, parts = max(1, -(-total // block_bytes)), int(max(1, -(-total // part_bytes)))
    dealt = src.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))).repartition(int(blocks), "block")

    def answered(asked: DataFrame) -> DataFrame:
        answers = asked.repartitionById(parts, "part").mapInArrow(_answer, "part int, block long, totals binary")
        return answers.repartition(int(blocks), "block")

    first = answered(dealt.select("doc_id", "text", "block").mapInArrow(partial(_request, parts=parts), _ASKED))
    asked = dealt.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(partial(_request_triples, parts=parts), _ASKED)
    both = first.withColumn("n", F.lit(2)).unionAll(answered(asked).withColumn("n", F.lit(3)))
    return (dealt.groupBy("block").cogroup(both.groupBy("block"))
            .applyInArrow(partial(_scored, words=int(words)), "doc_id long, n_words long, log_score double, mean_log double"))
