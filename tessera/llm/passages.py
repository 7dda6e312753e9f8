"""Removal of passages that an earlier document has, behind a count-min prefilter.

A window is ``window`` consecutive words of a document. Its anchor, the smallest hash of
its ``anchor``-word sequences, is a function of its words alone, and neighbouring windows
mostly share it: a run of windows under one anchor counts once.

First pass: every partition keeps a count-min sketch of the anchors of its documents
(DEPTH rows of cells, once for each document); the sketches are added up cell by cell.
The least cell of an anchor never falls short of the number of documents that hold any
one of its windows, so a window whose anchor is estimated at one cannot be repeated.
The merged sketch is a table dealt by cell: it grows with the input, and no task and no
broadcast holds all of it.

Second pass: only runs under anchors estimated at two or more go on. Equal runs have one
owner, the smallest document; in all others the whole run repeats. The windows of the
owners are grouped exactly: one that a smaller owner holds too repeats. Anchors that the
sketch estimates in very many documents are not dealt to one task; their windows go
through map-side combined minima instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CHAIN, Words, chunks, mix, powers, shuffle_partitions
from tessera.llm.suffix import sliding_min
from tessera.session import cut_lineage

#: Words of a repeated passage, and of the sequences that anchor it.
WINDOW, ANCHOR = 50, 8
#: Rows of the sketch; bytes of text for each of their cells (some nine cells an anchor).
DEPTH, CELL_BYTES = 2, 16
#: Documents of an anchor beyond which its windows are spread over tasks.
HOT = 4096
#: Sketch entries that a task holds before it adds them up, and text of a task of the exact pass.
HELD, TASK_BYTES = 1 << 21, 16 << 20
#: Bytes of text hashed at once.
CHUNK = 1 << 18
#: A row without an id counts as the largest.
NO_ID = (1 << 63) - 1

_SALT = np.uint64(0x9E3779B97F4A7C15)


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on, by doubling."""
    out, have, power, size = None, 0, h, 1
    while True:
        if n & size:
            if out is None:
                out = power
            else:
                m = max(0, min(len(out), len(power) - have))
                out = mix(out[:m] * CHAIN + power[have : have + m])
            have += size
        if have == n:
            return out
        power = mix(power[: max(0, len(power) - size)] * CHAIN + power[size:])
        size *= 2


class Runs:
    """Runs of windows under one anchor, of a chunk of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, anchor: int):
        words = Words(data, offsets)
        h, n = words.hash, max(0, len(words.hash) - window + 1)
        self.window = window
        self.doc = self.first = self.stop = self.place = np.zeros(0, np.int64)
        self.low = self.body = self.names = np.zeros(0, np.uint64)
        if not n:
            return
        low = sliding_min(sequences(h, anchor), window - anchor + 1)
        doc = words.doc[:n]
        inside = words.doc[window - 1 :] == doc
        new = np.r_[True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]]
        self.first = np.flatnonzero(new & inside)
        self.stop = np.flatnonzero(np.r_[(new[1:] | ~inside[1:]) & inside[:-1], inside[-1]])
        self.doc, self.low = doc[self.first], low[self.first]
        #: first window of each run, as a number of words in its document
        self.place = self.first - words.first_word[self.doc]
        fwd, inv = powers(len(h))
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(h * fwd[: len(h)])]
        end = self.stop + window
        self.body = mix((sums[end] - sums[self.first]) * inv[self.first] + (end - self.first).astype(np.uint64) * _SALT)
        self._hash = h

    def names_of(self, run: int) -> np.ndarray:
        """Hashes of the windows of a run."""
        if not len(self.names):
            self.names = sequences(self._hash, self.window)
        return self.names[self.first[run] : self.stop[run] + 1]


def cells(low: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cell of each anchor in a row of the sketch; ``width`` is a power of two."""
    return (mix(low ^ (np.full(1, _SALT) * np.uint64(row + 1))) & np.uint64(width - 1)).astype(np.int64)


class CountMin:
    """A count-min sketch with the cells it has met, of one partition."""

    def __init__(self, width: int):
        self.width, self.held, self.size = width, [], 0

    def add(self, low: np.ndarray) -> None:
        for row in range(DEPTH):
            self.held.append(cells(low, row, self.width) * DEPTH + row)
        self.size += DEPTH * len(low)

    def take(self) -> pa.RecordBatch:
        cell, n = np.unique(np.concatenate([np.zeros(0, np.int64), *self.held]), return_counts=True)
        self.held, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], names=["cell", "n"])


def _once_per_document(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((runs.doc, runs.low))
    doc, low = runs.doc[order], runs.low[order]
    new = np.r_[True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])][: len(low)]
    return doc[new], low[new]


def _sketch(width: int, window: int, anchor: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        sketch = CountMin(width)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), CHUNK):
                sketch.add(_once_per_document(Runs(data, offsets, window, anchor))[1])
                if sketch.size >= HELD:
                    yield sketch.take()
        yield sketch.take()

    return run


def _lookups(width: int, window: int, anchor: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, data, offsets in chunks(batch.column(1), CHUNK):
                doc, low = _once_per_document(Runs(data, offsets, window, anchor))
                yield pa.RecordBatch.from_arrays([pa.array(key[a + doc])] + [pa.array(cells(low, row, width)) for row in range(DEPTH)],
                                                 names=["key"] + [f"c{row}" for row in range(DEPTH)])

    return run


def suspects(rows: DataFrame, width: int, window: int, anchor: int) -> DataFrame:
    """(key, hits: array of (cell, n)): anchors of each row, by their cell in the first row of
    the sketch, that are estimated in n >= 2 documents."""
    sketch = rows.select("text").mapInArrow(_sketch(width, window, anchor), "cell long, n long")
    merged = cut_lineage(sketch.groupBy("cell").agg(F.sum("n").alias("n")).where("n >= 2"))
    found = rows.select("key", "text").mapInArrow(_lookups(width, window, anchor), "key long, " + ", ".join(f"c{row} long" for row in range(DEPTH)))
    for row in range(DEPTH):
        counted = merged.where(F.col("cell") % DEPTH == row).select(F.expr(f"cell div {DEPTH}").alias(f"c{row}"), F.col("n").alias(f"n{row}"))
        found = found.join(counted, f"c{row}")
    return found.groupBy("key").agg(F.collect_list(F.struct(F.col("c0").alias("cell"), F.least(*[f"n{row}" for row in range(DEPTH)]).alias("n"))).alias("hits"))


def _estimates(runs: Runs, hits: pa.Array, width: int) -> np.ndarray:
    """Estimated documents of the anchor of each run; 0 where it isn't a suspect."""
    rows = len(hits)
    size = hits.value_lengths().fill_null(0).to_numpy()
    flat = hits.flatten()
    key = flat.field("cell").to_numpy() * rows + np.repeat(np.arange(rows), size)
    order = np.argsort(key)
    key, n = np.r_[key[order], -1], np.r_[flat.field("n").to_numpy()[order], 0]
    own = cells(runs.low, 0, width) * rows + runs.doc
    at = np.searchsorted(key[:-1], own)
    return np.where(key[at] == own, n[at], 0)


def _filled(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)


_PLACED = "low long, body long, id long, key long, place int, n int"


def _placed(width: int, window: int, anchor: int):
    """The suspect runs of each row."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, key = _filled(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in chunks(batch.column(2), CHUNK):
                runs = Runs(data, offsets, window, anchor)
                at = np.flatnonzero(_estimates(runs, batch.column(3).slice(a, b - a), width) > 1)
                row = a + runs.doc[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs.low[at].view(np.int64)), pa.array(runs.body[at].view(np.int64)), pa.array(ids[row]), pa.array(key[row]),
                     pa.array(runs.place[at].astype(np.int32)), pa.array((runs.stop - runs.first + 1)[at].astype(np.int32))],
                    names=["low", "body", "id", "key", "place", "n"])

    return run


_OWNED = "low long, body long, id long, names binary"
_WINDOWS = "low long, body long, id long, name long, at int"


def _owned(width: int, window: int, anchor: int, hot: bool, limit: int):
    """Suspect runs with the hashes of their windows: of equal runs in a task the one of the
    smallest id. ``hot``: those under anchors in more than ``limit`` documents, a row for
    each window; else the others, a row for each run."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], tuple[int, bytes]] = {}
        for batch in batches:
            ids = _filled(batch.column(0))
            for a, b, data, offsets in chunks(batch.column(2), CHUNK):
                runs = Runs(data, offsets, window, anchor)
                n = _estimates(runs, batch.column(3).slice(a, b - a), width)
                at = np.flatnonzero(n > limit if hot else (n > 1) & (n <= limit))
                for k, low, body, own in zip(at.tolist(), runs.low[at].view(np.int64).tolist(), runs.body[at].view(np.int64).tolist(),
                                             ids[a + runs.doc[at]].tolist()):
                    known = kept.get((low, body))
                    if known is None:
                        kept[low, body] = own, runs.names_of(k).tobytes()
                    elif own < known[0]:
                        kept[low, body] = own, known[1]
        rows = list(kept.items())
        for k in range(0, len(rows), 1 << 12):
            part = rows[k : k + (1 << 12)]
            cols = [np.array(x, np.int64) for x in zip(*[(low, body, own) for (low, body), (own, _) in part])]
            names = [x[1][1] for x in part]
            if hot:
                of, at = _spread(names)
                yield pa.RecordBatch.from_arrays([*[pa.array(c[of]) for c in cols], pa.array(np.frombuffer(b"".join(names), np.int64)), pa.array(at)],
                                                 names=["low", "body", "id", "name", "at"])
            else:
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(names, pa.binary())], names=["low", "body", "id", "names"])

    return run


def _spread(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(run, place in it) of all windows of runs whose hashes are ``names``."""
    size = np.array([len(x) // 8 for x in names], np.int64)
    run = np.repeat(np.arange(len(names)), size)
    return run, (np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)


_SETTLED = "low long, body long, owner long, marks array<int>"


def _settle(batches) -> Iterator[pa.RecordBatch]:
    """Owner of each run, and its windows that a smaller owner holds too; all runs of an
    anchor are here."""
    held = [x for x in batches if x.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    low, body, owner = (table.column(c).to_numpy() for c in ("low", "body", "id"))
    order = np.lexsort((owner, body, low))
    first = np.r_[True, (low[order][1:] != low[order][:-1]) | (body[order][1:] != body[order][:-1])]
    pick = order[first]
    low, body, owner = low[pick], body[pick], owner[pick]
    names = table.column("names").combine_chunks().take(pa.array(pick)).to_pylist()
    run, at = _spread(names)
    name = np.frombuffer(b"".join(names), np.uint64)
    order = np.lexsort((owner[run], low[run], name))
    name, of = name[order], run[order]
    new = np.r_[True, (name[1:] != name[:-1]) | (low[of][1:] != low[of][:-1])]
    least = owner[of][np.flatnonzero(new)][np.cumsum(new) - 1]
    hit = order[owner[of] > least]
    hit.sort()
    marks = np.bincount(run[hit], minlength=len(pick))
    yield pa.RecordBatch.from_arrays(
        [pa.array(low), pa.array(body), pa.array(owner),
         pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(marks)].astype(np.int32)), pa.array(at[hit]))],
        names=["low", "body", "owner", "marks"])


def _settle_hot(windows: DataFrame) -> DataFrame:
    """As ``_settle``, by map-side combined minima: no task gets all runs of an anchor."""
    least = windows.groupBy("low", "name").agg(F.min("id").alias("least"))
    held = windows.join(least, ["low", "name"]).where("id > least")
    marks = held.groupBy("low", "body", "id").agg(F.collect_set("at").alias("marks"))
    owners = windows.groupBy("low", "body").agg(F.min("id").alias("id"))
    return owners.join(marks, ["low", "body", "id"], "left").select("low", "body", F.col("id").alias("owner"), F.coalesce("marks", F.array().cast("array<int>")).alias("marks"))


def repeated(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(key, found: array of (id, first, last)): runs of repeated windows of the rows of
    ``rows`` (id, key, text); a row's own are those with its id."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = max(1 << 10, 1 << (int(size) // cell_bytes).bit_length())
    suspect = cut_lineage(suspects(rows, width, window, anchor))
    joined = rows.join(suspect, "key").select("id", "key", "text", "hits")
    some_hot = F.exists("hits", lambda x: x["n"] > hot)
    owned = joined.mapInArrow(_owned(width, window, anchor, False, hot), _OWNED)
    settled = owned.repartition(shuffle_partitions(spark, size, TASK_BYTES), "low").mapInArrow(_settle, _SETTLED)
    windows = joined.where(some_hot).mapInArrow(_owned(width, window, anchor, True, hot), _WINDOWS)
    settled = settled.unionAll(_settle_hot(windows))
    placed = joined.mapInArrow(_placed(width, window, anchor), _PLACED)
    # a run of its owner: the marked windows; of any other: all of them
    whole = F.array(F.struct(F.col("place").alias("a"), (F.col("place") + F.col("n") - 1).alias("b")))
    marked = F.transform("marks", lambda j: F.struct((F.col("place") + j).alias("a"), (F.col("place") + j).alias("b")))
    found = placed.join(settled, ["low", "body"]).select("key", "id", F.explode(F.when(F.col("id") > F.col("owner"), whole).otherwise(marked)).alias("x"))
    return found.groupBy("key").agg(F.collect_list(F.struct("id", F.col("x.a").alias("first"), F.col("x.b").alias("last"))).alias("found"))


def word_spans(found: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Maximal spans of words that windows (first, last) cover."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + window)
        else:
            out.append([a, b + window])
    return [(a, b) for a, b in out]


_KEPT = "doc_id long, n_words long, n_removed long, spans array<struct<start: int, stop: int>>, kept string"


def _kept(window: int):
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, stop, data, offsets in chunks(batch.column(1)):
                body, size, removed, spans, kept = data.tobytes(), [], [], [], []
                rows = zip(offsets[:-1].tolist(), offsets[1:].tolist(), ids.slice(start, stop - start).fill_null(NO_ID).to_pylist(),
                           batch.column(2).slice(start, stop - start).to_pylist())
                for a, b, own, found in rows:
                    # bytes.split() parts words at the same six bytes
                    words = body[a:b].split()
                    gone = word_spans([(x["first"], x["last"]) for x in found or () if x["id"] == own], window)
                    size.append(len(words))
                    removed.append(sum(q - p for p, q in gone))
                    spans.append([{"start": p, "stop": q} for p, q in gone])
                    for p, q in reversed(gone):
                        del words[p:q]
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, stop - start), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span),
                     pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return run


def without_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, cell_bytes: int = CELL_BYTES,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed words, start and stop) and kept (the other
    words, one space between them) of every row.

    A word goes if a window that covers it also starts in a document with a smaller id,
    judged on the input. A null text has no words, a text shorter than a window loses
    none. A null id counts as the largest, rows that share an id as one document (they
    take nothing from each other), and repeated rows fare alike. An empty table gives an
    empty result. Columns other than the id and the text are not read."""
    if not 0 < anchor <= window:
        raise ValueError("an anchor has one word at least and no more than a window")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("key", F.xxhash64("id", "text"))
    found = repeated(rows, window, anchor, hot, cell_bytes)
    return rows.join(found, "key", "left").select(F.col("id").alias("doc_id"), "text", "found").mapInArrow(_kept(window), _KEPT)
