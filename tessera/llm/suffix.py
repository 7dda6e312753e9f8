"""Removal of repeated 200-byte strings with suffix arrays.

Every window of ``SPAN`` bytes is filed under the smallest hash of its 40-byte
substrings; neighbouring windows under the same hash form one context (the
bytes of all of them). Equal windows have equal hashes, so only contexts filed
together (or one that holds its substring twice) can share a window, and other
hashes met once are done with.

Contexts met twice or more are repeated in all their windows. The other
contexts of a hash that has several are compared in shards: the contexts of
a shard make one text, whose suffix array is built by Larsson-Sadakane
refinement (prefix doubling that re-sorts unfinished groups only), and Kasai's
rule gives common prefix lengths, for all contexts side by side. Windows next
to each other in the array with 200 bytes in common repeat. A hash with very
many contexts is spread over several shards; each sends its sorted window
digests, cut into ranges, to be merged by binary search.

The bytes of all repeated windows are removed, judged on the input.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Prefix, chunks, mix, shuffle_partitions
from tessera.session import cut_lineage

#: Bytes of a repeated string, and of the substrings that file a window.
SPAN, ANCHOR = 200, 40
#: Bytes of contexts in a shard, and contexts of one hash that a shard takes.
SHARD_BYTES, SHARD_CONTEXTS = 1 << 19, 512
#: Bytes of text that are filed at once, and rows whose texts are held to cut contexts.
FILE_BYTES, CUT_ROWS = 1 << 18, 512
#: Places of a string that Kasai's rule passes through at a stretch.
PIECE = 192

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.r_[x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)].reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def contexts(data: np.ndarray, offsets: np.ndarray):
    """(doc, first window, last window, window hash, context hash, whether the substring
    of the window hash occurs twice or more) of the contexts of a chunk; windows are
    numbered by their first byte in the document."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, none, none, none, none.astype(bool)
    prefix = Prefix(data)
    at = np.arange(len(data) - ANCHOR + 1)
    width = SPAN - ANCHOR + 1
    anchors = prefix.every(ANCHOR)
    low = sliding_min(anchors, width)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    inside = at[: len(low)] + SPAN <= offsets[doc + 1]
    new = np.r_[True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]]
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none, none, none, none, none, none.astype(bool)
    stop = np.flatnonzero(np.r_[(new[1:] | ~inside[1:]) & inside[:-1], inside[-1]])
    body = prefix.spans(first, stop + SPAN)
    start = offsets[doc[first]]
    view = np.lib.stride_tricks.sliding_window_view(anchors, width)
    earliest = first + view[first].argmin(axis=1)
    latest = stop + width - 1 - view[stop][:, ::-1].argmin(axis=1)
    return doc[first], first - start, stop - start, low[first].view(np.int64), body.view(np.int64), latest > earliest


def _file(batches):
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        parts = []
        for a, _, data, offsets in chunks(batch.column(1), FILE_BYTES):
            doc, s1, s2, low, body, twice = contexts(data, offsets)
            parts.append((key[a + doc], s1, s2, low, body, twice))
        cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[3]), pa.array(cols[4]), pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32)),
             pa.array(cols[5])], names=["low", "body", "key", "s1", "s2", "twice"])


def eight_bytes(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes from each place as a big-endian number; ``left`` bytes count."""
    out = np.zeros(len(text), np.uint64)
    padded = np.r_[text, np.zeros(8, np.uint8)]
    for k in range(8):
        b = padded[k : k + len(text)].astype(np.uint64)
        out = (out << np.uint64(8)) | np.where(left > k, b, np.uint64(0))
    return out


def first_bytes(text: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """The next ``width`` bytes from each place as a number, each byte plus one (0: past the end)."""
    out = np.zeros(len(text), np.uint64)
    padded = np.r_[text, np.zeros(width, np.uint8)]
    for k in range(width):
        out = out * np.uint64(257) + np.where(left > k, padded[k : k + len(text)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return out


def _order(key: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, their places); equal keys by place. Packed into one number if they fit."""
    if int(key.max()) < 1 << (64 - bits):
        both = np.sort((key.astype(np.uint64) << np.uint64(bits)) | at.astype(np.uint64))
        return both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int32)
    order = np.lexsort((at, key))
    return key[order], at[order]


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order (Larsson-Sadakane refinement); equal ones in order of place.

    ``left[i]`` bytes follow place i in its own string."""
    n = len(text)
    bits = max(1, n.bit_length())
    left = left.astype(np.int32)
    h = 4
    key, sa = _order(first_bytes(text, left, h), np.arange(n, dtype=np.int32), bits)
    head = np.r_[True, key[1:] != key[:-1]][:n]
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
    at = np.flatnonzero(~(head & np.r_[head[1:], True])).astype(np.int32)
    while True:
        # groups of one, and equal suffixes that have ended, are finished
        i = sa[at]
        go = left[i] >= h
        at, i = at[go], i[go]
        if not len(at):
            return sa
        after = np.where(left[i] > h, rank[np.minimum(i + h, n - 1)].astype(np.int64) + 1, 0)
        key, i = _order((rank[i].astype(np.int64) << bits) | after, i, bits)
        sa[at] = i
        head = np.r_[True, key[1:] != key[:-1]]
        rank[i] = np.maximum.accumulate(np.where(head, at, 0))
        at = at[~(head & np.r_[head[1:], True])]
        h *= 2


def common_prefixes(first: np.ndarray, size: np.ndarray, other: np.ndarray, text: np.ndarray, left: np.ndarray, limit: int = SPAN) -> np.ndarray:
    """Bytes (up to ``limit``) that places have in common with ``other``, the place
    before them in suffix order (or -1): of each string the ``size`` places from ``first``.

    Kasai's rule: the next place of a string has at most one byte less in common.
    All strings advance together; long ones in pieces of PIECE places, each of which
    starts anew, so that one long string does not advance alone."""
    keys = eight_bytes(text, left)
    pieces = -(-size // PIECE)
    own = np.repeat(np.arange(len(size)), pieces)
    skip = (np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
    start, size = first[own] + skip, np.minimum(size[own] - skip, PIECE)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    out = np.zeros(len(left), np.int64)
    have = np.zeros(len(start), np.int64)
    for t in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, side="left"))
        i = start[:live] + t
        j = other[i]
        room = np.where(j >= 0, np.minimum(np.minimum(left[i], left[np.maximum(j, 0)]), limit), 0)
        have = np.minimum(np.maximum(have[:live] - 1, 0), room)
        go = np.flatnonzero(have < room)
        while len(go):
            differ = keys[i[go] + have[go]] ^ keys[j[go] + have[go]]
            unequal = differ != 0
            same = np.full(len(go), 8)
            # leading equal bytes of the next eight
            d = differ[unequal]
            lead = np.zeros(len(d), np.int64)
            for k in range(1, 8):
                lead += (d >> np.uint64(64 - 8 * k)) == 0
            same[unequal] = lead
            have[go] = np.minimum(have[go] + same, room[go])
            go = go[~unequal & (have[go] < room[go])]
        out[i] = have
    return out


class Shard:
    """Contexts as one text, and classes of their windows from its suffix array."""

    def __init__(self, bodies: list[bytes], n_windows: np.ndarray):
        size = np.array([len(b) for b in bodies], np.int64)
        self.text = np.frombuffer(b"".join(bodies), np.uint8)
        end = np.cumsum(size)
        left = np.repeat(end, size) - np.arange(len(self.text))
        sa = suffix_array(self.text, left)
        before = np.full(len(sa), -1)
        before[sa[1:]] = sa[:-1]
        # places that are no windows have fewer than SPAN bytes left
        lcp = common_prefixes(end - size, n_windows, before, self.text, left)
        classes = np.empty(len(sa), np.int64)
        classes[sa] = np.cumsum(lcp[sa] < SPAN) - 1
        first = np.r_[0, np.cumsum(n_windows)]
        self.owner = np.repeat(np.arange(len(bodies)), n_windows)
        self.offset = np.arange(first[-1]) - first[:-1][self.owner]
        self.place = (end - size)[self.owner] + self.offset
        #: class of each window (equal windows share it), and how many windows it has
        self.group = classes[self.place]
        self.count = np.bincount(self.group, minlength=len(sa))

    def digests(self, windows: np.ndarray) -> np.ndarray:
        prefix = Prefix(self.text)
        return prefix.spans(self.place[windows], self.place[windows] + SPAN)


def runs(key: np.ndarray, at: np.ndarray):
    """(key, first, last) of consecutive places of the same key, which come in order."""
    if not len(key):
        return key, at, at
    new = np.r_[True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(key)] - 1
    return key[first], at[first], at[last]


def _shard(batches):
    """Rows (kind 0: key, s1, s2 of repeated windows; kind 1: a sorted run of digests
    of a spread hash, for the ranges of the merge)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    low, key, s1, s2 = (table.column(c).to_numpy() for c in ("low", "key", "s1", "s2"))
    repeated, spread = table.column("repeated").to_numpy(), table.column("spread").to_numpy()
    shard = Shard(table.column("bytes").to_pylist(), s2 - s1 + 1)
    own = shard.owner
    hit = (shard.count[shard.group] > 1) & ~repeated[own]
    yield _found(*runs(key[own][hit], (s1[own] + shard.offset)[hit]))
    # the first window of each class stands for it elsewhere
    lead = np.zeros(len(own), bool)
    lead[np.unique(shard.group, return_index=True)[1]] = True
    for h in np.unique(low[spread > 1]):
        pick = np.flatnonzero(lead & (low[own] == h))
        digest = shard.digests(pick)
        order = np.argsort(digest)
        digest, pick = digest[order], pick[order]
        open_ = ~(hit | repeated[own])[pick]
        n = int(spread[low == h][0])
        cut = np.searchsorted(digest, np.array([k * ((1 << 64) // n) for k in range(1, n)], np.uint64))
        for p, (a, b) in enumerate(zip(np.r_[0, cut].tolist(), np.r_[cut, len(digest)].tolist())):
            if b > a:
                w = pick[a:b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(h)]), pa.array([p], pa.int32()), pa.array([0], pa.int32()), pa.array([digest[a:b].tobytes()], pa.binary()),
                     pa.array([key[own[w]].tobytes()], pa.binary()), pa.array([(s1[own] + shard.offset)[w].astype(np.int64).tobytes()], pa.binary()),
                     pa.array([open_[a:b].tobytes()], pa.binary())], names=_SHARD_COLUMNS)


_SHARD_COLUMNS = ["key", "s1", "s2", "digests", "keys", "places", "open"]
_SHARD_SCHEMA = "key long, s1 int, s2 int, digests binary, keys binary, places binary, open binary"


def _found(key, first, last):
    nothing = pa.nulls(len(key), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), nothing, nothing, nothing, nothing],
        names=_SHARD_COLUMNS)


def merge_runs(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
    """Open windows (keys, places) whose digest another run holds too; binary search of
    every run in the merged one."""
    merged = np.sort(np.concatenate([r[0] for r in rows]))
    keys, places = [], []
    for digest, key, place, open_ in rows:
        twice = np.searchsorted(merged, digest, side="right") - np.searchsorted(merged, digest, side="left") > 1
        keys.append(key[twice & open_])
        places.append(place[twice & open_])
    return np.concatenate(keys), np.concatenate(places)


def _merge(key, table):
    rows = [(np.frombuffer(d, np.uint64), np.frombuffer(k, np.int64), np.frombuffer(p, np.int64), np.frombuffer(o, bool))
            for d, k, p, o in zip(*(table.column(c).to_pylist() for c in ("digests", "keys", "places", "open")))]
    keys, places = merge_runs(rows)
    order = np.lexsort((places, keys))
    k, a, b = runs(keys[order], places[order])
    return pa.table({"key": pa.array(k, pa.int64()), "s1": pa.array(a.astype(np.int32)), "s2": pa.array(b.astype(np.int32))})


def _cut(batches):
    """Slices the wanted contexts out of their texts; copies of a row come to one task, and
    only the first is cut."""
    seen: set[int] = set()
    for batch in (whole.slice(a, CUT_ROWS) for whole in batches for a in range(0, whole.num_rows, CUT_ROWS)):
        text, wanted = batch.column(1), batch.column(2).to_pylist()
        rows = []
        for key, body, want in zip(batch.column(0).to_pylist(), text, wanted):
            if key in seen:
                continue
            seen.add(key)
            raw = memoryview(body.as_buffer()) if body.is_valid else b""
            rows += [(w["low"], w["salt"], key, w["s1"], w["s2"], w["repeated"], w["spread"], bytes(raw[w["s1"] : w["s2"] + SPAN])) for w in want]
        cols = list(zip(*rows)) if rows else [[]] * 8
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                         names=["low", "salt", "key", "s1", "s2", "repeated", "spread", "bytes"])


def merged_spans(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal removed byte runs of window runs (first, last)."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + SPAN)
        else:
            out.append([a, b + SPAN])
    return [(a, b) for a, b in out]


def _kept(body: bytes, spans) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(body[at:a])
        at = b
    parts.append(body[at:])
    return b"".join(parts)


def _summary(batches):
    for batch in batches:
        size, removed, count, digest = [], [], [], []
        # one text at a time becomes a Python object
        for text, found in zip(batch.column(1), batch.column(2)):
            body, found = (text.as_py() or "").encode(), found.as_py()
            spans = merged_spans([(x["s1"], x["s2"]) for x in found]) if found else []
            size.append(len(body))
            removed.append(sum(b - a for a, b in spans))
            count.append(len(spans))
            digest.append(hashlib.sha256(_kept(body, spans)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()),
                                          pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _rewrite(batches):
    """The kept text; a character that is cut in two is dropped whole."""
    for batch in batches:
        out = []
        for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if found:
                text = _kept((text or "").encode(), merged_spans([(x["s1"], x["s2"]) for x in found])).decode("utf-8", "ignore")
            out.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], names=["_s_text", *batch.schema.names[2:]])


def repeats(keyed: DataFrame) -> DataFrame:
    """(key, found: array of (s1, s2)) of the rows of ``keyed`` (key, text) that hold
    repeated windows; rows of equal key are copies of one row."""
    spark = keyed.sparkSession
    filed = keyed.mapInArrow(_file, "low long, body long, key long, s1 int, s2 int, twice boolean")
    # low and body together are a 128-bit name of a context
    named = filed.groupBy("low", "body").agg(F.count("*").alias("n"), F.max("twice").alias("twice"))
    hashes = (named.groupBy("low").agg(F.sum("n").alias("total"), F.count("*").alias("bodies"), F.min("n").alias("least"), F.max("twice").alias("own"))
              .withColumn("several", (F.col("bodies") > 1) | F.col("own")).where("total > 1 or several").drop("own"))
    bodies = cut_lineage(named.join(hashes, "low").select("low", "body", "n", "twice", "bodies", "least", "several"))
    occurring = filed.drop("twice").join(bodies, ["low", "body"])
    occurring = cut_lineage(occurring.select("low", "body", "key", "s1", "s2", "n", "bodies", "least", "several"))
    whole = occurring.where("n > 1").select("key", "s1", "s2")
    # several windows that may be equal under a hash, and a body met once: compare them
    unclear = occurring.where("several and least = 1")
    reps = (unclear.groupBy("low", "body").agg(F.min(F.struct("key", "s1", "s2")).alias("r"), F.first("n").alias("n"), F.first("bodies").alias("bodies")))
    spread = F.ceil(F.col("bodies") / SHARD_CONTEXTS).cast("int")
    reps = reps.select("low", F.pmod("body", spread).cast("int").alias("salt"), "r.key", "r.s1", "r.s2", (F.col("n") > 1).alias("repeated"), spread.alias("spread"))
    want = (reps.groupBy("key").agg(F.collect_list(F.struct("low", "salt", "s1", "s2", "repeated", "spread")).alias("want")))
    want = cut_lineage(want)
    total = want.select(F.explode("want").alias("w")).agg(F.sum(F.col("w.s2") - F.col("w.s1") + SPAN)).first()[0] or 0
    shards = shuffle_partitions(spark, total, SHARD_BYTES)
    cut = keyed.join(want, "key").select("key", "text", "want").mapInArrow(
        _cut, "low long, salt int, key long, s1 int, s2 int, repeated boolean, spread int, bytes binary")
    dealt = cut.repartition(shards, "low", "salt")
    out = cut_lineage(dealt.mapInArrow(_shard, _SHARD_SCHEMA))
    inside = out.where("digests is null").select("key", "s1", "s2")
    across = (out.where("digests is not null").groupBy("key", "s1").applyInArrow(_merge, "key long, s1 int, s2 int"))
    found = whole.unionAll(inside).unionAll(across)
    # each copy of a row has found the same
    return found.groupBy("key").agg(F.collect_set(F.struct("s1", "s2")).alias("found"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn(
        "key", F.xxhash64("doc_id", "text"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A null text is empty; rows with a null or repeated id are rows of their own, and
    the copies of a repeated row repeat each other; an empty table gives none."""
    rows = _keyed(docs, id_col, text_col)
    found = cut_lineage(repeats(rows.select("key", "text")))
    return (rows.join(found, "key", "left").select("doc_id", "text", "found")
            .mapInArrow(_summary, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text, its other columns as they are.
    A character of which some bytes go is dropped whole."""
    from pyspark.sql import types as T

    names = [f"c{k}" for k in range(len(docs.columns))]
    key = F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    found = cut_lineage(repeats(_keyed(docs, id_col, text_col).select("key", "text")))
    rest = [(c, n) for c, n in zip(docs.columns, names) if c != text_col]
    src = docs.select(F.col(f"`{text_col}`").alias("_s_text"), key.alias("key"), *[F.col(f"`{c}`").alias(n) for c, n in rest])
    joined = src.join(found, "key", "left").select("_s_text", "found", *[n for _, n in rest])
    schema = T.StructType([T.StructField("_s_text", T.StringType())] + [T.StructField(n, docs.schema[c].dataType) for c, n in rest])
    made = joined.mapInArrow(_rewrite, schema)
    named = dict(rest)
    return made.select(*[F.col("_s_text").alias(c) if c == text_col else F.col(named[c]).alias(c) for c in docs.columns])
