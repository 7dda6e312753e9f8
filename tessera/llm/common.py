"""Helpers shared by the operators: byte-level batches, word hashes, packed blobs.

Text is handled as UTF-8 bytes straight from the Arrow buffers, a bounded
chunk of documents at a time, so that numpy does the per-byte work and no
Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text handled at once; a longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Multiplier that chains word hashes into hashes of word sequences.
CHAIN = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * _K1
    x = x ^ (x >> np.uint64(27))
    x = x * _K2
    return x ^ (x >> np.uint64(31))


#: One 64-bit value per byte, and the same with A-Z read as a-z.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUE_LOWER = BYTE_VALUE[LOWER]
#: The white space of the word rule: space and \t \n \v \f \r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse (mod 2**64), cached per process."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 2)
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = (made[0], made[1])
    return _powers


class Prefix:
    """Prefix hashes of a byte chunk: the hash of any span in constant time."""

    def __init__(self, data: np.ndarray, table: np.ndarray = BYTE_VALUE):
        fwd, self.inv = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * fwd[: len(data)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inv[start]
        return mix(raw + (end - start).astype(np.uint64) * _K2)

    def every(self, width: int) -> np.ndarray:
        """Hashes of all spans of ``width`` bytes."""
        raw = (self.sums[width:] - self.sums[:-width]) * self.inv[: len(self.sums) - width]
        return mix(raw + np.full(1, width, np.uint64) * _K2)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a chunk of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True):
        self.data, self.offsets = data, offsets
        self.space = IS_SPACE[data]
        gap = np.ones(len(data) + 2, bool)
        gap[1:-1] = self.space
        word = ~gap
        first = word[1:-1] & gap[:-2]
        last = word[1:-1] & gap[2:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut] |= word[1:-1][cut]
        last[cut - 1] |= word[1:-1][cut - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words of document i are first_word[i] : first_word[i + 1]
        self.first_word = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first_word))
        if hashed:
            self.prefix = Prefix(data, BYTE_VALUE_LOWER if lower else BYTE_VALUE)
            self.hash = self.prefix.spans(self.start, self.end)

    def chains(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each word on; only meaningful where the
        document still has ``n`` words there."""
        h = np.zeros(max(0, len(self.hash) - n + 1), np.uint64)
        for k in range(n):
            h = h * CHAIN + self.hash[k : k + len(h)]
        return mix(h)


def count_between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def chunks(text: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows that
    hold about ``limit`` bytes together; nulls count as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.fill_null("") if text.null_count else text
    large = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    at = np.frombuffer(text.buffers()[1], np.int64 if large else np.int32)
    at = at[text.offset : text.offset + len(text) + 1].astype(np.int64)
    body = text.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        stop = min(stop, len(text))
        yield row, stop, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def map_batches(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def shuffle_partitions(spark: SparkSession, work: int, per_partition: int) -> int:
    """The session's shuffle partitions, or more where ``work`` units need it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(work) // per_partition), 1)


def blob(x: np.ndarray) -> bytes:
    """An integer array by byte planes: the high planes of small numbers compress to nothing."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unblob(b: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)


#: Edges in a partition between the steps of a component search; no more than these
#: are searched in one partition, without a shuffle.
COMPONENT_EDGES = 100_000


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) for the end points of ``edges`` (a, b): component is the
    smallest node reachable. Alternating large-star and small-star steps; every
    step is a map-side combined minimum and one join (few edges: a window in one
    partition), and ``cut`` ends its lineage."""
    # few edges need few tasks: a shuffle of them costs more files than it has rows
    parts = edges.count() // COMPONENT_EDGES + 1

    def together(rows: DataFrame) -> DataFrame:
        return rows.coalesce(1) if parts == 1 else rows

    def lowest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``rows`` with the smallest neighbour m of u, and (u, m)."""
        if parts == 1:
            # a join would deal them out again
            marked = rows.withColumn("m", F.min("v").over(Window.partitionBy("u")))
            return marked, marked.select("u", "m")
        low = rows.groupBy("u").agg(F.min("v").alias("m"))
        return rows.join(low, "u"), low

    e = together(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")).distinct()
    e = cut(e.coalesce(parts))
    state = None
    while True:
        both = together(e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        # large star: larger neighbours of u move to the smallest of its neighbourhood
        e = lowest(both)[0].where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")
        # small star: u and its smaller neighbours move to the smallest of them
        marked, low = lowest(e)
        e = together(marked.select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v")).distinct()
        e = cut(e.coalesce(parts))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
