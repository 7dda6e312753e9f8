"""Audit of how the words of sources differ from their language's.

Terms are runs of letters (ASCII letters, lower-cased, and all characters beyond
ASCII). A language keeps the terms that occur in enough of its documents. The kept
terms, sorted, become a minimal acyclic transducer: a state holds how many
terms it leads to, so the numbers along the path of a term add up to its
lexicographic ordinal. All text is then streamed through the transducer, many terms
side by side, byte by byte, and occurrences are counted by ordinal: no string leaves
a task in this pass. Ordinals also break ties, since they order terms as UTF-8 does.

The sorted terms are cut into shards by range, each with a transducer of its own, and
the shards are put into packs of a bounded size; the text passes through one pack
after the other, so neither a task nor the driver ever holds more than a pack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_VALUE_LOWER, LOWER, Prefix, chunks
from tessera.operators.rank import sequential_rank
from tessera.session import cut_lineage

#: Documents of its language in which a kept term occurs.
MIN_DOCS = 30
#: Scale of the smoothed shares, and what is added to every count.
SCALE, ADDED = 1_000_000_000, 5
#: Terms that a source reports.
TOP_TERMS = 50
#: Bytes of text in a shard's sorted terms, and bytes of transition tables in a pack.
SHARD_BYTES, PACK_BYTES = 1 << 18, 96 << 20
#: Cells of a block of shares (terms x sources) that are compared at once.
BLOCK_CELLS = 1 << 20
#: Text handled at a time.
_CHUNK = 2 << 20

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = _IS_LETTER[128:] = True
#: Ends the language that precedes a term in the transducer; no term holds this byte.
_END_OF_LANG = b"\x00"


class Transducer:
    """Minimal acyclic automaton of sorted byte strings that yields their ordinals."""

    def __init__(self, terms: list[bytes]):
        """``terms`` are distinct and sorted by bytes."""
        edges: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        free: list[int] = []

        def settle(path: list[tuple[int, int]], depth: int) -> None:
            # below ``depth`` nothing can be added any more: equal states become one
            while len(path) > depth:
                parent, byte = path.pop()
                child = edges[parent][byte]
                key = (final[child], *edges[child].items())
                known = register.setdefault(key, child)
                if known != child:
                    edges[parent][byte] = known
                    free.append(child)

        path: list[tuple[int, int]] = []
        last = b""
        for term in terms:
            common = 0
            limit = min(len(term), len(last))
            while common < limit and term[common] == last[common]:
                common += 1
            settle(path, common)
            state = edges[path[-1][0]][path[-1][1]] if path else 0
            for byte in term[common:]:
                if free:
                    new = free.pop()
                    edges[new], final[new] = {}, False
                else:
                    new = len(edges)
                    edges.append({})
                    final.append(False)
                edges[state][byte] = new
                path.append((state, byte))
                state = new
            final[state] = True
            last = term
        settle(path, 0)
        self._number(edges, final)

    def _number(self, edges: list[dict[int, int]], final: list[bool]) -> None:
        # states in the order of a first visit; children are counted before parents
        order, number, stack = [], {0: 0}, [0]
        while stack:
            s = stack.pop()
            order.append(s)
            for t in edges[s].values():
                if t not in number:
                    number[t] = len(number)
                    stack.append(t)
        below: dict[int, int] = {}
        todo = [0]
        while todo:
            s = todo[-1]
            open_ = [t for t in edges[s].values() if t not in below]
            if open_:
                todo.extend(open_)
            else:
                below[s] = final[s] + sum(below[t] for t in edges[s].values())
                todo.pop()
        self.n_terms = below[0]
        self.final = np.zeros(len(number), bool)
        source, label, target, add = [], [], [], []
        for s in order:
            self.final[number[s]] = final[s]
            before = int(final[s])
            for byte in sorted(edges[s]):
                t = edges[s][byte]
                source.append(number[s])
                label.append(byte)
                target.append(number[t])
                add.append(before)
                before += below[t]
        self.source, self.label = np.array(source, np.int32), np.array(label, np.uint8)
        self.target, self.add = np.array(target, np.int32), np.array(add, np.int64)

    def table_bytes(self) -> int:
        """Bytes of the transition table and of the numbers of the edges."""
        return 4 * len(self.final) * (1 + len(np.unique(self.label))) + 12 * len(self.add)

    def ready(self) -> Transducer:
        """Lays out the transition table: edge of (state, class of byte), or none."""
        used = np.unique(self.label)
        self.width = len(used) + 1
        self.kind = np.zeros(256, np.int32)
        self.kind[used] = np.arange(1, self.width)
        self.edge = np.full(len(self.final) * self.width, -1, np.int32)
        self.edge[self.source.astype(np.int64) * self.width + self.kind[self.label]] = np.arange(len(self.label), dtype=np.int32)
        return self

    def after(self, text: bytes) -> tuple[int, int]:
        """(state, ordinal so far) after ``text`` from the start; state -1 if no term begins so."""
        state = ordinal = 0
        for byte in text:
            e = int(self.edge[state * self.width + self.kind[byte]])
            if e < 0:
                return -1, 0
            state, ordinal = int(self.target[e]), ordinal + int(self.add[e])
        return state, ordinal

    def ordinals(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
        """Ordinals of the byte spans of ``data``, each read on from a state; -1 for others.
        All spans advance together; one that leaves the transducer drops out."""
        out = np.full(len(start), -1, np.int64)
        live = np.flatnonzero(state >= 0)
        state, ordinal, at, end = state[live], ordinal[live], start[live], end[live]
        while len(live):
            over = at == end
            if over.any():
                hit = over & self.final[state]
                out[live[hit]] = ordinal[hit]
                go = np.flatnonzero(~over)
                live, state, ordinal, at, end = live[go], state[go], ordinal[go], at[go], end[go]
            e = self.edge[state.astype(np.int64) * self.width + self.kind[data[at]]]
            go = np.flatnonzero(e >= 0)
            if len(go) < len(live):
                live, at, end, ordinal, e = live[go], at[go], end[go], ordinal[go], e[go]
            state = self.target[e]
            ordinal = ordinal + self.add[e]
            at = at + 1
        return out


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the terms of a chunk of texts."""
    letter = np.zeros(len(data) + 2, bool)
    letter[1:-1] = _IS_LETTER[data]
    first = letter[1:-1] & ~letter[:-2]
    last = letter[1:-1] & ~letter[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] |= letter[1:-1][cut]
    last[cut - 1] |= letter[1:-1][cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Values as numbers, and the value of each number."""
    d = column.fill_null("").dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _document_terms(batches) -> Iterator[pa.RecordBatch]:
    """(lang, term, docs): in how many documents of a chunk a term occurs. Terms of a
    chunk are told apart by a 64-bit hash and their length."""
    for batch in batches:
        lang, langs = _codes(batch.column(0))
        for a, b, data, offsets in chunks(batch.column(1), _CHUNK):
            start, end, row = term_spans(data, offsets)
            name = Prefix(data, BYTE_VALUE_LOWER).spans(start, end)
            # once for each document
            order = np.lexsort((row, name))
            name, row, start, end = name[order], row[order], start[order], end[order]
            new = np.r_[True, (name[1:] != name[:-1]) | (row[1:] != row[:-1])][: len(name)]
            name, start, end, own = name[new], start[new], end[new], lang[a:b][row[new]]
            order = np.lexsort((own, name))
            name, start, end, own = name[order], start[order], end[order], own[order]
            first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (own[1:] != own[:-1])][: len(name)])
            count = np.diff(np.r_[first, len(name)])
            body = LOWER[data].tobytes()
            terms = [body[i:j] for i, j in zip(start[first].tolist(), end[first].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()).take(pa.array(own[first])), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(count.astype(np.int64))],
                names=["lang", "term", "docs"])


def vocabulary(docs: DataFrame, min_docs: int = MIN_DOCS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, term): the terms that occur in at least ``min_docs`` documents of their language."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    found = rows.mapInArrow(_document_terms, "lang string, term string, docs long")
    return found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term")


def _shards(batches) -> Iterator[pa.RecordBatch]:
    """Transducers of the sorted terms of a partition, a shard at a time."""

    def built(terms: list[bytes], first: int) -> pa.RecordBatch:
        t = Transducer(terms)
        arrays = [t.source, t.label, t.target, t.add, t.final]
        return pa.RecordBatch.from_arrays(
            [pa.array([x], pa.int64()) for x in (first, t.n_terms, t.table_bytes())] + [pa.array([x.tobytes()], pa.binary()) for x in arrays], names=_SHARD_COLUMNS)

    held: list[bytes] = []
    size = first = 0
    for batch in batches:
        for lang, term, rank in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if held and (size > SHARD_BYTES or rank != first + len(held)):
                yield built(held, first)
                held, size = [], 0
            first = first if held else rank
            held.append(lang.encode() + _END_OF_LANG + term.encode())
            size += len(term.encode())
    if held:
        yield built(held, first)


_SHARD_COLUMNS = ["first", "terms", "bytes", "source", "label", "target", "add", "final"]
_SHARD_SCHEMA = "first long, terms long, bytes long, source binary, label binary, target binary, add binary, final binary"


def _opened(row) -> Transducer:
    t = Transducer.__new__(Transducer)
    t.n_terms = row["terms"]
    t.source, t.target = np.frombuffer(row["source"], np.int32), np.frombuffer(row["target"], np.int32)
    t.label, t.add, t.final = np.frombuffer(row["label"], np.uint8), np.frombuffer(row["add"], np.int64), np.frombuffer(row["final"], bool)
    return t.ready()


def _recount(pack):
    """Streams texts through the transducers of a pack: (lang, source, ordinal, n)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        shards = [(row["first"], _opened(row)) for row in pack.value]
        for batch in batches:
            lang, langs = _codes(batch.column(0))
            source, sources = _codes(batch.column(1))
            names = [pa.array(x, pa.string()) for x in (langs, sources)]
            starts = [np.array([t.after(x.encode() + _END_OF_LANG) for x in langs], np.int64).reshape(-1, 2) for _, t in shards]
            counted: list[list[np.ndarray]] = [[] for _ in shards]
            for a, b, data, offsets in chunks(batch.column(2), _CHUNK):
                start, end, row = term_spans(data, offsets)
                low = LOWER[data]
                own, group = lang[a:b][row], lang[a:b][row] * len(sources) + source[a:b][row]
                for k, (_, t) in enumerate(shards):
                    ordinal = t.ordinals(low, start, end, starts[k][own, 0], starts[k][own, 1])
                    hit = ordinal >= 0
                    counted[k].append(np.stack(np.unique(group[hit] * t.n_terms + ordinal[hit], return_counts=True)))
            for (first, t), parts in zip(shards, counted):
                key, n = np.concatenate([np.zeros((2, 0), np.int64), *parts], axis=1)
                key, at = np.unique(key, return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, at, n)
                group = key // t.n_terms
                yield pa.RecordBatch.from_arrays(
                    [names[0].take(pa.array(group // len(sources))), names[1].take(pa.array(group % len(sources))),
                     pa.array(first + key % t.n_terms), pa.array(total)], names=["lang", "source", "ordinal", "n"])

    return run


def numbered(terms: DataFrame) -> DataFrame:
    """``terms`` (lang, term) with their lexicographic ordinals from 0, in that order."""
    ranked = sequential_rank(terms, ["lang", "term"])
    return cut_lineage(ranked.select("lang", "term", (F.col("rank") - 1).alias("ordinal")))


def recount(docs: DataFrame, ordered: DataFrame) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of the terms of ``ordered``, as ``numbered``
    returns them, in ``docs`` (lang, source, text). One pass over the texts for each pack
    of transducers, PACK_BYTES of tables at most (or one shard)."""
    spark = docs.sparkSession
    shards = cut_lineage(ordered.mapInArrow(_shards, _SHARD_SCHEMA))
    packs: list[list[int]] = []
    room = 0
    for row in shards.select("first", "bytes").orderBy("first").toLocalIterator():
        if not packs or row["bytes"] > room:
            packs.append([])
            room = PACK_BYTES
        packs[-1].append(row["first"])
        room -= row["bytes"]
    schema = "lang string, source string, ordinal long, n long"
    out = spark.createDataFrame([], schema)
    for pack in packs:
        held = spark.sparkContext.broadcast(shards.where(F.col("first").between(pack[0], pack[-1])).collect())
        found = docs.mapInArrow(_recount(held), schema)
        out = out.unionAll(cut_lineage(found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))))
        held.unpersist()
    return out


def _share(count: str, total: str):
    """1 + floor(SCALE * (count + ADDED) / total), exactly; 0 where there is no term."""
    x = f"cast({count} + {ADDED} as decimal(20, 0)) * cast({SCALE} as decimal(10, 0))"
    return F.expr(f"case when {total} > 0 then cast(1 + ({x}) div cast({total} as decimal(20, 0)) as bigint) else 0L end")


_PAIR_SCHEMA = "lang string, a int, b int, value long"


def _differences(key, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over the terms of a block of the differences between any two sources."""
    sid = groups.column("sid").to_numpy()
    order = np.argsort(sid)
    sid = sid[order]
    share = np.repeat(groups.column("none").to_numpy()[order][:, None], groups.column("terms")[0].as_py(), axis=1)
    share[np.searchsorted(sid, counts.column("sid").to_numpy()), counts.column("at").to_numpy()] = counts.column("share").to_numpy()
    value = [np.abs(share[k + 1 :] - share[k]).sum(axis=1) for k in range(len(sid))]
    first, second = np.triu_indices(len(sid), 1)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(first), pa.string()), "a": pa.array(sid[first]), "b": pa.array(sid[second]),
                     "value": pa.array(np.concatenate([np.zeros(0, np.int64), *value]))})


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, lang_col: str = "lang", source_col: str = "source",
               text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) of ``docs``.

    A term's share in a source is 1 + floor(SCALE * (n + ADDED) / (N + ADDED * V)): n its
    occurrences there, N those of all V kept terms of the language. Part ``pair`` has each
    other source of the language and the sum of the differences to its shares; part
    ``term`` the ``top`` terms whose share exceeds that in the whole language, and by how
    much. Ranks are by value, then by item.

    Null text, language and source are empty strings; every row is a document, also one
    with a repeated or null id; a language without kept terms gives pairs of value 0, a
    source alone in its language no pairs, an empty table nothing."""
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    ordered = numbered(cut_lineage(vocabulary(rows, min_docs)))
    counts = recount(rows, ordered)
    kept = ordered.groupBy("lang").agg(F.count("*").alias("v"), F.min("ordinal").alias("first"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = (rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(kept, "lang", "left")
              .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("first", F.lit(0)).alias("first"))
              .withColumn("total", F.col("n") + ADDED * F.col("v")))
    in_lang = Window.partitionBy("lang")
    groups = cut_lineage(groups.withColumn("sid", F.row_number().over(in_lang.orderBy("source")))
                         .withColumn("lang_total", F.sum("n").over(in_lang) + ADDED * F.col("v"))
                         .withColumn("step", F.greatest(F.lit(1), F.floor(BLOCK_CELLS / F.count("*").over(in_lang)))))

    shared = (counts.join(groups.select("lang", "source", "sid", "total", "lang_total", "first", "step"), ["lang", "source"])
              .withColumn("share", _share("n", "total")).withColumn("place", F.col("ordinal") - F.col("first")))
    cells = shared.select("lang", F.expr("place div step").alias("block"), "sid", F.expr("cast(place % step as int)").alias("at"), "share")
    blocks = (groups.withColumn("block", F.explode(F.expr("sequence(0L, greatest(0L, (v - 1) div step))")))
              .select(F.col("lang").alias("lang"), "block", F.col("sid").alias("sid"), _share("0", "total").alias("none"), F.expr("cast(least(step, v - block * step) as int)").alias("terms")))
    pairs = (cells.groupBy("lang", "block").cogroup(blocks.groupBy("lang", "block")).applyInArrow(_differences, _PAIR_SCHEMA)
             .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = pairs.unionAll(pairs.select("lang", "b", "a", "value"))
    names = groups.select("lang", "sid", "source")
    both = (both.join(names.withColumnRenamed("sid", "a"), ["lang", "a"])
            .join(names.select("lang", F.col("sid").alias("b"), F.col("source").alias("item")), ["lang", "b"]))
    by_group = Window.partitionBy("lang", "source")
    pair = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_group.orderBy(F.desc("value"), "item")).alias("rank"))

    whole = counts.groupBy("ordinal").agg(F.sum("n").alias("lang_n"))
    above = (shared.join(whole, "ordinal").withColumn("value", F.col("share") - _share("lang_n", "lang_total")).where("value > 0")
             .select("lang", "source", "ordinal", "value"))
    best = above.withColumn("rank", F.row_number().over(by_group.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    term = best.join(ordered.select("ordinal", "term"), "ordinal").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pair.unionAll(term)
