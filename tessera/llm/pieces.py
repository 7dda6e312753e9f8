"""SentencePiece encoding with N-best segmentation, and decoding.

Pieces and scores come from a model file. No piece spans the start of a word
(a run of spaces) or a line end, so a text splits into units with lattices of
their own. New units go through a forward Viterbi pass side by side, which
keeps the best and the second-best score; the forward scores of a unit are
exact heuristics for a backward A* search that lists its segmentations best
first (of equal ones that with the shorter last piece, the one that the Viterbi pass
keeps too). The N best segmentations of a text differ from the best one only in
the N - 1 units with the smallest loss, so only those are searched; the N best sums
of their alternatives are merged with the choices behind them, and the ids of every
rank follow by putting the chosen alternatives into those of the best one.

Scores are multiples of 2**-20, so that their sums are exact in any order.

A character without a piece takes the unknown score and is written as its
UTF-8 bytes. Every text decodes to itself (a dummy space goes before it).
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import mix

#: Default model file, and segmentations listed for a text.
MODEL, NBEST = "/opt/tokenizers/piece_bpe_32k.model", 4
#: Units remembered by a worker; characters of a unit that is encoded side by side.
CACHE, LANE = 200_000, 32
#: Units in a lane.
LANE_UNITS = 1 << 14
#: Texts whose new units are learned together, and bytes of them at which a share ends.
TEXTS, SHARE = 256, 4 << 20
#: Columns of an encoded row, and of digests beside its lists of ids.
ENCODED, DIGESTS = ("doc_id", "ids", "n_pieces", "nbest_ids", "nbest_scores", "round_trip"), ("ids_sha256", "nbest_sha256")
#: Penalty of an unknown character below the lowest score of a piece.
UNKNOWN = 10.0

_UNITS = re.compile(r" +[^ \n]*|\n|[^ \n]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GRAIN = 1 << 20


class Pieces:
    """Pieces of a model, as text with plain spaces."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor()
        sp.LoadFromSerializedProto(proto)
        n = sp.get_piece_size()
        self.score, self.bytes_of, self.byte_id = {}, [b""] * n, [0] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_of[i], self.byte_id[value] = bytes([value]), i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain = piece.replace("▁", " ")
                if "\n" in plain or " " in plain.lstrip(" "):
                    raise ValueError(f"piece {piece!r} spans units")
                self.score[plain] = (sp.get_score(i), i)
                self.bytes_of[i] = plain.encode()
        self.table = pa.array(self.bytes_of, pa.large_binary())
        self.score = {t: (round(s * _GRAIN) / _GRAIN, i) for t, (s, i) in self.score.items()}
        self.unknown = min(s for s, _ in self.score.values()) - UNKNOWN
        self.longest = max(map(len, self.score))
        # a trie by names: every prefix of a piece, with the piece that ends there or none
        prefixes = {t[:k] for t in self.score for k in range(1, len(t) + 1)}
        texts = sorted(prefixes, key=len)
        name = np.empty(len(texts), np.uint64)
        at = 0
        for width, group in itertools.groupby(texts, len):
            group = list(group)
            codes = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32).reshape(-1, width).astype(np.uint64)
            h = np.zeros(len(group), np.uint64)
            for k in range(width):
                h = _longer(h, codes[:, k])
            name[at : at + len(group)] = mix(h)
            at += len(group)
        order = np.argsort(name)
        self.name = name[order]
        found = [self.score.get(texts[k], (-np.inf, -1)) for k in order.tolist()]
        self.scores, self.ids = np.array([x for x, _ in found]), np.array([i for _, i in found], np.int32)
        # first guess of a name's place by its top bits
        self.slot = np.searchsorted(self.name, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46))

    def find(self, name: np.ndarray) -> np.ndarray:
        """Place of each name in the table of prefixes, or -1."""
        at = self.slot[(name >> np.uint64(46)).astype(np.int64)]
        found = np.full(len(name), -1)
        open_ = np.arange(len(name))
        while len(open_):
            # names are in order: a larger one ends the search
            here = self.name[np.minimum(at, len(self.name) - 1)]
            want = name[open_]
            hit = here == want
            found[open_[hit]] = at[hit]
            go = (here < want) & (at + 1 < len(self.name))
            open_, at = open_[go], at[go] + 1
        return found

    def edges(self, unit: str, end: int):
        """(start, score, ids) of the pieces that end at ``end``."""
        for start in range(end - 1, max(-1, end - self.longest - 1), -1):
            hit = self.score.get(unit[start:end])
            if hit:
                yield start, hit[0], (hit[1],)
            elif start == end - 1:
                yield start, self.unknown, tuple(self.byte_id[b] for b in unit[start:end].encode())

    def forward(self, unit: str, edges) -> list[float]:
        """Best score to every end; ``edges`` gives the pieces that end there."""
        alpha = [0.0] + [-np.inf] * len(unit)
        for end in range(1, len(unit) + 1):
            alpha[end] = max([alpha[s] + w for s, w, _ in edges(end)])
        return alpha

    def nbest(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations, best first: backward A* with the forward scores."""
        # of a short unit the pieces are looked up once for both passes
        ends = [list(self.edges(unit, end)) for end in range(len(unit) + 1)] if len(unit) <= LANE else None
        edges = partial(self.edges, unit) if ends is None else ends.__getitem__
        alpha = self.forward(unit, edges)
        # equal estimates by the widths of the pieces from the end on: they tell all paths apart
        heap, out = [(-alpha[-1], (), len(unit), 0.0, ())], []
        while heap and len(out) < n:
            _, widths, at, done, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((done, tuple(ids)))
                continue
            for start, w, ids in edges(at):
                heapq.heappush(heap, (-(alpha[start] + w + done), (*widths, at - start), start, done + w, (ids, path)))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def decodes(self, ranks: list[bytes], text: str) -> bool:
        """Whether every one of ``ranks`` (ids as int32 bytes) decodes to the text."""
        want = (" " + text).encode() if text else b""
        taken = self.table.take(pa.array(np.frombuffer(b"".join(ranks), np.int32)))
        ends = np.frombuffer(taken.buffers()[1], np.int64) if len(taken) else np.zeros(1, np.int64)
        cuts = ends[np.cumsum([0, *[len(r) // 4 for r in ranks]])].tolist()
        made = taken.buffers()[2].to_pybytes() if len(taken) else b""
        return all(made[a:b] == want for a, b in zip(cuts[:-1], cuts[1:]))


def _longer(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Unmixed name of a text with one character more."""
    return h * np.uint64(0xD1342543DE82EF95) + (code + np.uint64(1)) * _STEP


class Encoder:
    """Units met by a worker: best ids, best score and loss of the second-best."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self):
        self.code: dict[str, int] = {}
        self.ids: list[bytes] = []
        #: best score, loss of the second-best, bytes of the ids, and whether they decode to the unit
        self.score, self.loss, self.size, self.same = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)
        self.lists: dict[str, list] = {}

    def learn(self, units) -> None:
        """Adds distinct units that are not known yet."""
        new = list(units)
        if not new:
            return
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
        score, loss, ids = np.zeros(len(new)), np.zeros(len(new)), [b""] * len(new)
        same = np.ones(len(new), bool)
        size = np.fromiter(map(len, new), np.int64, len(new))
        for k in np.flatnonzero(size > LANE).tolist():
            score[k], loss[k], ids[k], same[k] = self._alone(new[k])
        order = np.argsort(size, kind="stable")
        cuts = np.searchsorted(size[order], np.arange(1, LANE + 2))
        for width, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()), 1):
            for c in range(a, b, LANE_UNITS):
                at = order[c : min(b, c + LANE_UNITS)]
                self._lanes([new[k] for k in at.tolist()], width, at, score, loss, ids, same)
        self.score, self.loss = np.r_[self.score, score], np.r_[self.loss, loss]
        self.size, self.same = np.r_[self.size, np.fromiter(map(len, ids), np.int64, len(ids))], np.r_[self.same, same]
        self.ids += ids

    def _alone(self, unit: str) -> tuple[float, float, bytes, bool]:
        """Best score, loss of the second-best, best ids and whether they decode, by the search."""
        best = self.pieces.nbest(unit, 2)
        return best[0][0], best[0][0] - best[1][0] if len(best) > 1 else np.inf, np.array(best[0][1], np.int32).tobytes(), self._decodes(best[0][1], unit)

    def _decodes(self, ids, unit: str) -> bool:
        return b"".join(map(self.pieces.bytes_of.__getitem__, ids)) == unit.encode()

    def _lanes(self, units, width, at, score, loss, ids, same):
        """Units of the same width, side by side: two best scores to every end."""
        p, n = self.pieces, len(units)
        top = min(width, p.longest)
        whole = "".join(units)
        codes = np.ascontiguousarray(np.frombuffer(whole.encode("utf-32-le"), np.uint32).reshape(n, width).T).astype(np.uint64)
        # pieces by width, start and unit: walk the trie from all starts, as far as prefixes go
        place = np.full((top + 1, width, n), -1, np.int32)
        flat, alive = place.reshape(top + 1, -1), np.arange(width * n)
        h = np.zeros(width * n, np.uint64)
        spread = codes.reshape(-1)
        for w in range(1, top + 1):
            go = alive < (width - w + 1) * n
            alive, h = alive[go], h[go]
            h = _longer(h, spread[alive + (w - 1) * n])
            hit = p.find(mix(h))
            go = hit >= 0
            alive, h, hit = alive[go], h[go], hit[go]
            if not len(alive):
                break
            flat[w, alive] = hit
        best, second = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
        step = np.zeros((width + 1, n), np.int8)
        best[0] = 0
        scores = np.r_[p.scores, -np.inf]
        for end in range(1, width + 1):
            b, s2, st = best[end], second[end], step[end]
            for w in range(1, min(end, top) + 1):
                got = place[w, end - w]
                s = scores[got]
                if w == 1:
                    s = np.where(np.isneginf(s), p.unknown, s)
                elif not (got >= 0).any():
                    continue
                one, two = best[end - w] + s, second[end - w] + s
                np.maximum(s2, np.maximum(two, np.minimum(b, one)), out=s2)
                st[one > b] = w
                np.maximum(b, one, out=b)
        score[at], loss[at] = best[width], best[width] - second[width]
        # the best path from the end on; a character without a piece is marked
        where, rows, path, unknown = np.full(n, width), np.arange(n), [], np.zeros(n, bool)
        live = rows
        while len(live):
            w = step[where[live], live].astype(np.int64)
            start = where[live] - w
            got = place[w, start, live]
            piece = np.where(got >= 0, p.ids[got], -1)
            unknown[live[piece < 0]] = True
            column = np.full(n, -1, np.int32)
            column[live] = piece
            path.append(column)
            where[live] = start
            live = live[start > 0]
        known = np.flatnonzero(~unknown)
        taken = np.stack(path[::-1], axis=1)[known]
        there = taken >= 0
        flat_ids, ends = taken[there], np.cumsum(there.sum(axis=1))
        raw, cut = flat_ids.tobytes(), (4 * np.r_[0, ends]).tolist()
        for k, a, b in zip(at[known].tolist(), cut[:-1], cut[1:]):
            ids[k] = raw[a:b]
        text = whole if len(known) == n else "".join([units[k] for k in known.tolist()])
        if b"".join(map(p.bytes_of.__getitem__, flat_ids.tolist())) != text.encode():
            for k, a, b in zip(known.tolist(), cut[:-1], cut[1:]):
                same[at[k]] = self._decodes(np.frombuffer(raw[a:b], np.int32).tolist(), units[k])
        for k in np.flatnonzero(unknown).tolist():
            row, end = [], width
            while end:
                w = int(step[end, k])
                got = int(place[w, end - w, k])
                row.append((int(p.ids[got]),) if got >= 0 and p.ids[got] >= 0 else tuple(p.byte_id[b] for b in units[k][end - 1 : end].encode()))
                end -= w
            found = [i for part in reversed(row) for i in part]
            ids[at[k]], same[at[k]] = np.array(found, np.int32).tobytes(), self._decodes(found, units[k])

    def encode(self, text: str, n: int) -> list[tuple[bytes, float]]:
        """(ids as int32 bytes, score) of the ``n`` best segmentations, best first."""
        units = _UNITS.findall(" " + text) if text else []
        self.learn(dict.fromkeys(u for u in units if u not in self.code))
        return self.encode_units(units, n)[0]

    def encode_units(self, units: list[str], n: int) -> tuple[list[tuple[bytes, float]], bool]:
        """``encode`` of a text's learned units, and whether every listed one decodes to it."""
        if not units:
            return [(b"", 0.0)], True
        at = np.fromiter(map(self.code.__getitem__, units), np.int64, len(units))
        best = b"".join(map(self.ids.__getitem__, at.tolist()))
        total, same = float(self.score[at].sum()), bool(self.same[at].all())
        loss = self.loss[at]
        few = np.flatnonzero(loss <= np.partition(loss, n - 2)[n - 2]) if len(loss) > n - 1 and n > 1 else np.arange(len(loss))
        few = few[np.argsort(loss[few], kind="stable")][: n - 1]
        # (loss, choice for each of the few units): the best n sums so far
        sums: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        lists = [self._list(units[k], n) for k in few.tolist()]
        for options in lists:
            sums = heapq.nsmallest(n, ((x + options[0][0] - o[0], (*chosen, j)) for x, chosen in sums for j, o in enumerate(options)))
        if len(sums) == 1:
            return [(best, total)], same
        end = np.cumsum(self.size[at])
        order = sorted(range(len(lists)), key=lambda k: few[k])
        out = []
        for lost, chosen in sums:
            parts, done = [], 0
            for k in order:
                if chosen[k]:
                    b = int(end[few[k]])
                    parts += [best[done : b - int(self.size[at[few[k]]])], lists[k][chosen[k]][1]]
                    same &= lists[k][chosen[k]][2]
                    done = b
            out.append((b"".join([*parts, best[done:]]) if done else best, total - lost))
        return out, same

    def _list(self, unit: str, n: int) -> list[tuple[float, bytes, bool]]:
        """(score, ids, whether they decode) of the ``n`` best segmentations of a unit."""
        key = (unit, n)
        if key not in self.lists:
            if len(self.lists) > CACHE // 4:
                self.lists.clear()
            self.lists[key] = [(s, np.array(i, np.int32).tobytes(), self._decodes(i, unit)) for s, i in self.pieces.nbest(unit, n)]
        return self.lists[key]


_encoders: dict[bytes, Encoder] = {}


def encoder(proto: bytes) -> Encoder:
    """The worker's encoder for a model."""
    key = hashlib.sha256(proto).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(Pieces(proto))
    return _encoders[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(rows: list[bytes]) -> pa.ListArray:
    """An Arrow list of numbers for each blob of 32-bit ids."""
    ends = np.cumsum([0, *[len(r) // 4 for r in rows]], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def _shares(texts: pa.Array):
    """(first, how many) of the texts that are learned together: ``TEXTS`` at most, fewer where they are long."""
    a = size = 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if k + 1 - a == TEXTS or size >= SHARE or k + 1 == len(texts):
            yield a, k + 1 - a
            a, size = k + 1, 0


def _encode(batches, proto, nbest, digest, both):
    enc = encoder(proto.value)
    kind = pa.list_(pa.string())
    for batch in batches:
        texts = batch.column(1)
        # new units of many texts are learned together, and answered together
        for a, many in _shares(texts):
            part = [t or "" for t in texts.slice(a, many).to_pylist()]
            units = [_UNITS.findall(" " + t) if t else [] for t in part]
            if len(enc.code) > CACHE:
                enc.clear()
            enc.learn(set().union(*units) - enc.code.keys())
            size, ranks, scores, same = [], [], [], []
            for t, u in zip(part, units):
                found, decodes = enc.encode_units(u, nbest)
                size.append(len(found[0][0]) // 4)
                scores.append([s for _, s in found])
                ranks.append([i for i, _ in found])
                same.append(decodes and enc.pieces.decodes([i for i, _ in found], t))
            part = units = t = u = found = None
            cols = {"doc_id": batch.column(0).slice(a, many), "n_pieces": pa.array(size, pa.int64()),
                    "nbest_scores": pa.array(scores, pa.list_(pa.float64())), "round_trip": pa.array(same, pa.bool_())}
            if digest or both:
                shown = [[hashlib.sha256(i).hexdigest() for i in r] for r in ranks]
                cols |= dict(zip(("ids", "nbest_ids") if digest else DIGESTS, (pa.array([r[0] for r in shown], pa.string()), pa.array(shown, kind))))
            if not digest:
                cols["ids"] = _lists([r[0] for r in ranks])
                ends = np.cumsum([0, *map(len, ranks)], dtype=np.int32)
                cols["nbest_ids"] = pa.ListArray.from_arrays(pa.array(ends), _lists([i for r in ranks for i in r]))
            cols |= {name: batch.column(k).slice(a, many) for k, name in enumerate(batch.schema.names) if k > 1}
            names = [n for n in (*ENCODED, *DIGESTS, *batch.schema.names[2:]) if n in cols]
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)
            cols = ranks = scores = shown = None
        del batch, texts
    # a worker serves other stages next: leave them the memory
    enc.clear()
    pa.default_memory_pool().release_unused()


def encode_pieces(docs: DataFrame, model: str = MODEL, nbest: int = NBEST, id_col: str = "doc_id", text_col: str = "text",
                  digest: bool = False, keep: dict | None = None, both: bool = False) -> DataFrame:
    """doc_id, ids (of the best segmentation), n_pieces, nbest_ids (of the ``nbest`` best ones,
    best first, fewer where a text has fewer), nbest_scores and round_trip (every listed one
    decodes to the text). With ``digest`` lists of ids are given as the SHA-256 of the ids as
    little-endian 32-bit numbers; with ``both`` these stand beside the lists, as ``ids_sha256`` and
    ``nbest_sha256``. ``keep`` adds columns by name, each a Column over ``docs``.

    A null text is read as empty: no ids, one score of 0. Repeated rows and null ids
    are answered each; an empty table gives none. The model (bounded by its file) is
    read on the driver and broadcast."""
    spark: SparkSession = docs.sparkSession
    proto = spark.sparkContext.broadcast(_read(model))
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                      *[c.alias(name) for name, c in (keep or {}).items()])
    kind = "string" if digest else "array<int>"
    shown = f", {DIGESTS[0]} string, {DIGESTS[1]} array<string>" if both and not digest else ""
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[2:])
    return src.mapInArrow(partial(_encode, proto=proto, nbest=nbest, digest=digest, both=both),
                          f"doc_id long, ids {kind}, n_pieces long, nbest_ids array<{kind}>, nbest_scores array<double>, round_trip boolean{shown}{kept}")


def _decode(batches, proto):
    pieces = encoder(proto.value).pieces
    for batch in batches:
        text = [None if x is None else pieces.decode(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])


def decode_pieces(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of encoded rows; null ids give null."""
    proto = encoded.sparkSession.sparkContext.broadcast(_read(model))
    src = encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    return src.mapInArrow(partial(_decode, proto=proto), "doc_id long, text string")
