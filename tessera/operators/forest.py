"""Random forests that stay on the cluster (M3-M5).

Rows are binned by quantiles of a bounded sample, and every tree draws its bag and
its features by hashes of seed, tree, row and node, so that a forest does not depend
on how rows are dealt. Nodes with many rows are split by histograms summed over
all tasks; a node with few goes to one task with its rows, which grows the rest of
it. Trees and votes are tables: the driver holds the splits of the large nodes only.
Where whole trees fit in a task and nobody asks for the forest itself, a task grows some
trees and judges the rows by them at once, so that only the rows and the summed votes move.

Counts are whole numbers and votes are summed as such, so results repeat exactly.
"""

from __future__ import annotations

from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions._util import guard
from tessera.session import cut_lineage

#: Bins of a feature and rows (those with the smallest hashes) whose quantiles bound them.
BINS, SAMPLE_ROWS = 32, 10_000
#: Rows of a tree's bag in a node that one task takes (about 150 bytes each while it grows).
LOCAL_ROWS = 1 << 20
#: Values sorted together, rows whose bins are counted together, and rows walked and cells of votes added up together:
#: as many as stay in a core's cache. A node with a DENSE-th as many rows as bins times classes is counted by all its bins.
BLOCK, COUNTED_ROWS, WALKED_ROWS, VOTE_CELLS, DENSE = 1 << 14, 1 << 14, 1 << 13, 1 << 20, 16
#: Tasks among which trees are dealt at least, trees in an Arrow batch, and rows judged together.
TASKS, TREES, TEST_ROWS = 64, 32, 1024
#: Bits of a bin, and of how often a bag draws one row.
BIN_BITS, DRAW_BITS = 5, 4
#: A vote of one tree, in whole parts.
VOTE = 1 << 40

_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tree_hash(seed: int, tree: int) -> np.ndarray:
    return mixed(np.array([(seed * 0x9E3779B97F4A7C15 + tree + 1) % (1 << 64)], np.uint64))


def bag(rid: np.ndarray, root: np.ndarray) -> np.ndarray:
    """How often a tree draws each row: Poisson with mean 1."""
    u = (mixed(rid.view(np.uint64) ^ root) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.searchsorted(_POISSON, u, side="right")


class Top(NamedTuple):
    """Splits of a tree's large nodes: feature (-1: not split), bin, left child (the right one
    follows), hash and depth of each."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    name: np.ndarray
    depth: np.ndarray


def linked(feature: np.ndarray, bins: np.ndarray, left: np.ndarray):
    """Each node of a tree in one number (left child, bin, feature; a leaf leads to itself), and whether it is a leaf."""
    leaf = feature < 0
    node = np.where(leaf, np.arange(len(feature)), left).astype(np.int64) << 24
    return node + (np.where(leaf, 255, bins).astype(np.int64) << 16) + np.where(leaf, 0, feature), leaf


def walked(tree, x: np.ndarray) -> np.ndarray:
    """Last node of each row's path in a linked tree."""
    nodes, leaf = tree
    flat, line, n = np.ascontiguousarray(x).reshape(-1), np.arange(len(x)) * x.shape[1], np.zeros(len(x), np.int64)
    last, live = n.copy(), np.arange(len(x))
    while len(live):
        for _ in range(4):
            node = nodes.take(n)
            n = (node >> 24) + (flat.take(line + (node & 65535)) > (node >> 16 & 255))
        last[live] = n
        on = np.flatnonzero(~leaf.take(n))
        live, line, n = live.take(on), line.take(on), n.take(on)
    return last


def walk(feature: np.ndarray, bins: np.ndarray, left: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Last node of each row's path."""
    return walked(linked(feature, bins, left), x)


class Cells(NamedTuple):
    """Cells (node, feature, bin) that hold rows, in that order: rows up to the bin, and the
    squares of the counts by class summed, up to the bin and beyond it."""

    node: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    rows: np.ndarray
    below: np.ndarray
    above: np.ndarray


def best_splits(cells: Cells, total: np.ndarray):
    """(feature or -1, bin, gain times rows) of the best Gini split of each node; the first of equal
    ones. ``total`` gives the counts of all nodes by class, and every node has a cell."""
    n = total.sum(axis=1).astype(float)
    own = (total.astype(float) ** 2).sum(axis=1) / n
    node, rest = cells.node, n[cells.node] - cells.rows
    gain = np.where(rest > 0, cells.below / cells.rows + cells.above / np.maximum(rest, 1) - own[node], 0.0)
    top = np.maximum.reduceat(gain, _runs(node)[0])
    hit = np.flatnonzero(gain == top[node])
    hit = hit[_runs(node[hit])[0]]
    better = top > 1e-9 * n  # rounding of a split that gains nothing
    return np.where(better, cells.feature[hit], -1), np.where(better, cells.bin[hit], 0), np.where(better, top, 0.0)


def packed(x, y, w) -> np.ndarray:
    """Class, bin and times drawn of each row and feature in one number, the class first."""
    return (((y.astype(np.int64)[:, None] << BIN_BITS) + x) << DRAW_BITS) + w.astype(np.int64)[:, None]


def counted(code, rows, of, features, total: np.ndarray) -> Cells:
    """The cells of nodes by the features that each may take (node by feature, ascending). ``of`` is
    the node of each of ``rows``, ``code`` their packed values, ``total`` the counts of the nodes by class.

    Rows are sorted by node, feature, class and bin, so that the cost goes with rows and
    features taken, not with classes or empty bins: a row that raises a count k by w raises its square by w (2k + w)."""
    return _cells(code.ravel()[rows[:, None] * code.shape[1] + features[of]], of, features, total)


def _cells(code, of, features, total: np.ndarray) -> Cells:
    """``counted`` of the packed values of each row and feature taken; numbers of 32 bits where they suffice."""
    m, low, nodes = features.shape[1], BIN_BITS + DRAW_BITS, len(total)
    bits, spread, parts = int(total.shape[1] - 1).bit_length(), int(code.size).bit_length(), int(nodes * m).bit_length()
    kind = np.int32 if max(parts + bits + low, parts + BIN_BITS + spread) < 32 else np.int64
    part = (of.astype(kind) * kind(m << bits + low))[:, None] + (np.arange(m, dtype=kind) << kind(bits + low))
    code = np.sort((part + code).astype(kind, copy=False).ravel())
    times = (code & kind((1 << DRAW_BITS) - 1)).astype(np.int64)
    # rows of a class of a node: its count so far, and in all
    new, size = _runs(code >> kind(low))
    run = np.cumsum(times)
    before = np.r_[0, run[new[1:] - 1]]
    whole = np.repeat(np.diff(before, append=run[-1]), size)
    squares, both = times * (2 * (run - np.repeat(before, size)) - times), times * whole
    # from class to bin order
    place = (code >> kind(bits + low) << kind(BIN_BITS)) + (code >> kind(DRAW_BITS) & kind(BINS - 1))
    order = np.sort((place << kind(spread)) + np.arange(len(place), dtype=kind))
    place, order = order >> kind(spread), order & kind((1 << spread) - 1)
    last = np.flatnonzero(np.r_[place[1:] != place[:-1], True])
    place = place[last]
    part = place >> kind(BIN_BITS)
    n, own = total.sum(axis=1), (total * total).sum(axis=1)

    def up_to(values, in_node):
        """Sums up to the end of each cell, from the start of its part; every part of a node holds ``in_node``."""
        start = np.repeat(in_node, m)
        return np.cumsum(values.take(order)).take(last) - (np.cumsum(start) - start).take(part)

    # three sums in one where they fit side by side
    wide = int(n.max()).bit_length()
    if 5 * wide < 63:
        sums = up_to(times + (both << wide) + (squares << 3 * wide), n + (own << wide) + (own << 3 * wide))
        rows, both, below = sums & (1 << wide) - 1, sums >> wide & (1 << 2 * wide) - 1, sums >> 3 * wide
    else:
        rows, both, below = up_to(times, n), up_to(both, own), up_to(squares, own)
    node = np.repeat(np.arange(nodes), m).take(part)
    return Cells(node, features.reshape(-1).take(part), place & kind(BINS - 1), rows, below, own.take(node) - 2 * both + below)


def _runs(values: np.ndarray):
    """Where each run of equal values starts, and its length."""
    start = np.empty(len(values), bool)
    start[0] = True
    np.not_equal(values[1:], values[:-1], out=start[1:])
    start = np.flatnonzero(start)
    return start, np.diff(start, append=len(values))


def drawn(name: np.ndarray, d: int) -> np.ndarray:
    """The features that each node may split by: the square root of all, by hash."""
    m = int(np.ceil(np.sqrt(d)))
    score = np.stack([mixed(name + np.uint64(2 * f + 3)) for f in range(d)], axis=1)
    return np.argsort(np.argsort(score, axis=1, kind="stable"), axis=1, kind="stable") < m


def taken(name: np.ndarray, d: int) -> np.ndarray:
    """The numbers of these features, ascending, by node."""
    m = int(np.ceil(np.sqrt(d)))
    score = np.stack([mixed(name + np.uint64(2 * f + 3)) for f in range(d)], axis=1)
    return np.sort(np.argsort(score, axis=1, kind="stable")[:, :m], axis=1)


def children(name: np.ndarray) -> np.ndarray:
    """Hashes of both children of each node, side by side."""
    return np.stack([mixed(name * np.uint64(2) + np.uint64(1)), mixed(name * np.uint64(2))], axis=1).reshape(-1)


def _together(size: np.ndarray, most: int):
    """Ranges of nodes of ``most`` rows together, or one node, and the ranges of their rows."""
    ends = np.r_[0, np.cumsum(size)]
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        yield a, b, int(ends[a]), int(ends[b])
        a = b


def _split_large(flat, line, code, size, features, total):
    """``best_splits`` of nodes with rows for most bins: counts by class, bin and node, a feature at a time. Rows lie by node,
    their bins in ``flat`` from ``line`` on."""
    out = []
    for a, b, start, stop in _together(size, COUNTED_ROWS):
        n, classes = b - a, total.shape[1]
        of, here = np.repeat(np.arange(n), size[a:b]), code[start:stop]
        times = (here & (1 << DRAW_BITS) - 1).astype(float)
        key = (here >> BIN_BITS + DRAW_BITS) * (BINS * n) + of
        t = total[a:b].T.astype(float)
        rows_of = t.sum(axis=0)
        own = (t * t).sum(axis=0) / rows_of
        best, feature, at = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64)
        for f in features[a:b].T:
            value = flat.take(line[start:stop] + np.repeat(f, size[a:b]))
            low = np.bincount(key + value * np.int64(n), times, classes * BINS * n).reshape(classes, BINS, n)
            np.cumsum(low, axis=1, out=low)
            rows = low.sum(axis=0)
            below = (low * low).sum(axis=0)
            np.subtract(t[:, None, :], low, out=low)
            rest = rows_of - rows
            gain = below / np.maximum(rows, 1) + np.multiply(low, low, out=low).sum(axis=0) / np.maximum(rest, 1) - own
            gain[(rows == 0) | (rest == 0)] = 0.0
            bins = gain.argmax(axis=0)
            top = gain[bins, np.arange(n)]
            better = top > best
            best, feature, at = np.where(better, top, best), np.where(better, f, feature), np.where(better, bins, at)
        better = best > 1e-9 * rows_of  # as in best_splits
        out.append((np.where(better, feature, -1), np.where(better, at, 0), np.where(better, best, 0.0)))
    return [np.concatenate(c) for c in zip(*out)]


def _split_small(flat, line, code, size, features, total):
    """The same of nodes with few rows, by the bins that they have."""
    m, out = features.shape[1], []
    for a, b, start, stop in _together(size, BLOCK // m):
        of = np.repeat(np.arange(b - a), size[a:b])
        value = flat.take(line[start:stop, None] + features[a:b].take(of, axis=0))
        packed_ = code[start:stop, None].astype(np.int32) + (value.astype(np.int32) << DRAW_BITS)
        out.append(best_splits(_cells(packed_, of, features[a:b], total[a:b]), total[a:b]))
    return [np.concatenate(c) for c in zip(*out)]


def _best(x, code, size, open_, features, total):
    """``best_splits`` of the nodes ``open_`` of those that the rows lie by, counted by the cheaper way."""
    large = size[open_] * DENSE >= BINS * total.shape[1]
    found = [np.empty(len(open_), t) for t in (np.int64, np.int64, float)]
    for which, by in ((large, _split_large), (~large, _split_small)):
        if which.any():
            counts = np.zeros(len(size), bool)
            counts[open_[which]] = True
            rows = np.flatnonzero(np.repeat(counts, size))
            for whole, some in zip(found, by(x.reshape(-1), rows * x.shape[1], code.take(rows), size[counts], features[which], total[which])):
                whole[which] = some
    return found


def grown(x, y, w, n_classes: int, name, depth: int, max_depth: int):
    """Nodes of a (sub)tree, level by level: feature (-1: leaf), bin, left child, counts by class;
    and the gains by feature. Rows are kept in the order of their nodes."""
    d, low = x.shape[1], BIN_BITS + DRAW_BITS
    x, code = np.ascontiguousarray(x), (np.asarray(y).astype(np.int64) << low) + np.asarray(w).astype(np.int64)
    size, names = np.array([len(x)]), name.copy()
    out, gains, placed = [], np.zeros(d), 1
    while len(names):
        n, node = len(names), np.repeat(np.arange(len(names)), size)
        total = np.bincount(node * n_classes + (code >> low), code & (1 << DRAW_BITS) - 1, n * n_classes).reshape(n, n_classes).astype(np.int64)
        feature, at = np.full(n, -1), np.zeros(n, np.int64)
        open_ = np.flatnonzero((total > 0).sum(axis=1) > 1) if depth < max_depth else np.zeros(0, np.int64)
        if len(open_):
            feature[open_], at[open_], gain = _best(x, code, size, open_, taken(names[open_], d), total[open_])
            gains += np.bincount(np.maximum(feature[open_], 0), gain, d)
        split = np.flatnonzero(feature >= 0)
        left = np.zeros(n, np.int64)
        left[split] = placed + 2 * np.arange(len(split))
        out.append((feature, at, left, np.where((feature < 0)[:, None], total, 0)))
        if len(split):
            x, code, size = _children_rows(x, code, size, feature, at)
        names, placed, depth = children(names[split]), placed + 2 * len(split), depth + 1
    return [np.concatenate([o[k] for o in out]) for k in range(4)], gains


def _children_rows(x, code, size, feature, at):
    """Rows in the order of the children of the nodes that are split, and the rows of each child."""
    right = x.reshape(-1).take(np.arange(len(x)) * x.shape[1] + np.repeat(np.maximum(feature, 0), size)) > np.repeat(at, size)
    ends = np.cumsum(size)
    before = np.r_[0, np.cumsum(right)]
    rights = before[ends] - before[ends - size]
    # a row goes behind the rows of its side that stand before it in its node
    place = np.where(right, before[:-1] + np.repeat(ends - rights - before[ends - size], size), np.arange(len(x)) - before[:-1] + np.repeat(before[ends - size], size))
    order = np.empty(len(x), np.int64)
    order[place] = np.arange(len(x))
    go = feature >= 0
    if not go.all():
        order = order[np.repeat(go, size)]
    return x.take(order, axis=0), code.take(order), np.stack([size - rights, rights], axis=1)[go].reshape(-1)


# --- in the tasks ----------------------------------------------------------------
def _binned(batches, edges):
    for batch in batches:
        x = np.stack([np.searchsorted(e, c.to_numpy(zero_copy_only=False)) for e, c in zip(edges, batch.columns[2:])], axis=1).astype(np.uint8) \
            if batch.num_rows else np.zeros((0, len(edges)), np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["rid", "y", "x"])


def _matrix(column, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, d)


def _leaves(tops, tree: int, x: np.ndarray) -> np.ndarray:
    top = tops.get(tree)
    return np.zeros(len(x), np.int64) if top is None else walk(top.feature, top.bin, top.left, x)


def _parts(leaf: np.ndarray):
    """(leaf, its places) of the leaves that hold rows."""
    order = np.argsort(leaf, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
        if len(part):
            yield int(leaf[part[0]]), part


def _batch(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _deal(batches, tops, trees, seed, d):
    """The bag of every tree, by the node that a task takes."""
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    for batch in batches:
        rid, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint16), _matrix(batch.column(2), d)
        rows = []
        for tree in range(trees):
            w = bag(rid, tree_hash(seed, tree))
            have = np.flatnonzero(w)
            for leaf, part in _parts(_leaves(tops, tree, x[have])):
                at = have[part]
                rows.append((tree, leaf, x[at].tobytes(), y[at].tobytes(), w[at].astype(np.uint8).tobytes()))
            if rows and (tree % TREES == TREES - 1 or tree == trees - 1):
                yield _batch(rows, ["tree", "leaf", "x", "y", "w"], types)
                rows = []


def _histograms(batches, tops, trees, seed, d, classes, wanted):
    """Counts (node, feature, bin, class) of the nodes in ``wanted``, by tree."""
    for batch in batches:
        rid, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), d)
        for tree in sorted(wanted):
            w = bag(rid, tree_hash(seed, tree))
            have = np.flatnonzero(w)
            rows = []
            for leaf, part in _parts(_leaves(tops, tree, x[have])):
                if leaf in wanted[tree]:
                    at = have[part]
                    counts = [np.bincount(x[at, f].astype(np.int64) * classes + y[at], w[at], BINS * classes) for f in range(d)]
                    rows.append((tree, leaf, np.concatenate(counts).astype(np.int64).tobytes()))
            if rows:
                yield _batch(rows, ["tree", "leaf", "counts"], [pa.int32(), pa.int32(), pa.binary()])


def _choose(key, table, names, d, classes):
    tree, leaf = key[0].as_py(), key[1].as_py()
    counts = reduce(np.add, (np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist())).reshape(d, BINS, classes)
    total = counts[0].sum(axis=0)[None]
    features = taken(names[tree, leaf], d)[0]
    run = counts[features].cumsum(axis=1)
    f, used = np.nonzero(counts[features].sum(axis=2))
    low = run[f, used]
    cells = Cells(np.zeros(len(f), np.int64), features[f], used, low.sum(axis=1), (low**2).sum(axis=1), ((total - low) ** 2).sum(axis=1))
    feature, at, gain = best_splits(cells, total) if (total > 0).sum() > 1 else ([-1], [0], [0.0])
    below = int(counts[feature[0], : at[0] + 1].sum()) if feature[0] >= 0 else 0
    return pa.table({"tree": pa.array([tree], pa.int32()), "leaf": pa.array([leaf], pa.int32()), "feature": pa.array([int(feature[0])], pa.int32()),
                     "bin": pa.array([int(at[0])], pa.int32()), "gain": pa.array([float(gain[0])]), "below": pa.array([below], pa.int64()),
                     "rows": pa.array([int(total.sum())], pa.int64())})


def _tree(nodes, gains):
    """The columns of ``_TREE`` of grown nodes, and their gains."""
    feature, at, left, counts = nodes
    node, cls = np.nonzero(counts)
    return (feature.astype(np.int16), at.astype(np.uint8), left.astype(np.int32), node.astype(np.int32), cls.astype(np.uint16), counts[node, cls].astype(np.int32)), gains


def _grow(key, table, tops, seed, d, classes, max_depth):
    tree, leaf = key[0].as_py(), key[1].as_py()
    x = _matrix(table.column("x"), d)
    y = np.frombuffer(b"".join(table.column("y").to_pylist()), np.uint16).astype(np.int64)
    w = np.frombuffer(b"".join(table.column("w").to_pylist()), np.uint8).astype(np.int64)
    top = tops.get(tree)
    name, depth = (tree_hash(seed, tree), 0) if top is None else (top.name[leaf : leaf + 1], int(top.depth[leaf]))
    blobs, gains = _tree(*grown(x, y, w, classes, name, depth, max_depth))
    return pa.table({"tree": pa.array([tree], pa.int32()), "leaf": pa.array([leaf], pa.int32()), "gains": pa.array([gains.tolist()], pa.list_(pa.float64())),
                     **{n: pa.array([b.tobytes()], pa.binary()) for n, b in zip(_TREE, blobs)}})


_TREE = ("feature", "bin", "left", "node", "cls", "n")
_TREE_SCHEMA = "tree int, leaf int, gains array<double>, " + ", ".join(f"{c} binary" for c in _TREE)


def _ask(batches, tops, trees, d):
    """The rows to be judged, by tree and by the node of it that one task grew."""
    task, k = TaskContext.get().partitionId(), 0
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        for a in range(0, batch.num_rows, TEST_ROWS):
            part = batch.slice(a, TEST_ROWS)
            rid, x = part.column(0).to_numpy(), _matrix(part.column(2), d)
            rows = []
            for tree in range(trees):
                for leaf, at in _parts(_leaves(tops, tree, x)):
                    rows.append((tree, leaf, (task << 32) + k, rid[at].tobytes(), x[at].tobytes()))
                if rows and (tree % TREES == TREES - 1 or tree == trees - 1):
                    yield _batch(rows, ["tree", "leaf", "block", "rid", "x"], types)
                    rows = []
            k += 1


def _voting(feature, at, left, node, n):
    """A tree as it votes: linked, and of each node its first entry, how many it has, and the vote of every entry."""
    total, count = np.bincount(node, n, len(feature)), np.bincount(node, minlength=len(feature))
    return linked(feature, at, left), np.searchsorted(node, np.arange(len(feature))), count, np.round(n / total[node] * VOTE).astype(np.int64)


def _entries(last, first, count):
    """How many entries the last node of each row has, and these entries."""
    many = count[last]
    return many, np.repeat(first[last] - np.cumsum(many) + many, many) + np.arange(many.sum())


_VOTES = "block long, rid binary, cls binary, vote binary"


def _blocks(batches):
    """The rows of a batch in one row."""
    for batch in batches:
        if batch.num_rows:
            cols = [batch.column(0).to_numpy().tobytes(), batch.column(1).to_numpy().astype(np.uint16).tobytes(), b"".join(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols], names=["rid", "y", "x"])


def _ask_all(batches):
    """The rows to be judged, in blocks."""
    task, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        for a in range(0, batch.num_rows, TEST_ROWS):
            part = batch.slice(a, TEST_ROWS)
            yield _batch([((task << 32) + k, part.column(0).to_numpy().tobytes(), b"".join(part.column(2).to_pylist()))],
                         ["block", "rid", "x"], [pa.int64(), pa.binary(), pa.binary()])
            k += 1


def _grow_and_vote(key, table, asked, packs, trees, seed, d, classes, max_depth):
    """The trees of a pack, grown from all rows, and the sums of their votes as ``_vote`` gives those of one."""
    if not asked.num_rows or not table.num_rows:
        return pa.table({"block": pa.array([], pa.int64()), "rid": pa.array([], pa.binary()), "cls": pa.array([], pa.binary()), "vote": pa.array([], pa.binary())})
    rid, y = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("rid", np.int64), ("y", np.uint16)))
    x, voters = _matrix(table.column("x"), d), []
    for tree in range(key[0].as_py(), trees, packs):
        root = tree_hash(seed, tree)
        w = bag(rid, root)
        have = np.flatnonzero(w)
        if len(have):  # an empty bag votes for nobody
            (feature, at, left, node, cls, n), _ = _tree(*grown(x[have], y[have], w[have], classes, root, 0, max_depth))
            voters.append((cls, *_voting(feature, at, left, node, n)))
    ids, x = np.frombuffer(b"".join(asked.column("rid").to_pylist()), np.int64), _matrix(asked.column("x"), d)
    block = np.repeat(asked.column("block").to_numpy(), [len(r) // 8 for r in asked.column("rid").to_pylist()])
    out, step = [], max(1, min(WALKED_ROWS, VOTE_CELLS // classes))
    for a in range(0, len(x), step):
        here = x[a : a + step]
        votes = np.zeros(len(here) * classes, np.int64)
        for cls, tree, first, count, part in voters:
            many, entry = _entries(walked(tree, here), first, count)
            # a tree names a class of a row once
            votes[np.repeat(np.arange(len(here)) * classes, many) + cls[entry]] += part[entry]
        at = np.flatnonzero(votes)
        row = at // classes
        for b, of in _parts(block[a + row]):
            out.append((b, ids[a + row[of]].tobytes(), (at[of] - row[of] * classes).astype(np.uint16).tobytes(), votes[at[of]].tobytes()))
    cols = list(zip(*out))
    return pa.table({"block": pa.array(cols[0], pa.int64()), "rid": pa.array(cols[1], pa.binary()), "cls": pa.array(cols[2], pa.binary()), "vote": pa.array(cols[3], pa.binary())})


def _vote(key, grown_, asked, d):
    """The votes of a node's tree for the rows that reach it, as (row, class, parts of a vote)."""
    if not asked.num_rows or not grown_.num_rows:
        return pa.table({"block": pa.array([], pa.int64()), "rid": pa.array([], pa.binary()), "cls": pa.array([], pa.binary()), "vote": pa.array([], pa.binary())})
    feature, at, left, node, cls, n = (np.frombuffer(grown_.column(c)[0].as_py(), t)
                                       for c, t in zip(_TREE, (np.int16, np.uint8, np.int32, np.int32, np.uint16, np.int32)))
    tree, first, count, part = _voting(feature, at, left, node, n)
    out = []
    for block, rid, x in zip(asked.column("block").to_pylist(), asked.column("rid").to_pylist(), asked.column("x").to_pylist()):
        many, entry = _entries(walked(tree, np.frombuffer(x, np.uint8).reshape(-1, d)), first, count)
        out.append((block, np.repeat(np.frombuffer(rid, np.int64), many).tobytes(), cls[entry].tobytes(), part[entry].tobytes()))
    cols = list(zip(*out))
    return pa.table({"block": pa.array(cols[0], pa.int64()), "rid": pa.array(cols[1], pa.binary()), "cls": pa.array(cols[2], pa.binary()), "vote": pa.array(cols[3], pa.binary())})


def _count(key, table, classes):
    rid, place = np.unique(np.frombuffer(b"".join(table.column("rid").to_pylist()), np.int64), return_inverse=True)
    votes = np.zeros((len(rid), classes), np.int64)
    np.add.at(votes, (place, np.frombuffer(b"".join(table.column("cls").to_pylist()), np.uint16)),
              np.frombuffer(b"".join(table.column("vote").to_pylist()), np.int64))
    share = votes / votes.sum(axis=1, keepdims=True)
    return pa.table({"rid": pa.array(rid), "y_hat": pa.array(votes.argmax(axis=1).astype(np.int32)), "probability": pa.array(share.tolist(), pa.list_(pa.float64()))})


# --- the operator ------------------------------------------------------------------
class Forest(NamedTuple):
    """A fitted forest: a row per tree and node that one task grew, and what all tasks share."""

    trees: DataFrame
    tops: dict
    edges: list
    features: tuple
    classes: int
    num_trees: int
    importances: np.ndarray

    def predict(self, rows: DataFrame, keep) -> DataFrame:
        """(keep, y_hat, probability) of every row: the mean of the trees' class shares."""
        d = len(self.edges)
        src, x = _to_judge(rows, keep, self.features, self.edges)
        asked = x.mapInArrow(partial(_ask, tops=self.tops, trees=self.num_trees, d=d), "tree int, leaf int, block long, rid binary, x binary")
        tasks = _tasks(rows, self.num_trees)
        votes = (self.trees.repartition(tasks, "tree", "leaf").groupBy("tree", "leaf").cogroup(asked.repartition(tasks, "tree", "leaf").groupBy("tree", "leaf"))
                 .applyInArrow(lambda k, a, b: _vote(k, a, b, d), _VOTES))
        return _judged(src, votes, keep, self.classes)


def _to_judge(rows: DataFrame, keep, features, edges) -> tuple[DataFrame, DataFrame]:
    """The rows to be judged, numbered, and their bins by number."""
    src = cut_lineage(rows.select(*keep, *_numbers(features)).withColumn("_f_rid", F.monotonically_increasing_id()))
    return src, src.select(F.col("_f_rid").alias("rid"), F.lit(0).alias("y"), *[f"_f_{k}" for k in range(len(edges))]).mapInArrow(
        partial(_binned, edges=edges), "rid long, y int, x binary")


def _judged(src: DataFrame, votes: DataFrame, keep, classes: int) -> DataFrame:
    """(keep, y_hat, probability) by all votes of a row."""
    judged = votes.groupBy("block").applyInArrow(lambda k, t: _count(k, t, classes), "rid long, y_hat int, probability array<double>")
    return src.join(judged, F.col("_f_rid") == F.col("rid")).select(*keep, "y_hat", "probability")


def _numbers(features) -> list:
    """The features as numbers; one that is missing is an error."""
    cols = [F.col(c).cast("double") for c in features]
    return [guard(c.isNull() | F.isnan(c), f"no value of {name}", c).alias(f"_f_{k}") for k, (name, c) in enumerate(zip(features, cols))]


def _tasks(df: DataFrame, trees: int, most: int = TASKS) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, trees))


def edges_of(values: np.ndarray) -> np.ndarray:
    """Bounds between bins: midway between values, at most BINS - 1 of them by quantiles."""
    value = np.unique(values)
    between = (value[1:] + value[:-1]) / 2
    if len(between) < BINS:
        return between
    rank = np.sort(values)[np.arange(1, BINS) * len(values) // BINS]
    return np.unique(between[np.minimum(np.searchsorted(value, rank), len(between) - 1)])


def fit(train: DataFrame, label: str, features, num_trees: int, seed: int, max_depth: int, key=None) -> Forest:
    """A forest on the rows of ``train``; labels are 0, 1, 2 .. A row is known by ``key`` (or by its
    values): rows that share it are drawn together."""
    return _fitted(*_training(train, label, features, seed, key), tuple(features), num_trees, seed, max_depth)


def fit_and_predict(train: DataFrame, test: DataFrame, label: str, features, num_trees: int, seed: int, max_depth: int, keep, key=None) -> DataFrame:
    """What ``fit(train, ...).predict(test, keep)`` gives, for a forest that is not asked for itself. Where a task takes
    whole trees and the rows to be judged, it grows some trees and judges by them, and no tree leaves it."""
    features, d = tuple(features), len(features)
    rows, n, classes, edges = _training(train, label, features, seed, key)
    if n > LOCAL_ROWS or test.count() > LOCAL_ROWS:
        return _fitted(rows, n, classes, edges, features, num_trees, seed, max_depth).predict(test, keep)
    src, x = _to_judge(test, keep, features, edges)
    packs = min(TASKS, num_trees)
    tasks = _tasks(train, 4 * packs, 4 * TASKS)  # few packs share one
    every = F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("pack")
    dealt = rows.mapInArrow(_blocks, "rid binary, y binary, x binary").select(every, "rid", "y", "x")
    asked = x.mapInArrow(_ask_all, "block long, rid binary, x binary").select(every, "block", "rid", "x")
    votes = (dealt.repartition(tasks, "pack").groupBy("pack").cogroup(asked.repartition(tasks, "pack").groupBy("pack"))
             .applyInArrow(lambda k, a, b: _grow_and_vote(k, a, b, packs, num_trees, seed, d, classes, max_depth), _VOTES))
    return _judged(src, votes, keep, classes)


def _training(train: DataFrame, label: str, features, seed: int, key):
    """The binned rows of ``train``, their number, the number of classes, and the bounds of the bins."""
    by = [F.col(label)] + [F.col(c) for c in features] if key is None else [F.col(c) for c in ([key] if isinstance(key, str) else key)]
    y = F.col(label).cast("int")
    y = guard(y.isNull() | (y < 0) | (y != F.col(label)), "a label is not a class number", y)
    src = cut_lineage(train.select(F.xxhash64(F.lit(seed), *by).alias("rid"), y.alias("y"), *_numbers(features)))
    n, top_class = src.agg(F.count("*"), F.max("y")).first()
    if not n:
        raise ValueError("no rows to train on")
    classes = max(2, top_class + 1)
    cols = [f"_f_{k}" for k in range(len(features))]
    sample = src.orderBy(F.xxhash64("rid"), *cols).select(*cols).limit(SAMPLE_ROWS).toArrow()
    edges = [edges_of(sample.column(c).to_numpy()) for c in cols]
    return cut_lineage(src.mapInArrow(partial(_binned, edges=edges), "rid long, y int, x binary")), n, classes, edges


def _fitted(rows: DataFrame, n: int, classes: int, edges: list, features: tuple, num_trees: int, seed: int, max_depth: int) -> Forest:
    d = len(features)
    tops, gains = _large_nodes(rows, n, num_trees, seed, d, classes, max_depth)
    dealt = rows.mapInArrow(partial(_deal, tops=tops, trees=num_trees, seed=seed, d=d), "tree int, leaf int, x binary, y binary, w binary")
    trees = cut_lineage(dealt.repartition(_tasks(rows, num_trees), "tree", "leaf").groupBy("tree", "leaf")
                        .applyInArrow(lambda k, t: _grow(k, t, tops, seed, d, classes, max_depth), _TREE_SCHEMA))
    found = trees.groupBy("tree").agg(*[F.sum(F.col("gains")[f]).alias(f"g{f}") for f in range(d)]).toArrow()  # a row per tree
    by_tree = np.stack([found.column(f"g{f}").to_numpy() for f in range(d)], axis=1) + np.stack([gains.get(t, np.zeros(d)) for t in found.column("tree").to_pylist()])
    order = np.argsort(found.column("tree").to_numpy())
    whole = by_tree.sum(axis=1, keepdims=True)
    share = (by_tree / np.where(whole > 0, whole, 1))[order].sum(axis=0)
    return Forest(trees, tops, edges, features, classes, num_trees, share / share.sum() if share.sum() else share)


def _large_nodes(rows: DataFrame, n: int, trees: int, seed: int, d: int, classes: int, max_depth: int):
    """Splits of all nodes with more than LOCAL_ROWS rows, level by level, and their gains by tree."""
    if n <= LOCAL_ROWS:
        return {}, {}
    made = {t: [[-1], [0], [0], [tree_hash(seed, t)[0]], [0]] for t in range(trees)}
    gains = {t: np.zeros(d) for t in range(trees)}
    wanted = {t: {0} for t in range(trees)}
    while wanted:
        tops = _frozen(made)
        names = {(t, leaf): tops[t].name[leaf : leaf + 1] for t, some in wanted.items() for leaf in some}
        counts = rows.mapInArrow(partial(_histograms, tops=tops, trees=trees, seed=seed, d=d, classes=classes, wanted=wanted), "tree int, leaf int, counts binary")
        chosen = (counts.repartition(_tasks(rows, trees), "tree", "leaf").groupBy("tree", "leaf")
                  .applyInArrow(lambda k, t: _choose(k, t, names, d, classes), "tree int, leaf int, feature int, bin int, gain double, below long, rows long").collect())
        wanted = {}
        for r in sorted(chosen, key=lambda r: (r["tree"], r["leaf"])):
            feature, at, left, name, depth = made[r["tree"]]
            leaf = r["leaf"]
            if r["feature"] < 0 or r["rows"] <= LOCAL_ROWS or depth[leaf] >= max_depth:
                continue
            feature[leaf], at[leaf], left[leaf] = r["feature"], r["bin"], len(feature)
            gains[r["tree"]][r["feature"]] += r["gain"]
            for child, size, hashed in zip((0, 1), (r["below"], r["rows"] - r["below"]), children(np.array([name[leaf]], np.uint64))):
                if size > LOCAL_ROWS and depth[leaf] + 1 < max_depth:
                    wanted.setdefault(r["tree"], set()).add(left[leaf] + child)
                for column, value in zip((feature, at, left, name, depth), (-1, 0, 0, hashed, depth[leaf] + 1)):
                    column.append(value)
    return _frozen(made), gains


def _frozen(made: dict) -> dict:
    return {t: Top(np.array(f), np.array(b), np.array(c), np.array(h, np.uint64), np.array(e)) for t, (f, b, c, h, e) in made.items()}
