"""Nearest neighbours by query-aware collision counting.

Every vector is projected on ``PROJECTIONS`` random axes. A query opens a window
around its own projected value on every axis; a vector collides once for each
window that holds it, and one that reaches the collision threshold is verified on
the original vectors. Windows grow over the same sorted arrays (virtual rehashing)
up to the query's radius, an upper bound of its k-th distance. With a window of
the radius itself on either side, a vector at the radius lies in one with
probability 0.68, and in ``THRESHOLD`` of them or more with probability 0.95;
nearer vectors do so more often. Windows are wider by the rounding of projected
values, so that exact copies collide at any radius.

The index covers the whole table. Vectors lie in cells, by the nearest of a
bounded sample of pivots, and a cell keeps the range of its projected values on
every axis. A query whose windows meet the ranges of a cell on fewer axes than the
threshold skips it: no vector of the cell can reach the threshold. Cells near each
other share a block of bounded size with sorted projection arrays; a large cell has
several. The radius comes from the sample of pivots and from scouts, a quarter of
the block of the query's own cell.

A query skips cells where vectors form clusters. Where all distances are nearly
alike (random directions in many dimensions) no cell can be skipped, and each query
meets every block.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessera.session import cut_lineage

PROJECTIONS, THRESHOLD = 64, 38
#: Growth of the radius, and how many steps below the bound it starts.
GROWTH, STEPS = 1.5, 2
#: Rows of an index block and of a query batch; rows of a cell that a pivot stands for; scouts of a bin.
BLOCK_ROWS, QUERY_ROWS, CELL_ROWS, SCOUT_ROWS = 4096, 2048, 16, 1024
#: Rows of the sample that gives the pivots and the first bound of the radius.
SAMPLE_ROWS = 2048
#: Cell of the vectors whose dimension has no pivot.
NO_PIVOT = -1


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    return np.sqrt((d * d).sum(axis=1))


@lru_cache(maxsize=16)
def _axes(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes of the projections, and the bound of a projected value's rounding by the norm of its vector."""
    axes = np.random.default_rng(20240607).standard_normal((dim, PROJECTIONS))
    return axes, 2 * dim * np.finfo(np.float64).eps * np.sqrt((axes * axes).sum(axis=0))


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=-1))


class Block:
    """Sorted projection arrays of one block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.axes, self.rounding = _axes(x.shape[1])
        p = x @ self.axes
        self.order = np.argsort(p, axis=0, kind="stable").T.copy()
        self.value = np.take_along_axis(p, self.order.T, axis=0).T.copy()
        self.norm = float(_norm(x).max())
        #: vectors whose distance was computed, over all searches
        self.verified = 0

    def windows(self, q: np.ndarray, limits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(begin, end) by axis and query of the windows of every radius, the smallest first."""
        centre = (q @ self.axes).T
        slack = self.rounding[:, None] * (self.norm + _norm(q))
        out = []
        for step in range(STEPS, -1, -1):
            wide = limits / GROWTH**step + slack
            out.append((np.stack([np.searchsorted(v, c) for v, c in zip(self.value, centre - wide)]),
                        np.stack([np.searchsorted(v, c, side="right") for v, c in zip(self.value, centre + wide)])))
        return out

    def _verify(self, rows: np.ndarray, q: np.ndarray):
        self.verified += len(rows)
        return distances(self.x[rows], q)

    def search_all(self, qids: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int, whole: bool = False):
        """For each query, (distance, row) of the nearest found within its bound, ``k`` at most.

        A query without a finite bound is compared with the whole block; so is, where
        ``whole`` is set, one with fewer than ``k`` collisions at its full radius."""
        finite = np.isfinite(bounds)
        steps = self.windows(q, np.where(finite, bounds, 0.0))
        for t, (qid, vec, bound) in enumerate(zip(qids, q, bounds)):
            seen = self.ids == qid
            rows, d = np.zeros(0, np.int64), np.zeros(0)
            if finite[t]:
                count = np.zeros(len(self.ids), np.int64)
                lo, hi = steps[0][0][:, t], steps[0][0][:, t]
                for step, (begin, end) in enumerate(steps):
                    a, b = np.minimum(begin[:, t], lo), np.maximum(end[:, t], hi)
                    hit = [o[s:e] for o, s, e in zip(self.order, a, lo)] + [o[s:e] for o, s, e in zip(self.order, hi, b)]
                    count += np.bincount(np.concatenate(hit), minlength=len(count))
                    lo, hi = a, b
                    new = np.flatnonzero((count >= THRESHOLD) & ~seen)
                    seen[new] = True
                    rows, d = np.r_[rows, new], np.r_[d, self._verify(new, vec)]
                    if (d <= bound / GROWTH ** (STEPS - step)).sum() >= k:
                        break
            if not finite[t] or (whole and len(rows) < k):
                new = np.flatnonzero(~seen)
                rows, d = np.r_[rows, new], np.r_[d, self._verify(new, vec)]
            if not whole:
                near = d <= bound
                rows, d = rows[near], d[near]
            top = np.lexsort((self.ids[rows], d))[:k]
            yield d[top], rows[top]

    def search(self, qid: int, q: np.ndarray, bound: float, k: int):
        """(distance, id) of the ``k`` nearest found of one query; ``k`` where the block has them."""
        d, rows = next(self.search_all(np.array([qid]), q[None], np.array([bound]), k, whole=True))
        return d, self.ids[rows]


FOUND = "query_id long, vec_id long, h long, copies long, score double"
_ROUTED = "query_id long, q array<double>, bound double, bin int"


class Pivots:
    """The sample, by dimension: pivots of the cells, and the bound of a query's radius."""

    def __init__(self, ids, h, copies, x, cells: int):
        self.of = {}
        first = 0
        for dim in sorted({len(v) for v in x}):
            at = [i for i, v in enumerate(x) if len(v) == dim]
            made = max(1, cells * len(at) // len(x))
            self.of[dim] = (np.stack([x[i] for i in at]), ids[at], h[at], copies[at], first, made)
            first += made

    def order(self) -> list[int]:
        """All cells, those of near pivots together."""
        out = []
        for pivots, _, _, _, first, made in self.of.values():
            pivots = pivots[:made]
            heads = pivots[: max(1, int(made**0.5))]
            far = (heads * heads).sum(axis=1)[None] - 2 * (pivots @ heads.T)
            out += (first + np.argsort(far.argmin(axis=1), kind="stable")).tolist()
        return out

    def cell(self, x: np.ndarray) -> np.ndarray:
        """Cell of every row: its nearest pivot."""
        if x.shape[1] not in self.of:
            return np.full(len(x), NO_PIVOT, np.int32)
        pivots, _, _, _, first, made = self.of[x.shape[1]]
        pivots = pivots[:made]
        size = (pivots * pivots).sum(axis=1)[None]
        near = [(size - 2 * (x[s : s + 1024] @ pivots.T)).argmin(axis=1) for s in range(0, len(x), 1024)]
        return (first + np.concatenate(near)).astype(np.int32)


def by_dim(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each dimension."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    return [(at, _matrix(column.take(pa.array(at)))) for at in (np.flatnonzero(size == dim) for dim in np.unique(size))]


def _assign(batches, pivots: Pivots):
    """Vectors with their cells."""
    for batch in batches:
        if batch.num_rows:
            cell = np.empty(batch.num_rows, np.int32)
            for at, x in by_dim(batch.column("x")):
                cell[at] = pivots.cell(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])


def _ranges(batches):
    """Per batch and cell: rows, largest norm, and the range of the projected values on every axis."""
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        out = []
        for at, x in by_dim(batch.column("x")) if batch.num_rows else []:
            order = np.argsort(cells[at], kind="stable")
            mine, x = cells[at][order], x[order]
            p, norm = x @ _axes(x.shape[1])[0], _norm(x)
            start = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            lo, hi, top = np.minimum.reduceat(p, start), np.maximum.reduceat(p, start), np.maximum.reduceat(norm, start)
            out += [(int(mine[s]), int(n), float(t), a.tolist(), b.tolist())
                    for s, n, t, a, b in zip(start, np.diff(np.r_[start, len(mine)]), top, lo, hi)]
        cols = list(zip(*out)) if out else [[]] * 5
        types = [pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["cell", "n", "norm", "lo", "hi"])


def _bins(order: list[int], rows: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """(bin, rows of the bin, blocks of the bin) of every cell: cells in the given order share
    a bin of one block; a cell of more rows than a block holds has a bin of several."""
    bins, size, at = {}, [], None
    for cell in order:
        n = rows.get(cell, 0)
        if n > BLOCK_ROWS:
            size.append(n)
            bins[cell] = len(size) - 1
        elif n:
            if at is None or size[at] + n > BLOCK_ROWS:
                size.append(0)
                at = len(size) - 1
            size[at] += n
            bins[cell] = at
    return {cell: (b, size[b], -(-size[b] // BLOCK_ROWS)) for cell, b in bins.items()}


def _first_bounds(batches, pivots: Pivots, bins: dict, k: int):
    """Queries with the k-th distance in the sample (or infinity), the bin of their own cell, and the sample's nearest."""
    for batch in batches:
        if not batch.num_rows:
            continue
        qids = batch.column("query_id").to_numpy()
        n = len(qids)
        bound, cell, near = np.full(n, np.inf), np.zeros(n, np.int32), [[] for _ in range(n)]
        for at, q in by_dim(batch.column("q")):
            cell[at] = [bins[c][0] for c in pivots.cell(q).tolist()]
            if q.shape[1] not in pivots.of:
                continue
            x, ids, h, copies, _, _ = pivots.of[q.shape[1]]
            for t, vec in zip(at, q):
                d = distances(x, vec)
                top = [i for i in np.lexsort((ids, d))[: k + (ids == qids[t]).sum()] if ids[i] != qids[t]][:k]
                near[t] = [{"vec_id": int(ids[i]), "h": int(h[i]), "copies": int(copies[i]), "score": float(d[i])} for i in top]
                bound[t] = d[top[-1]] if len(top) == k else np.inf
        hits = pa.list_(pa.struct([("vec_id", pa.int64()), ("h", pa.int64()), ("copies", pa.int64()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_arrays([*batch.select(["query_id", "q"]).columns, pa.array(bound), pa.array(cell), pa.array(near, hits)],
                                         names=["query_id", "q", "bound", "bin", "near"])


def _route(batches, zones: dict, rest: int):
    """A query once for every bin with a cell that may hold a vector with enough collisions."""
    for batch in batches:
        for at, q in by_dim(batch.column("q")) if batch.num_rows else []:
            bounds = batch.column("bound").to_numpy()[at]
            if q.shape[1] in zones:
                bins, lo, hi, norm = zones[q.shape[1]]
                axes, rounding = _axes(q.shape[1])
                p, size = q @ axes, _norm(q)
                rows, hit = [], []
                for t in range(len(q)):
                    wide = bounds[t] + rounding[None] * (norm[:, None] + size[t])
                    meets = ((lo <= p[t] + wide) & (hi >= p[t] - wide)).sum(axis=1) >= THRESHOLD
                    hit.append(np.unique(bins[meets]))
                    rows.append(np.full(len(hit[-1]), at[t], np.int64))
                rows, hit = np.concatenate(rows), np.concatenate(hit)
            else:
                rows, hit = at, np.full(len(at), rest, np.int32)
            for s in range(0, len(rows), QUERY_ROWS):
                part = batch.select(["query_id", "q", "bound"]).take(pa.array(rows[s : s + QUERY_ROWS]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hit[s : s + QUERY_ROWS], pa.int32())],
                                                 names=["query_id", "q", "bound", "bin"])


def _search(key, vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    out = []
    if vectors.num_rows and queries.num_rows:
        ids, h, copies = (vectors.column(c).to_numpy() for c in ("vec_id", "h", "copies"))
        qids, bounds = queries.column("query_id").to_numpy(), queries.column("bound").to_numpy()
        asked = {q.shape[1]: (at, q) for at, q in by_dim(queries.column("q"))}
        for at, x in by_dim(vectors.column("x")):
            if x.shape[1] not in asked:
                continue
            block, (rows, q) = Block(ids[at], x), asked[x.shape[1]]
            for t, (d, i) in zip(rows, block.search_all(qids[rows], q, bounds[rows], k)):
                out.append((np.full(len(i), qids[t], np.int64), ids[at][i], h[at][i], copies[at][i], d))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0)]
    return pa.table(dict(zip(("query_id", "vec_id", "h", "copies", "score"), cols)))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x) of the rows with an id and a finite, non-zero vector without nulls; single precision stays as it is."""
    kind = df.schema[vec_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    x = F.col(f"`{vec_col}`").cast("array<float>" if single else "array<double>")
    ok = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & ok)


def _meet(vectors: DataFrame, routes: DataFrame, bins: DataFrame, k: int) -> DataFrame:
    """Nearest of the routed queries in the blocks of their bins. ``bins`` has the blocks of
    a bin, one row a cell; a block's vectors are copied once for each batch of its queries."""
    spark = vectors.sparkSession
    visits = routes.groupBy("bin").agg((F.floor((F.count("*") - 1) / QUERY_ROWS) + 1).cast("int").alias("batches"))
    # one row a cell: SAMPLE_ROWS + 1 at most
    table = spark.createDataFrame(bins.join(visits, "bin").select("cell", "bin", "blocks", "batches").toArrow(), "cell int, bin int, blocks int, batches int")
    left = (vectors.join(F.broadcast(table), "cell").withColumn("b", F.pmod("h", "blocks").cast("int"))
            .withColumn("qb", F.explode(F.expr("sequence(0, batches - 1)"))).select("vec_id", "h", "copies", "x", "bin", "b", "qb"))
    right = (routes.join(F.broadcast(table.select("bin", "blocks", "batches").distinct()), "bin").withColumn("b", F.explode(F.expr("sequence(0, blocks - 1)")))
             .withColumn("qb", F.pmod(F.xxhash64("query_id", "q"), "batches").cast("int")).select("query_id", "q", "bound", "bin", "b", "qb"))
    return left.groupBy("bin", "b", "qb").cogroup(right.groupBy("bin", "b", "qb")).applyInArrow(partial(_search, k=k), FOUND)


def candidates(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found neighbours, routed queries, bins of the cells) of the search; ``nearest`` ranks the first."""
    spark, raw = df.sparkSession, usable(df, id_col, vec_col)
    # repeated rows are one vector with a number of copies: a hot row stays one row
    vectors = cut_lineage(raw.groupBy("vec_id", "x").agg(F.count("*").alias("copies")).withColumn("h", F.xxhash64("vec_id", "x")))
    sample = vectors.orderBy("h", "vec_id").limit(SAMPLE_ROWS).toArrow()
    ids, h, copies = (sample.column(c).to_numpy() for c in ("vec_id", "h", "copies"))
    n = vectors.count()
    pivots = Pivots(ids, h, copies, [np.array(v, np.float64) for v in sample.column("x").to_pylist()], min(SAMPLE_ROWS, -(-n // CELL_ROWS)))
    kind = vectors.schema["x"].dataType.simpleString()
    vectors = cut_lineage(vectors.mapInArrow(partial(_assign, pivots=pivots), f"vec_id long, x {kind}, copies long, h long, cell int"))
    # ranges of the cells: one row a cell, SAMPLE_ROWS + 1 at most
    parts = vectors.mapInArrow(_ranges, "cell int, n long, norm double, lo array<double>, hi array<double>")
    lows, highs = ([f(F.col(c)[j]) for j in range(PROJECTIONS)] for c, f in (("lo", F.min), ("hi", F.max)))
    cells = cut_lineage(parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("norm").alias("norm"), F.array(*lows).alias("lo"), F.array(*highs).alias("hi")))
    known = {r["cell"]: r for r in cells.collect()}
    placed = _bins([*pivots.order(), NO_PIVOT], {c: r["n"] for c, r in known.items()})
    bins = spark.createDataFrame([(c, *b) for c, b in placed.items()], "cell int, bin int, n long, blocks int")
    rest = placed.get(NO_PIVOT, (NO_PIVOT,))[0]
    zones = {}
    for dim, (_, _, _, _, first, made) in pivots.of.items():
        mine = [known[c] for c in range(first, first + made) if c in known]
        zones[dim] = (np.array([placed[r["cell"]][0] for r in mine], np.int32), np.array([r["lo"] for r in mine]), np.array([r["hi"] for r in mine]),
                      np.array([r["norm"] for r in mine]))
    queries = raw.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("x").cast("array<double>").alias("q")).distinct()
    hits = "near array<struct<vec_id long, h long, copies long, score double>>"
    queries = cut_lineage(queries.mapInArrow(partial(_first_bounds, pivots=pivots, bins=placed, k=k), f"{_ROUTED}, {hits}"))
    sampled = queries.select("query_id", F.inline("near")).select("query_id", "vec_id", "h", "copies", "score")
    # scouts: a bounded part of every bin tightens the bounds of the queries in it
    part = F.floor((F.col("n") - 1) / SCOUT_ROWS) + 1
    scouts = vectors.join(F.broadcast(bins.select("cell", part.alias("part"))), "cell").where(F.pmod(F.xxhash64("h"), "part") == 0).drop("part")
    scouted = cut_lineage(_meet(scouts, queries.drop("near"), bins.withColumn("blocks", F.lit(1)), k))
    near = scouted.unionAll(sampled).distinct()
    w = Window.partitionBy("query_id").orderBy("score")
    kth = near.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select("query_id", F.col("score").alias("kth"))
    # an id of several vectors keeps the sample's bound of each
    single = queries.groupBy("query_id").agg(F.count("*").alias("forms"))
    tight = (queries.drop("near").join(single, "query_id").join(kth, "query_id", "left")
             .withColumn("bound", F.when(F.col("forms") == 1, F.least("bound", F.coalesce("kth", "bound"))).otherwise(F.col("bound"))))
    routes = cut_lineage(tight.select("query_id", "q", "bound").mapInArrow(partial(_route, zones=zones, rest=rest), _ROUTED))
    found = _meet(vectors, routes, bins, k).unionAll(near).distinct()
    return found, routes, bins


def nearest(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query, the rows
    whose id is divisible by ``every``, by Euclidean distance in double precision.

    Rows that share the query's id are never its neighbours; other repeated rows
    each count. Vectors that are null, zero, of another dimension, or hold null or
    non-finite components take no part. An empty table gives an empty result."""
    found, _, _ = candidates(df, k, every, id_col, vec_col)
    copies = F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int")))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.select("query_id", "vec_id", "score", copies.alias("copy")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
