"""Mixing sources to target weights by proportionate-fair scheduling.

Rows of a source are put in the order of their id's MD5 and cut into blocks. With ``a`` of
every ``D`` slots due to a source, its block j (from 0) is released at slot
``floor(j * D / a)`` and due before slot ``ceil((j + 1) * D / a)``. In each
slot the released block with the earliest deadline goes next, so that every
block lies in its window and no source is a whole block ahead of or behind
its weight while all sources have rows left.

The schedule is cut into segments of time. A segment's slots follow from the blocks released
in it and from those that it takes over: of every source at most one block is released but
not due at any time, and as many of these as arithmetic says are placed before, which gives a
first guess of the blocks taken over. Segments are scheduled side by side, each by a fold over its
release times; what one hands on then replaces the guess of the next, and the segments
whose guess was wrong are scheduled again until none is. The result is the one earliest-deadline-first
schedule, whatever the length of a segment and however good the guesses were.

All rows are placed exactly once: the blocks of a source that ends early are
not replaced, others keep their windows.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.small import join_small
from tessera.session import cut_lineage

#: Without weights a source weighs the square root of its rows, in whole numbers of this part.
ROOT_UNIT = 1_000_000
#: Rows of a block, and rows wanted in a ranking bucket.
BLOCK_ROWS, BUCKET_ROWS = 16, 2048
#: Columns of the result.
PLACED = ("_m_block", "_m_release", "_m_deadline", "_m_slot", "_m_position")
#: Slots of a segment at least (and two for each source), blocks of a partition that lists or schedules them.
SEGMENT, LISTED = 1024, 1 << 16
#: Rows of the largest ranking bucket up to which its blocks' places fit into one value.
PACKED_ROWS = 1 << 20


def shares(counts: DataFrame, weights: dict | None, slots: int) -> DataFrame:
    """(src, a): slots of a period due to each source. ``weights`` gives target
    weights by source name (None for the null source); a source without one gets
    one slot. Without ``weights`` a source weighs the square root of its rows."""
    if weights is None:
        w = counts.select("src", F.sqrt("n").alias("w"))
    else:
        given = [(_key(k), float(v)) for k, v in weights.items()]
        table = counts.sparkSession.createDataFrame(given, "src string, w double")
        w = counts.select("src").join(F.broadcast(table), "src", "left").select("src", F.coalesce("w", F.lit(0.0)).alias("w"))
    total = w.agg(F.sum("w")).first()[0] or 1.0
    return w.select("src", F.greatest(F.lit(1), F.round(F.col("w") * slots / F.lit(total))).cast("long").alias("a"))


def _key(name) -> str:
    return "-" if name is None else f"s{name}"


def _number(a_max: int, d: int, blocks: int, horizon: int) -> str:
    """The SQL type in which the products of the schedule are exact."""
    largest = max(a_max * horizon, d * (blocks + 1)) + a_max
    if largest < 1 << 62:
        return "bigint"
    if largest < 10**37 and horizon < 1 << 62:
        return "decimal(38,0)"
    raise ValueError("weights are too far apart: slots would pass 2**62")


_BLOCK = "struct<due: bigint, src: string, j: bigint, release: bigint>"
_FOLD = f"""
    aggregate(
      transform(concat(array(named_struct('slot', seg * {{length}}, 'news', cast(array() as array<{_BLOCK}>))), released),
                (e, i) -> named_struct('slot', e.slot, 'news', e.news)),
      named_struct('at', 0, 'ready', carry, 'picks', cast(array() as array<struct<src: string, j: bigint, release: bigint, due: bigint, slot: bigint>>)),
      (st, e) -> element_at(transform(
        array(named_struct('q', sort_array(concat(st.ready, e.news)),
                           'gap', cast(coalesce(get(released, st.at).slot, (seg + 1) * {{length}}) - e.slot as int))),
        s -> named_struct('at', st.at + 1, 'ready', slice(s.q, s.gap + 1, greatest(size(s.q), 1)),
          'picks', concat(st.picks, transform(slice(s.q, 1, s.gap), (x, i) -> named_struct(
            'src', x.src, 'j', x.j, 'release', x.release, 'due', x.due, 'slot', e.slot + i))))), 1))"""
_GUESS = f"""
    element_at(transform(
      array(filter(transform(ws, x -> named_struct('x', x, 'past', x.a * (seg * {{length}}))),
                   y -> y.past % d > 0 and y.past div d < y.x.blocks)),
      open -> slice(sort_array(transform(open, y -> cast(named_struct(
                  'due', ((y.past div d + 1) * d + y.x.a - 1) div y.x.a, 'src', y.x.src, 'j', y.past div d,
                  'release', ((y.past div d) * d) div y.x.a) as {_BLOCK}))),
                1 + cast(floor(1e-9D + aggregate(open, 0D, (n, y) -> n + cast(y.past % d as double) / cast(d as double))) as int),
                greatest(size(open), 1))), 1)"""


def schedule(share: DataFrame) -> DataFrame:
    """(phase, src, a, d, j, release, due, slot): earliest deadline first over released blocks.

    ``share`` gives for every source ``src`` its whole weight ``a``, its number of ``blocks`` (if missing:
    one period, ``a``) and its ``phase`` (if missing: 0). Each phase is a schedule of its own, from slot 0 on.
    The pending blocks, one of a source at most, must fit in a task."""
    for name, default in (("blocks", F.col("a").cast("long")), ("phase", F.lit(0))):
        share = share if name in share.columns else share.withColumn(name, default)
    share = cut_lineage(share.select("phase", "src", F.col("a").cast("decimal(38,0)").alias("a"), F.col("blocks").cast("long").alias("blocks")).where("blocks > 0"))
    whole = share.groupBy("phase").agg(F.sum("a").alias("d"), F.max("a").alias("most"), F.max("blocks").alias("long"), F.count("*").alias("n"),
                                       F.sum("blocks").alias("all"), F.max(F.expr("blocks / cast(a as double)")).alias("far")).collect()
    sources = max((r["n"] for r in whole), default=0)
    length = max(SEGMENT, 2 * sources)
    ends = [int(float(r["d"]) * r["far"] * (1 + 1e-9)) + 2 * length for r in whole]
    kinds = {_number(int(r["most"]), int(r["d"]), r["long"], end) for r, end in zip(whole, ends)}
    kind = "bigint" if kinds <= {"bigint"} else "decimal(38,0)"
    share = share.withColumn("a", F.col("a").cast(kind))
    table = share.groupBy("phase").agg(F.array_sort(F.collect_list(F.struct("src", "a", "blocks"))).alias("ws"), F.sum("a").cast(kind).alias("d"))
    parts = int(sum(r["all"] for r in whole)) // LISTED + 1
    listed = (join_small(share, table.select("phase", "d"), "phase", "inner")
              .withColumn("first", F.explode(F.expr(f"sequence(0L, blocks - 1, {LISTED}L)"))).repartition(parts, "phase", "src", "first")
              .withColumn("j", F.explode(F.expr(f"sequence(first, least(blocks, first + {LISTED}) - 1)")))
              .withColumn("release", F.expr("(j * d) div a")).withColumn("due", F.expr("((j + 1) * d + a - 1) div a")))
    released = (listed.groupBy("phase", "release").agg(F.collect_list(F.expr(f"cast(named_struct('due', due, 'src', src, 'j', j, 'release', release) as {_BLOCK})")).alias("news"))
                .withColumn("seg", F.expr(f"release div {length}")).repartition(parts, "phase", "seg").groupBy("phase", "seg")
                .agg(F.sort_array(F.collect_list(F.struct(F.col("release").alias("slot"), "news"))).alias("released")))
    fold = F.expr(_FOLD.format(length=f"{length}L"))
    state = join_small(released, table, "phase", "inner").withColumn("carry", F.expr(_GUESS.format(length=f"{length}L")))
    state = cut_lineage(state.select("phase", "seg", "released", "carry").withColumn("out", fold))
    none = F.expr(f"cast(array() as array<{_BLOCK}>)")
    while True:
        handed = state.where(F.size("out.ready") > 0).select("phase", (F.col("seg") + 1).alias("seg"), F.col("out.ready").alias("taken"))
        chained = (state.join(handed, ["phase", "seg"], "full").withColumn("taken", F.coalesce("taken", none))
                   .withColumn("wrong", ~F.col("carry").eqNullSafe(F.col("taken"))))
        if chained.where("wrong").isEmpty():
            break
        state = cut_lineage(chained.select("phase", "seg", F.expr("coalesce(released, cast(array() as array<struct<slot: bigint, news: array<" + _BLOCK + ">>>))").alias("released"),
                                           F.col("taken").alias("carry"), "wrong", F.col("out").alias("before"))
                            .withColumn("out", F.when(F.col("wrong"), fold).otherwise(F.col("before"))).drop("wrong", "before"))
    picks = state.select("phase", F.explode("out.picks").alias("p")).select("phase", "p.*")
    weights = join_small(share.select("phase", "src", "a"), table.select("phase", "d"), "phase", "inner")
    return join_small(picks, weights, ["phase", "src"], "inner").select("phase", "src", "a", "d", "j", "release", "due", "slot")


def _rational(weight) -> Fraction:
    """A weight as its shortest decimal says, or as given if it is exact; none below 0."""
    return max(Fraction(0), Fraction(str(float(weight))) if isinstance(weight, float) else Fraction(weight))


def targets(counts: DataFrame, weights: dict | None) -> DataFrame:
    """(src, n, phase, a) of the sources: whole weights; those without one follow in phase 1, in equal shares."""
    if weights is None:
        return counts.select("src", "n", F.lit(0).alias("phase"), F.round(F.sqrt("n") * ROOT_UNIT).cast("decimal(38,0)").alias("a"))
    given = {k: w for k, w in ((_key(k), _rational(v)) for k, v in weights.items()) if w > 0}
    scale = math.lcm(*(w.denominator for w in given.values()))
    table = counts.sparkSession.createDataFrame([(k, str(int(w * scale))) for k, w in given.items()], "src string, a string")
    return (counts.join(table, "src", "left")
            .select("src", "n", F.when(F.col("a").isNull(), 1).otherwise(0).alias("phase"), F.coalesce(F.col("a").cast("decimal(38,0)"), F.lit(1)).alias("a")))


def _places(counts: DataFrame, weights: dict | None, slots: int | None, block_rows: int) -> DataFrame:
    """(_m_src, _m_block, _m_release, _m_deadline, _m_slot) of every block."""
    if slots is None:
        share = targets(counts, weights)
    else:
        share = counts.join(shares(counts, weights, slots), "src").withColumn("phase", F.lit(0))
    made = schedule(share.withColumn("blocks", F.ceil(F.col("n") / block_rows)))
    start = F.lit(0)
    if weights is not None:
        last = made.where("phase = 0").agg(F.max("slot")).first()[0]
        start = F.when(F.col("phase") == 1, F.lit(-1 if last is None else last) + 1).otherwise(0)
    return made.select(F.col("src").alias("_m_src"), F.col("j").alias("_m_block"),
                       *[(F.col(c) + start).cast("long").alias(n) for c, n in (("release", "_m_release"), ("due", "_m_deadline"), ("slot", "_m_slot"))])


def mix_sources(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source",
                slots: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with columns ``_m_block`` (number in its source), ``_m_release``,
    ``_m_deadline``, ``_m_slot`` and ``_m_position``; sorting by position gives the mix.

    ``weights`` gives target weights by source name (None for the null source), which
    are met exactly; a source without one, or of weight 0, comes after all others.
    Without ``weights`` a source weighs the square root of its rows, to a millionth. ``slots`` asks
    for weights rounded to so many slots of a period; more sources than these raise an error, as
    do weights so far apart that slots pass 2**62.

    A null source is a source of its own; rows with a null or repeated id are
    placed like any other (among rows of the same id the order is open); an empty
    table stays empty. Columns of ``docs`` that are named like those of the result
    give way to them; any other name is kept, whatever it is."""
    kept = [c for c in docs.columns if c not in PLACED]
    names = [f"c{k}" for k in range(len(kept))]
    docs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)])
    id_col, source_col = (names[kept.index(c)] for c in (id_col, source_col))
    key = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("-"))
    order = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    buckets = max(1, -(-docs.count() // BUCKET_ROWS))

    def bucket(h: Column) -> Column:
        # ranges of hash values: the order does not depend on their number
        return F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("double") * buckets / float(1 << 32)).cast("long")

    before = Window.partitionBy("_m_src").orderBy("_m_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(docs.select(key.alias("_m_src"), bucket(order).alias("_m_bucket")).groupBy("_m_src", "_m_bucket").agg(F.count("*").alias("_m_n"))
                          .withColumn("_m_offset", F.coalesce(F.sum("_m_n").over(before), F.lit(0))))
    counts = offsets.groupBy(F.col("_m_src").alias("src")).agg(F.sum("_m_n").alias("n"))
    sources, largest = offsets.agg(F.countDistinct("_m_src"), F.coalesce(F.max("_m_n"), F.lit(0))).first()
    if slots is not None and sources > slots:
        raise ValueError(f"{sources} sources need more than {slots} slots a period")
    places = _places(counts, weights, slots, block_rows)
    inside = Window.partitionBy("_m_src", "_m_bucket").orderBy("_m_hash", F.col(f"`{id_col}`"))
    rows = (docs.withColumn("_m_src", key).withColumn("_m_hash", order).withColumn("_m_bucket", bucket(F.col("_m_hash")))
            .withColumn("_m_rank", F.row_number().over(inside) - 1))
    rank = F.col("_m_rank") + F.col("_m_offset")
    block = F.floor(rank / block_rows).cast("long")
    if largest <= PACKED_ROWS:
        # the places of a bucket's blocks come with its offset, so that rows are not shuffled for them
        held = (offsets.withColumn("_m_block", F.explode(F.expr(f"sequence(_m_offset div {block_rows}, (_m_offset + _m_n - 1) div {block_rows})")))
                .join(places, ["_m_src", "_m_block"]).groupBy("_m_src", "_m_bucket", "_m_offset")
                .agg(F.sort_array(F.collect_list(F.struct("_m_block", "_m_release", "_m_deadline", "_m_slot"))).alias("_m_held")))
        at = F.get("_m_held", (block - F.floor(F.col("_m_offset") / block_rows)).cast("int"))
        out = rows.join(held, ["_m_src", "_m_bucket"]).withColumn("_m_place", at).withColumn("_m_rank", rank)
        out = out.select(*names, "_m_rank", "_m_place.*")
    else:
        out = (rows.join(offsets, ["_m_src", "_m_bucket"]).withColumn("_m_block", block).withColumn("_m_rank", rank)
               .join(places, ["_m_src", "_m_block"]))
    out = out.withColumn("_m_position", F.col("_m_slot") * block_rows + F.col("_m_rank") % block_rows)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names)], *PLACED)


def interleaved(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` in the order of the mix, with its own columns, whatever their names. Null ids and
    sources, repeated rows and an empty table as in ``mix_sources``."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    mixed = mix_sources(plain, weights, *(names[docs.columns.index(c)] for c in (id_col, source_col)))
    return mixed.orderBy("_m_position").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
