"""N-gram Jaccard self-join: word shingle sets, universe partitions, exact links.

Two sets link when ``intersection / union >= 0.8``, which is the same as
``|x - y| + |y - x| <= (|x| + |y|) / 9``. Sizes fall into bands. For a pair
whose larger set lies in band k, the universe of shingle hashes is split into
``m`` segments, one more than the largest difference such a pair may have, so
that at least one segment agrees (pigeonhole). Every set indexes each of its
segment subsets, and, in a few reserve segments, each subset with one token
deleted. A set probes only with an allocation of segments: with value 1 the
subsets must agree, with value 2 one token may differ; the values add up to
the set's own bound plus one. Cheap segments are taken first (costs: how often
the rarest token was met in a bounded sample, then the size of the subset).
What shares a probed entry is a candidate and is verified on the whole sets.

Equal sets are united before the join, and groups that share an entry are
verified against a few hubs at a time: members that are already in one
component are never compared again, so a group of n near copies costs about n
comparisons and no link between different components is missed.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Words, blob, chunks, components, mix, shuffle_partitions, unblob
from tessera.operators.small import join_small
from tessera.session import cut_lineage

#: Links need ``LINK_NUM / LINK_DEN`` = 0.8 or more of the union in common.
LINK_NUM, LINK_DEN = 80, 100
#: Documents whose shingles give the costs of the allocation (never the links).
COST_SAMPLE = 4096
#: Shingles met in so many documents of the sample are frequent.
FREQUENT = 12
#: One segment more for every so many that a band needs: room to leave costly ones out.
SLACK = 10
#: One in so many segments is a reserve, indexed with one-deletion neighbours.
RESERVE = 16
#: Words of 64 cells in a set's parity sketch.
PARITY = 8
PARITY_NAMES = [f"p{k}" for k in range(PARITY)]
SET_SCHEMA = "doc long, n long, " + ", ".join(f"{p} long" for p in PARITY_NAMES) + ", tokens binary"
#: Entries gathered before they are packed, and entries wanted in a partition.
FLUSH, PER_PARTITION = 1_000_000, 2_000_000


def bands(limit: int) -> np.ndarray:
    """Lower bounds of the size bands, each about 25/16 of the one before."""
    low = [1]
    while low[-1] <= limit:
        low.append(low[-1] * 25 // 16 + 1)
    return np.array(low, np.int64)


def shingle_sets(text: pa.Array, n: int):
    """Per row the sorted distinct hashes of its ``n``-word shingles (lower case);
    a text of fewer words is one shingle, one without words has none."""
    for _, _, data, offsets in chunks(text):
        w = Words(data, offsets, lower=True)
        chain = w.chains(n)
        for a, b in zip(w.first_word[:-1].tolist(), w.first_word[1:].tolist()):
            if b - a >= n:
                yield np.unique(chain[a : b - n + 1])
            elif b > a:
                h = np.zeros(1, np.uint64)
                for k in range(a, b):
                    h = h * np.uint64(0xD1342543DE82EF95) + w.hash[k]
                yield mix(h + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def set_name(s: np.ndarray) -> int:
    """A 64-bit name of the set, as a signed number."""
    return int(mix(s).sum(dtype=np.uint64).view(np.int64))


def _fingerprints(batches, n):
    for batch in batches:
        size, f1, f2 = [], [], []
        for s in shingle_sets(batch.column(1), n):
            size.append(len(s))
            f1.append(set_name(s))
            f2.append(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(f1, pa.int64()),
             pa.array(np.array(f2, np.uint64).view(np.int64))], names=["doc_id", "n_shingles", "f1", "f2"])


def _text_names(batches, n):
    for batch in batches:
        text = batch.column(0)
        named = [pa.Table.from_batches(_fingerprints([pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), text], names=["doc_id", "text"])], n))]
        table = pa.concat_tables(named)
        yield pa.RecordBatch.from_arrays([text, *[table.column(c).combine_chunks() for c in ("n_shingles", "f1", "f2")]], names=["text", "n_shingles", "f1", "f2"])


def survivors(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``docs`` without the ids of ``gone`` and with one row for each id and shingle set: the one
    with the smallest text, and of equal texts the smallest in its other columns. Rows
    without an id or without words stay.

    Ids that occur once, nearly all, are only taken out; rows of the others are told apart."""
    columns = docs.columns
    gone = gone.select(F.col(id_col).alias("_j_gone"))
    kept = F.col(f"`{id_col}`") == F.col("_j_gone")
    repeated = (docs.select(F.col(f"`{id_col}`").alias("_j_id")).where("_j_id is not null").groupBy("_j_id").agg(F.count("*").alias("_j_n"))
                .where("_j_n > 1").select("_j_id"))
    # few ids repeat, as a rule: a table of checked size
    marked = join_small(docs, repeated, F.col(f"`{id_col}`") == F.col("_j_id"), "left")
    single = marked.where("_j_id is null").select(*columns).join(gone, kept, "left_anti")
    rows = cut_lineage(marked.where("_j_id is not null").select(*columns).join(gone, kept, "left_anti"))
    if rows.isEmpty():
        return single
    texts = rows.where(f"`{text_col}` is not null").select(F.col(f"`{text_col}`").alias("text")).distinct()
    texts = texts.mapInArrow(partial(_text_names, n=shingle), "text string, n_shingles long, f1 long, f2 long")
    with_set = rows.join(texts.withColumnRenamed("text", "_j_text"), F.col(f"`{text_col}`") == F.col("_j_text"), "left").drop("_j_text")
    worded = F.coalesce(F.col("n_shingles"), F.lit(0)) > 0
    row = F.struct(F.col(f"`{text_col}`").alias("t"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)]).alias("r"))
    first = with_set.where(worded).groupBy(id_col, "n_shingles", "f1", "f2").agg(F.min(row).alias("_j_first"))
    first = first.select(*[F.col(f"_j_first.r.c{k}").alias(c) for k, c in enumerate(columns)])
    return single.unionByName(with_set.where(~worded).select(*columns)).unionByName(first)


def _tokens(batches, n):
    for batch in batches:
        sets = list(shingle_sets(batch.column(1), n))
        h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


def _sets(batches, n):
    """Sets by name; a text that is not the named one (of an id with several texts) is left out."""
    for batch in batches:
        rows = [(k, s) for k, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n)) if set_name(s) == k]
        parity = np.stack([parity_bits(s) for _, s in rows]) if rows else np.zeros((0, PARITY), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], pa.int64()), pa.array([len(s) for _, s in rows], pa.int64()),
             *[pa.array(parity[:, k]) for k in range(PARITY)], pa.array([s.tobytes() for _, s in rows], pa.binary())],
            names=["doc", "n", *PARITY_NAMES, "tokens"])


def parity_bits(s: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY cells, whether an odd number of tokens falls into it: two
    sets differ in at least as many tokens as cells."""
    odd = np.bincount((mix(s ^ np.uint64(0x5555)) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def allocation(rare: np.ndarray, cost: np.ndarray, spare: np.ndarray, need: int) -> np.ndarray:
    """Values 0, 1 or 2 per segment that add up to ``need`` or more. ``rare`` counts
    the tokens of a segment that are not frequent, ``cost`` is how often the rarest
    token of the others was met. Segments with rare tokens come first, the fullest
    ahead; then deletions in ``spare`` segments, which keep a rare token whichever
    token is deleted; then whatever is left, the cheapest first."""
    value = np.zeros(len(rare), np.int8)
    order = np.lexsort((cost, -rare))
    cheap = order[rare[order] > 0][:need]
    value[cheap] = 1
    missing = need - len(cheap)
    if missing > 0:
        up = cheap[spare[cheap]][:missing]
        value[up] = 2
        missing -= len(up)
    if missing > 0:
        value[order[value[order] == 0][:missing]] = 1
    return value


def entries(s: np.ndarray, low: np.ndarray, frequent: np.ndarray, weight: np.ndarray):
    """(entries of the set, whether the set probes with them) over its schemes."""
    n = len(s)
    partner = n * LINK_DEN // LINK_NUM
    token = mix(s)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(token, out=total[1:])
    met = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        met = np.where(frequent[at] == s, weight[at], 0)
    uncommon = np.zeros(n + 1, np.int64)
    np.cumsum(met == 0, out=uncommon[1:])
    first, last = np.searchsorted(low, n, side="right") - 1, np.searchsorted(low, partner, side="right") - 1
    out, probes = [], []
    for k in range(first, last + 1):
        top = int(low[k + 1]) - 1
        m = 2 * top // 9 + 1
        m += m // SLACK
        need = (n + min(top, partner)) // 9 + 1
        seg = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        edge = np.searchsorted(seg, np.arange(m + 1, dtype=np.uint64))
        sums = total[edge[1:]] - total[edge[:-1]]
        rare = np.diff(uncommon[edge])
        full = np.diff(edge) > 0
        cost = np.full(m, 1 << 40)
        cost[full] = np.minimum.reduceat(met, edge[:-1][full])
        spare = rare >= 2
        spare[-(-m // RESERVE):] = False
        value = allocation(rare, cost, spare, need)
        salt = np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k << 40)
        out.append(mix(sums + salt))
        probes.append(value > 0)
        stop = int(edge[-(-m // RESERVE)])
        if stop:
            own = seg[:stop].astype(np.int64)
            out.append(mix(sums[own] - token[:stop] + salt[own]))
            probes.append(value[own] > 1)
    return np.concatenate(out), np.concatenate(probes)


def _pack(sig, doc, parts):
    """Rows (part, entries, doc ids) of the gathered entries."""
    part = (sig >> np.uint64(1)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    part, sig, doc = part[order], sig[order], doc[order]
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    rows = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[edge[:-1]].astype(np.int32)), pa.array([sig[a:b].tobytes() for a, b in rows], pa.binary()),
         pa.array([blob(doc[a:b]) for a, b in rows], pa.binary())], names=["part", "sig", "doc"])


def _index(batches, n, parts, limit, frequent, weight):
    """Packed entries of every set, once per task for equal sets."""
    low = bands(limit * 2 + 2)
    sigs, docs, held, seen = [], [], 0, set()
    for batch in batches:
        for s in shingle_sets(batch.column(0), n):
            name = set_name(s)
            if not len(s) or name in seen:
                continue
            seen.add(name)
            sig, probe = entries(s, low, frequent, weight)
            sigs.append((sig | np.uint64(1)) ^ np.where(probe, np.uint64(0), np.uint64(1)))
            docs.append(np.full(len(sig), name, np.int64))
            held += len(sig)
            if held >= FLUSH:
                yield _pack(np.concatenate(sigs), np.concatenate(docs), parts)
                sigs, docs, held = [], [], 0
    if held:
        yield _pack(np.concatenate(sigs), np.concatenate(docs), parts)


def groups(sig: np.ndarray, doc: np.ndarray):
    """(group, doc, probes) of entries shared by two documents or more, one of which
    probes; groups of the same members are given once."""
    key = sig >> np.uint64(1)
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    keep = np.zeros(len(key), bool)
    keep[1:] |= same
    keep[:-1] |= same
    key, order = key[keep], order[keep]
    doc, probe = doc[order], (sig[order] & np.uint64(1)).astype(np.int64)
    run = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1 if len(key) else np.zeros(0, np.int64)
    order = np.lexsort((1 - probe, doc, run))
    run, doc, probe = run[order], doc[order], probe[order]
    once = np.r_[True, (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])] if len(run) else np.zeros(0, bool)
    run, doc, probe = run[once], doc[once], probe[once]
    if not len(run):
        return run, doc, probe
    size, probing = np.bincount(run), np.bincount(run, weights=probe)
    good = ((size > 1) & (probing > 0))[run]
    run, doc, probe = run[good], doc[good], probe[good]
    if not len(run):
        return run, doc, probe
    edge = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    member = mix(doc.view(np.uint64) * np.uint64(2) + probe.astype(np.uint64))
    name = mix(np.add.reduceat(member, edge))
    _, pick = np.unique(name, return_index=True)
    chosen = np.zeros(len(edge), bool)
    chosen[pick] = True
    own = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, len(run)]))
    keep = chosen[own]
    return name[own][keep].view(np.int64), doc[keep], probe[keep]


def _collide(batches):
    sigs, docs = [], []
    for batch in batches:
        sigs += [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
        docs += [unblob(x, np.int64) for x in batch.column(2).to_pylist()]
    if sigs:
        sig, doc = np.concatenate(sigs), np.concatenate(docs)
        del sigs, docs
        g, d, p = groups(sig, doc)
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(d), pa.array(p == 1)], names=["grp", "doc", "probe"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    if LINK_DEN * min(len(x), len(y)) < LINK_NUM * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return LINK_DEN * common >= LINK_NUM * (len(x) + len(y) - common)


def _verify(batches):
    for batch in batches:
        a, b, ta, tb = (batch.column(k) for k in range(4))
        ok = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(ta, tb)]
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], names=["a", "b"])


def _near(hubs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of a hub and a member of its group in another component that sizes
    and parity sketches do not rule out; the condition is part of the join, so that
    no other pair leaves it. The few that do are packed: a skewed join is read in many
    pieces, which need no shuffle files of their own."""
    tasks = shuffle_partitions(members.sparkSession, 0, 1)
    left = hubs.select(F.col("grp").alias("hg"), F.col("doc").alias("h"), F.col("comp").alias("hc"), F.col("n").alias("hn"),
                       *[F.col(p).alias(f"h{p}") for p in PARITY_NAMES])
    differ = sum((F.bit_count(F.col(f"h{p}").bitwiseXOR(F.col(p))) for p in PARITY_NAMES), F.lit(0))
    near = ((F.col("hg") == F.col("grp")) & (F.col("hc") != F.col("comp"))
            & (LINK_DEN * F.least("hn", "n") >= LINK_NUM * F.greatest("hn", "n")) & (9 * differ <= F.col("hn") + F.col("n")))
    found = left.join(members, near).select(F.least("h", "doc").alias("a"), F.greatest("h", "doc").alias("b"))
    return found.coalesce(tasks).distinct()


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link, by their whole sets."""
    both = (pairs.join(sets.select(F.col("doc").alias("a"), F.col("tokens").alias("ta")), "a")
            .join(sets.select(F.col("doc").alias("b"), F.col("tokens").alias("tb")), "b").select("a", "b", "ta", "tb"))
    return both.mapInArrow(_verify, "a long, b long")


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, class_id, component_id.

    ``class_id`` is the smallest id with the same shingle set, ``component_id`` the
    smallest id reachable by links. Null or empty texts have no shingles and stand
    alone. Rows that share an id are one document: the links of all its texts
    unite. A row without an id takes no part: its class and component are null.
    An empty table gives an empty result; other columns are not read."""
    spark: SparkSession = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    feats = cut_lineage(src.mapInArrow(partial(_fingerprints, n=shingle), "doc_id long, n_shingles long, f1 long, f2 long"))
    classes = (feats.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "f1", "f2")
               .agg(F.min("doc_id").alias("class_id")))
    classes = cut_lineage(classes)
    n_reps, tokens, limit = classes.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0)),
                                        F.coalesce(F.max("n_shingles"), F.lit(1))).first()
    frequent, weight = _frequent(src, shingle, n_reps)
    parts = shuffle_partitions(spark, tokens * 3 // 5, PER_PARTITION)
    index = partial(_index, n=shingle, parts=parts, limit=int(limit), frequent=frequent, weight=weight)
    packed = (src.where("doc_id is not null").select("text").mapInArrow(index, "part int, sig binary, doc binary")
              .repartitionById(parts, "part"))
    members = cut_lineage(packed.mapInArrow(_collide, "grp long, doc long, probe boolean").dropDuplicates(["grp", "doc"]))
    # only sets with a candidate are read again, each from one of its documents
    wanted = (members.select(F.col("doc").alias("f1")).distinct().join(classes, "f1")
              .groupBy("f1").agg(F.min("class_id").alias("doc_id")))
    sets = cut_lineage(src.join(wanted, "doc_id").select("f1", "text")
                       .mapInArrow(partial(_sets, n=shingle), SET_SCHEMA))
    found = _connect(members, sets)
    result = (feats.join(classes, ["n_shingles", "f1", "f2"], "left")
              .select("doc_id", "n_shingles", "f1", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")))
    # component: the smallest id among the classes of a component of sets
    root = F.coalesce("component", "f1")
    named = classes.join(found.withColumnRenamed("node", "f1"), "f1", "left").select("class_id", root.alias("root"))
    twice = result.groupBy("doc_id").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo <> hi")
    smallest = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = named.join(smallest, "root").select("class_id", "component_id")
    if not twice.isEmpty():
        # an id with several texts unites their components
        same = (result.where("class_id is not null").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
                .unionAll(named.select(F.col("class_id").alias("a"), F.col("component_id").alias("b"))))
        named = components(same, cut_lineage).select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
    return (result.join(named, "class_id", "left")
            .select("doc_id", "n_shingles", "class_id", F.coalesce("component_id", "class_id").alias("component_id")))


def _frequent(src: DataFrame, shingle: int, n: int):
    """Shingles met often among about COST_SAMPLE texts (by id hash), sorted, with how
    often. At most the sample's shingles / FREQUENT values come to the driver."""
    place = F.pmod(F.xxhash64("doc_id", F.lit("cost")), F.lit(1 << 30)) / F.lit(1 << 30)
    tokens = src.where(place * n < COST_SAMPLE).select("doc_id", "text").mapInArrow(partial(_tokens, n=shingle), "h long")
    rows = tokens.groupBy("h").count().where(F.col("count") >= FREQUENT).toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], rows.column("count").to_numpy()[order]


def _connect(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) over the verified links. A round lets every open group compare
    its next probing members (the hubs: 1, 64, 4096, ...) with its members of other
    components; groups that lie in one component, or have no hub left, are closed."""
    from pyspark.sql import Window

    order = Window.partitionBy("grp", "probe").orderBy("doc")
    members = cut_lineage(members.withColumn("k", F.when(F.col("probe"), F.row_number().over(order))).select("grp", "doc", "k")
                          .withColumn("comp", F.col("doc")))
    found = members.sparkSession.createDataFrame([], "node long, component long")
    small = sets.drop("tokens")
    done, step = 0, 1
    while True:
        sketched = members.join(small, "doc")
        pairs = _near(sketched.where((F.col("k") > done) & (F.col("k") <= done + step)), sketched)
        edges = cut_lineage(_links(pairs, sets))
        old = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = components(old.unionAll(edges), cut_lineage)
        done, step = done + step, step * 64
        labelled = (members.select("grp", "doc", "k").join(found.withColumnRenamed("node", "doc"), "doc", "left")
                    .select("grp", "doc", "k", F.coalesce("component", "doc").alias("comp")))
        is_open = (labelled.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("k").alias("last"))
                   .where((F.col("lo") != F.col("hi")) & (F.col("last") > done)).select("grp"))
        members = cut_lineage(labelled.join(is_open, "grp", "left_semi"))
        if members.isEmpty():
            return found
