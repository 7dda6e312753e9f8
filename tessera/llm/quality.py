"""Host-level quality rules.

Every document is counted once (words, symbols, repeated lines and repeated
five-word windows). Rule failures are then added up per host (the ``source``
column), each host's failure rate is shrunk towards the corpus with a beta
prior whose mean and strength come from the hosts themselves (method of
moments), and hosts whose shrunk rate lies above a threshold are rejected as
a whole. The host verdict is joined back to the documents.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import IS_SPACE, Words, chunks, count_between, mix
from tessera.session import cut_lineage

#: Base rules: fewer words fail; so does a larger share (in percent) of repeated words.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Words of a window that counts as repeated.
WINDOW = 5
#: A host whose shrunk failure rate is above this is rejected.
HOST_LIMIT = 0.5
#: Bounds of the prior's strength (documents), for hosts that hardly differ or differ wildly.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_chunk(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each document of a chunk."""
    w = Words(data, offsets)
    docs = len(offsets) - 1
    n_words = np.diff(w.first_word)
    symbols = count_between(_SYMBOL[data], offsets)
    chars = count_between(~w.space & ((data & 0xC0) != 0x80), offsets)
    # lines: cut at \n and at document ends; only lines with a word count
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    start, end = cuts[:-1], cuts[1:]
    end = end - ((end > start) & (data[np.maximum(end, 1) - 1] == 10)) if len(data) else end
    full = count_between(~w.space, np.r_[start, len(data)]) > 0 if len(start) else np.zeros(0, bool)
    start, end = start[full], end[full]
    doc = np.searchsorted(offsets, start, side="right") - 1
    dup_lines = _repeats(w.prefix.spans(start, end), doc, docs)
    # five-word windows that stay in one document
    chain = w.chains(WINDOW)
    at = np.flatnonzero(w.doc[: len(chain)] == w.doc[WINDOW - 1 :][: len(chain)])
    key = mix(chain[at] + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    hit = at[np.isin(key, twice)] if len(twice) else at[:0]
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    covered = np.cumsum(cover)[:-1] > 0
    repeat_words = count_between(covered, w.first_word)
    return [n_words, chars, symbols, dup_lines, repeat_words]


def _repeats(key: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Per document: how many keys equal an earlier one."""
    key = mix(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    key = key[order]
    again = order[1:][key[1:] == key[:-1]]
    return np.bincount(doc[again], minlength=docs)


def _count(batches, text_at: int):
    for batch in batches:
        parts = [count_chunk(d, o) for _, _, d, o in chunks(batch.column(text_at))]
        rows = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(COUNTS))]
        words, repeats = rows[0], rows[4]
        failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
        keep = [batch.column(k) for k in range(batch.num_columns)]
        names = list(batch.schema.names)
        yield pa.RecordBatch.from_arrays(
            keep + [pa.array(r.astype(np.int64)) for r in rows] + [pa.array(failed)],
            names=names + [f"_q_{c}" for c in COUNTS] + ["_q_failed"])


def counted(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default) and the counts as ``_q_*`` columns."""
    carry = list(docs.columns) if carry is None else carry
    names = [f"c{k}" for k in range(len(carry))]
    src = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)], F.col(f"`{text_col}`").alias("_q_text"))
    fields = [T.StructField(n, docs.schema[c].dataType) for c, n in zip(carry, names)]
    fields += [T.StructField("_q_text", T.StringType())]
    fields += [T.StructField(f"_q_{c}", T.LongType()) for c in COUNTS] + [T.StructField("_q_failed", T.BooleanType())]
    made = src.mapInArrow(partial(_count, text_at=len(carry)), T.StructType(fields))
    return made.select(*[F.col(n).alias(c) for c, n in zip(carry, names)],
                       *[f"_q_{c}" for c in COUNTS], "_q_failed")


def host_verdicts(failures: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n_docs, n_failed, rate, rejected) from rows (host, failed). A null host
    is a host of its own. The prior is one row; a single host is its own prior."""
    hosts = cut_lineage(failures.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")))
    share = F.col("n_failed") / F.col("n_docs")
    n, total, failed, mean, var, sampling = hosts.agg(
        F.count("*"), F.sum("n_docs"), F.sum("n_failed"), F.avg(share), F.var_samp(share),
        F.avg(1 / F.col("n_docs"))).first()
    if not n:
        return hosts.select("host", "n_docs", "n_failed", F.lit(0.0).alias("rate"), F.lit(False).alias("rejected"))
    spread = mean * (1 - mean)
    # variance between hosts beyond what sampling alone gives
    between = max(0.0, (var or 0.0) - spread * sampling)
    strength = MAX_STRENGTH if between <= 0 else min(MAX_STRENGTH, max(MIN_STRENGTH, spread / between - 1))
    prior = failed / total
    rate = (F.col("n_failed") + F.lit(prior * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate > F.lit(limit)).alias("rejected"))


def judge(rows: DataFrame, host: str, failed: str, limit: float = HOST_LIMIT, seen: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``_q_kept``; host verdicts are learned from ``seen`` (host, failed), or from ``rows``."""
    seen = rows.select(F.col(f"`{host}`").alias("host"), F.col(failed).alias("failed")) if seen is None else seen
    verdict = host_verdicts(seen, limit).select(F.coalesce(F.concat(F.lit("h"), F.col("host").cast("string")), F.lit("-")).alias("_q_host"),
                                                "rate", F.col("rejected").alias("_q_rejected"))
    key = F.coalesce(F.concat(F.lit("h"), F.col(f"`{host}`").cast("string")), F.lit("-"))
    return (rows.withColumn("_q_host", key).join(verdict.withColumnRenamed("rate", "_q_rate"), "_q_host", "left")
            .withColumn("_q_kept", ~F.col(failed) & ~F.coalesce("_q_rejected", F.lit(False))))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: the id, its counts, ``base_failed``, the host's
    ``host_rate`` and ``kept``. A null text counts as empty (and fails, having no
    words); repeated rows and ids are judged row by row; an empty table gives none."""
    rows = cut_lineage(counted(docs, text_col, [id_col, host_col]))
    out = judge(rows, host_col, "_q_failed")
    return out.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"_q_{c}").alias(c) for c in COUNTS],
                      F.col("_q_failed").alias("base_failed"), F.col("_q_rate").alias("host_rate"), F.col("_q_kept").alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``. The counts are
    taken twice (hosts first, then rows), so that no text is shuffled."""
    seen = counted(docs, text_col, [host_col]).select(F.col(f"`{host_col}`").alias("host"), F.col("_q_failed").alias("failed"))
    rows = counted(docs, text_col)
    return judge(rows, host_col, "_q_failed", seen=seen).where("_q_kept").select(*[f"`{c}`" for c in docs.columns])
