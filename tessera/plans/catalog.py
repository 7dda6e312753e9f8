"""Registered queries over the driver's tables and their SQL oracles.

Each query binds operators to whole tables (SURVEY 5.3); each oracle is the
same computation written in DuckDB SQL, so the two engines can be compared
row by row at any scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.keys import with_id
from tessera.operators import filters as FL
from tessera.operators.filters import require
from tessera.operators import joins as J
from tessera.operators import sets as U
from tessera.plans import sql_text as S
from tessera.plans.corpus import SEED, corpus, corpus_with_key_parts, fold_label_profile
from tessera.session import cut_lineage
from tessera.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None, rounded=()):
    """Register a query; ``rounded`` double columns are rounded to 6 places on both
    engines (sums in another order differ in the last bits)."""
    def deco(fn):
        run = fn
        if rounded:
            def run(spark, sf, _fn=fn):
                df = _fn(spark, sf)
                return df.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in df.columns])
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql if not rounded else \
                f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in rounded)}) FROM ({sql}) _t"
        return fn
    return deco


# --- shared SQL fragments ---------------------------------------------------
CORPUS_SQL = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _extended_text(spark, sf):
    """documents text with its page url and a timestamp mark appended, so links and marks occur."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    p = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return d.join(p, "doc_id", "left").select(
        "doc_id", F.concat_ws(" ", "text", F.coalesce("url", F.lit("")), F.lit("[12:34] end")).alias("text"))


EXT_SQL = ("(SELECT d.doc_id, concat_ws(' ', d.text, coalesce(p.url, ''), '[12:34] end') AS text "
           "FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id)")


# --- flagship ----------------------------------------------------------------
def _fold_sql(src: str, key: str, label: str, k: int = 5, val: float = 0.25) -> str:
    """K3 in SQL: (key, label, fold, part) from a relation with key and label."""
    return f"""
  r AS (SELECT {key}, {label}, row_number() OVER (PARTITION BY {label} ORDER BY {S.md5_key(SEED, key)}, {key}) AS rk
        FROM {src}),
  cls AS (SELECT {label}, coalesce(sum(count(*)) OVER (ORDER BY {label} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
          FROM {src} GROUP BY {label}),
  tf AS (SELECT r.{key}, r.{label}, CAST((r.rk - 1 + cls.st) % {k} AS INTEGER) AS test_fold
         FROM r JOIN cls ON r.{label} IS NOT DISTINCT FROM cls.{label}),
  e AS (SELECT tf.*, CAST(f.fold AS INTEGER) AS fold, tf.test_fold = f.fold AS is_test
        FROM tf, range({k}) f(fold)),
  r2 AS (SELECT e.*, row_number() OVER (PARTITION BY fold, is_test ORDER BY {S.md5_key(SEED, key, "'val'", "CAST(fold AS VARCHAR)")}, {key}) AS rk2,
                count(*) OVER (PARTITION BY fold, is_test) AS m FROM e),
  folds AS (SELECT {key}, {label}, fold,
                   CASE WHEN is_test THEN 'test' WHEN rk2 <= ceil(CAST({val} AS DOUBLE) * m) THEN 'val' ELSE 'train' END AS part
            FROM r2)"""


CLEAN_DEDUP_SQL = f"""
  c AS (SELECT doc_id, quality, {S.clean_text('text')} AS cleaned_comment FROM {CORPUS_SQL} x
        WHERE text IS NOT NULL AND quality IS NOT NULL),
  u AS (SELECT * FROM c WHERE doc_id IN (SELECT min(doc_id) FROM c GROUP BY cleaned_comment))"""


@register("fold_label_profile", f"""
WITH {CLEAN_DEDUP_SQL},
{_fold_sql('u', 'doc_id', 'quality')}
SELECT fold, part, quality, count(*) AS n,
       sum(count(*)) OVER (PARTITION BY fold, part) / (count(*) OVER (PARTITION BY fold, part) * count(*)) AS weight
FROM folds GROUP BY fold, part, quality""")
def q_fold_label_profile(spark, sf):
    return fold_label_profile(spark, sf)


# --- T1-T7 -----------------------------------------------------------------
@register("clean_text", f"SELECT doc_id, {S.clean_text('text')} AS cleaned_comment FROM {EXT_SQL} x")
def q_clean_text(spark, sf):
    return _extended_text(spark, sf).select("doc_id", T.clean_text("text").alias("cleaned_comment"))


@register("text_steps", f"""
SELECT doc_id,
  {S.fix_encoding('text')} AS fixed,
  {S.remove_links('text')} AS no_links,
  {S.remove_empty_lines('text')} AS no_empty_lines,
  {S.collapse_ws('text')} AS collapsed,
  {S.strip_timestamp('text')} AS no_timestamps,
  CAST(length(text) - length(replace(text, ' ', '')) + 1 AS INTEGER) AS n_words
FROM {EXT_SQL} x""")
def q_text_steps(spark, sf):
    x = _extended_text(spark, sf)
    return x.select("doc_id",
                    T.fix_encoding("text").alias("fixed"),
                    T.remove_links("text").alias("no_links"),
                    T.remove_empty_lines("text").alias("no_empty_lines"),
                    T.collapse_ws("text").alias("collapsed"),
                    T.strip_timestamp("text").alias("no_timestamps"),
                    T.word_count("text").alias("n_words"))


# --- X1, F1-F6 ---------------------------------------------------------------
@register("with_id", f"""
SELECT doc_id, concat_ws('#', CAST(doc_id AS VARCHAR), CAST(doc_id % 5 AS VARCHAR), CAST(doc_id % 7 AS VARCHAR),
                         CAST(doc_id % 3 AS VARCHAR), coalesce(source, 'nan')) AS "ID"
FROM documents""")
def q_with_id(spark, sf):
    c = corpus_with_key_parts(spark, sf)
    return with_id(c, ["UniqueID", "small_gr", "nr", "sequence", "name"]).select("doc_id", "ID")


@register("require_text_label", f"SELECT doc_id, quality FROM {CORPUS_SQL} x WHERE text IS NOT NULL AND quality IS NOT NULL")
def q_require(spark, sf):
    return FL.require(corpus(spark, sf), "text", "quality").select("doc_id", "quality")


@register("require_all", f"""SELECT doc_id FROM {CORPUS_SQL} x WHERE doc_id IS NOT NULL AND text IS NOT NULL
  AND lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL""")
def q_require_all(spark, sf):
    return FL.require_all(corpus(spark, sf)).select("doc_id")


@register("drop_sentinels", f"SELECT doc_id, quality FROM {CORPUS_SQL} x WHERE quality IS DISTINCT FROM 0")
def q_drop_sentinels(spark, sf):
    return FL.drop_sentinels(corpus(spark, sf), "quality", 0).select("doc_id", "quality")


@register("exclude_flagged", "SELECT conv_id, turn, role FROM conversations WHERE NOT coalesce(role = 'system', false)")
def q_exclude_flagged(spark, sf):
    c = table(spark, sf, "conversations")
    return FL.exclude_flagged(c, F.col("role") == "system").select("conv_id", "turn", "role")


CORPUS_TASKS = {"quality": ("quality", None), "toxicity": ("toxic", "quality = 1")}


@register("select_task", f"SELECT doc_id, toxic AS label FROM {CORPUS_SQL} x WHERE quality = 1")
def q_select_task(spark, sf):
    return FL.select_task(corpus(spark, sf), "toxicity", CORPUS_TASKS).select("doc_id", "label")


@register("model_view", f"SELECT text, quality AS label FROM {CORPUS_SQL} x")
def q_model_view(spark, sf):
    return FL.model_view(corpus(spark, sf), "text", "quality")


# --- U1-U3 -------------------------------------------------------------------
@register("union_tagged", """
SELECT id, text, lang, turn, tag FROM (
  SELECT doc_id AS id, text, lang, CAST(NULL AS BIGINT) AS turn, 'documents' AS tag FROM documents
  UNION ALL SELECT item_id, text, NULL, NULL, 'benchmark' FROM benchmark
  UNION ALL SELECT conv_id, text, NULL, turn, 'conversations' FROM conversations)""")
def q_union_tagged(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "turn", "text")
    return U.union_tagged({"documents": d, "benchmark": b, "conversations": c}, tag_col="tag") \
        .select("id", "text", "lang", "turn", "tag")


@register("union_parts", """
SELECT id, text FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark)""")
def q_union_parts(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return U.union_parts(d, b)


@register("dedupe_first", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)")
def q_dedupe_first(spark, sf):
    return U.dedupe_first(table(spark, sf, "documents"), "text", "doc_id").select("doc_id", "lang")


# --- J1-J7 -------------------------------------------------------------------
@register("attach_scores", """
SELECT o.o_orderkey, o.o_custkey, f.l_quantity, f.l_extendedprice, f.l_discount, f.l_tax
FROM orders o LEFT JOIN (
  SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                                 l_extendedprice, l_discount, l_tax) AS rn FROM lineitem) WHERE rn = 1) f
ON o.o_orderkey = f.l_orderkey""")
def q_attach_scores(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return J.attach_scores(o, li, key="o_orderkey", right_key="l_orderkey", order=order,
                           cols=["l_quantity", "l_extendedprice", "l_discount", "l_tax"], on_missing="null")


SCORED_DOCS_SQL = """(SELECT d.doc_id, d.text, CAST(e.embedding[1] AS DOUBLE) AS cogency,
   CAST(e.embedding[2] AS DOUBLE) AS effectiveness, CAST(e.embedding[3] AS DOUBLE) AS reasonableness,
   CAST(e.embedding[4] AS DOUBLE) AS overall
 FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"""


def scored_docs(spark, sf) -> DataFrame:
    """Four scores per document: the first four embedding entries of the same id."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    e = table(spark, sf, "embeddings")
    e = e.select(F.col("vec_id").alias("doc_id"),
                 *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(J.SCORE_COLS)])
    return d.join(e, "doc_id", "inner")


@register("attach_scores_by_text", f"""
SELECT d.doc_id, s.cogency, s.effectiveness, s.reasonableness, s.overall
FROM documents d LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM {SCORED_DOCS_SQL} x) WHERE rn = 1) s
ON d.text = s.text""")
def q_attach_scores_by_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return J.attach_scores_by_text(d, scored_docs(spark, sf), "text", "doc_id", on_missing="null") \
        .select("doc_id", *J.SCORE_COLS)


PRED_FILES_SQL = """(SELECT conv_id, role AS file, turn AS pos,
   [CAST(turn AS DOUBLE), CAST(length(text) AS DOUBLE)] AS predictions FROM conversations)"""


@register("attach_predictions", f"""
SELECT k.conv_id, p.predictions FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN (SELECT conv_id, arg_max(predictions, (file, pos)) AS predictions FROM {PRED_FILES_SQL} x GROUP BY conv_id) p
ON k.conv_id = p.conv_id""")
def q_attach_predictions(spark, sf):
    c = table(spark, sf, "conversations")
    preds = c.select("conv_id", F.col("role").alias("file"), F.col("turn").alias("pos"),
                     F.array(F.col("turn").cast("double"), F.length("text").cast("double")).alias("predictions"))
    keys = c.select("conv_id").distinct()
    return J.attach_predictions(keys, preds, "conv_id")


@register("match_augmented", """
SELECT d.doc_id, c.text AS sent FROM documents d JOIN conversations c ON CAST(d.doc_id AS VARCHAR) = CAST(c.conv_id AS VARCHAR)""")
def q_match_augmented(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("ID"))
    c = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("ID"), F.col("text").alias("sent"))
    return J.match_augmented(d, c).select("doc_id", "sent")


@register("pair_by_rank", f"""
WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY {S.md5_key(SEED, 'doc_id', "'left'")}, doc_id) AS pair_rank
           FROM {CORPUS_SQL} x WHERE toxic = 1),
     r AS (SELECT item_id, row_number() OVER (ORDER BY {S.md5_key(SEED, 'item_id', "'right'")}, item_id) AS pair_rank FROM benchmark)
SELECT l.doc_id, r.item_id, l.pair_rank FROM l JOIN r ON l.pair_rank = r.pair_rank""")
def q_pair_by_rank(spark, sf):
    left = corpus(spark, sf).where(F.col("toxic") == 1).select("doc_id")
    right = table(spark, sf, "benchmark").select("item_id")
    return J.pair_by_rank(left, right, "doc_id", "item_id", SEED).select("doc_id", "item_id", "pair_rank")


@register("exclude_keys", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def q_exclude_keys(spark, sf):
    return J.exclude_keys(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@register("overlap_count", "SELECT count(DISTINCT doc_id) AS n_overlap FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q_overlap_count(spark, sf):
    return J.overlap_count(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


# --- A1-A8 -------------------------------------------------------------------
from tessera.operators import profile as A  # noqa: E402
from tessera.operators import splits as K  # noqa: E402
from tessera.operators import select as O  # noqa: E402
from tessera.operators import bins as Q  # noqa: E402
from tessera.operators.rank import sequential_rank  # noqa: E402


def _vc_sql(src: str, cols, by=()) -> str:
    b = "".join(f"{c}, " for c in by)
    parts = [f"SELECT {b}'{c}' AS field, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {src} x GROUP BY {b}{c}"
             for c in cols]
    return " UNION ALL ".join(parts)


@register("value_counts", _vc_sql(CORPUS_SQL, ["lang", "source", "quality", "toxic"]))
def q_value_counts(spark, sf):
    return A.value_counts(corpus(spark, sf), "lang", "source", "quality", "toxic")


@register("cross_counts", f"""SELECT quality, toxic, count(*) AS n FROM {CORPUS_SQL} x
WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY quality, toxic""")
def q_cross_counts(spark, sf):
    return A.cross_counts(corpus(spark, sf), "quality", "toxic")


LABELLED_SQL = f"(SELECT * FROM {CORPUS_SQL} y WHERE quality IS NOT NULL)"


def labelled(spark, sf):
    return corpus(spark, sf).where(F.col("quality").isNotNull())


def labelled_folds(spark, sf):
    """K3 fold table of the labelled corpus joined back to its rows. The narrow
    assignment table is written once (lineage cut on shared storage) and every
    later branch reads it, as a pipeline reads its written split table."""
    lab = labelled(spark, sf)
    folds = cut_lineage(K.stratified_fold_table(lab, "doc_id", "quality", k=5, seed=SEED).drop("quality"))
    return lab.join(folds, "doc_id", "inner")


LABELLED_FOLDS_SQL = f"""WITH {_fold_sql(LABELLED_SQL, 'doc_id', 'quality')},
  lf AS (SELECT f.fold, f.part, c.* FROM folds f JOIN {LABELLED_SQL} c ON f.doc_id = c.doc_id)"""


@register("split_distribution", LABELLED_FOLDS_SQL + "\n" + _vc_sql("lf", ["quality", "toxic", "lang"], by=["fold", "part"]))
def q_split_distribution(spark, sf):
    return A.split_distribution(labelled_folds(spark, sf), ["quality", "toxic", "lang"])


@register("split_sizes", LABELLED_FOLDS_SQL + """
SELECT fold, part, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY fold) AS share FROM lf GROUP BY fold, part""")
def q_split_sizes(spark, sf):
    return A.split_sizes(labelled_folds(spark, sf))


@register("class_weights", """SELECT label, count(*) AS freq,
  sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM embeddings WHERE label IS NOT NULL GROUP BY label""")
def q_class_weights(spark, sf):
    return A.class_weights(table(spark, sf, "embeddings"), "label")


@register("class_weight_vector", """SELECT list(weight ORDER BY label) AS class_weights FROM (
  SELECT label, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM embeddings WHERE label IS NOT NULL GROUP BY label)""")
def q_class_weight_vector(spark, sf):
    return A.class_weight_vector(table(spark, sf, "embeddings"), "label", 10)


@register("what_if_distribution", f"""SELECT lang, quality, count(*) AS freq,
  count(*) * (CASE WHEN quality = 0 THEN 2.0 ELSE 1.0 END)::DOUBLE AS scaled,
  count(*) * (CASE WHEN quality = 0 THEN 2.0 ELSE 1.0 END)::DOUBLE
    / sum(count(*) * (CASE WHEN quality = 0 THEN 2.0 ELSE 1.0 END)::DOUBLE) OVER (PARTITION BY lang) * 100.0 AS percent
FROM {LABELLED_SQL} x GROUP BY lang, quality""")
def q_what_if(spark, sf):
    return A.what_if_distribution(labelled(spark, sf), "quality", {0: 2.0}, by=["lang"])


# --- K1-K8 -------------------------------------------------------------------
def _rk(key, *salt, by=""):
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY {S.md5_key(SEED, key, *salt)}, {key})"


@register("holdout", f"""SELECT doc_id, CASE WHEN rk <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS part
FROM (SELECT doc_id, {_rk('doc_id')} AS rk, count(*) OVER () AS n FROM documents)""")
def q_holdout(spark, sf):
    return K.holdout(table(spark, sf, "documents").select("doc_id"), "doc_id", SEED, test=0.2)


@register("train_val_test", f"""WITH a AS (
  SELECT doc_id, CASE WHEN rk <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS p1
  FROM (SELECT doc_id, {_rk('doc_id')} AS rk, count(*) OVER () AS n FROM documents)),
b AS (SELECT doc_id, p1, {_rk('doc_id', "'val'", by='p1')} AS rk, count(*) OVER (PARTITION BY p1) AS n FROM a)
SELECT doc_id, CASE WHEN p1 = 'test' THEN 'test' WHEN rk <= ceil(CAST(0.25 AS DOUBLE) * n) THEN 'val' ELSE 'train' END AS part FROM b""")
def q_train_val_test(spark, sf):
    return K.train_val_test(table(spark, sf, "documents").select("doc_id"), "doc_id", SEED)


@register("assign_folds", f"""WITH r AS (SELECT vec_id, label, {_rk('vec_id', by='label')} AS rk FROM embeddings),
cls AS (SELECT label, coalesce(sum(count(*)) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
        FROM embeddings GROUP BY label)
SELECT vec_id, CAST((rk - 1 + st) % 5 AS INTEGER) AS test_fold FROM r JOIN cls ON r.label IS NOT DISTINCT FROM cls.label""")
def q_assign_folds(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return K.assign_folds(e, "vec_id", "label", 5, SEED).select("vec_id", "test_fold")


@register("stratified_kfold", f"WITH {_fold_sql(LABELLED_SQL, 'doc_id', 'quality')} SELECT doc_id, fold, part FROM folds")
def q_stratified_kfold(spark, sf):
    return K.stratified_fold_table(labelled(spark, sf), "doc_id", "quality", k=5, seed=SEED).drop("quality")


@register("covering_splits", f"""WITH r AS (SELECT doc_id, {_rk('doc_id')} AS rk, count(*) OVER () AS n FROM documents),
b AS (SELECT doc_id, n, CAST(CASE WHEN rk <= (n % 10) * (n // 10 + 1) THEN (rk - 1) // (n // 10 + 1)
                 ELSE n % 10 + (rk - 1 - (n % 10) * (n // 10 + 1)) // (n // 10) END AS INTEGER) AS blk FROM r),
e AS (SELECT b.*, CAST(f.fold AS INTEGER) AS fold, blk = f.fold AS inb FROM b, range(10) f(fold)),
r2 AS (SELECT e.*, row_number() OVER (PARTITION BY fold, inb ORDER BY {S.md5_key(SEED, 'doc_id', "'cover'", 'CAST(fold AS VARCHAR)')}, doc_id) AS rk2,
       floor(CAST(0.2 AS DOUBLE) * n) - CASE WHEN fold < n % 10 THEN n // 10 + 1 ELSE n // 10 END AS extra, floor(CAST(0.15 AS DOUBLE) * n) AS vs FROM e)
SELECT doc_id, fold, CASE WHEN inb OR rk2 <= extra THEN 'test' WHEN rk2 <= extra + vs THEN 'val' ELSE 'train' END AS part FROM r2""")
def q_covering_splits(spark, sf):
    return K.covering_fold_table(table(spark, sf, "documents").select("doc_id"), "doc_id", k=10, seed=SEED)


@register("sample_n", f"SELECT doc_id, lang FROM documents ORDER BY {S.md5_key(SEED, 'doc_id')}, doc_id LIMIT 100")
def q_sample_n(spark, sf):
    return K.sample_n(table(spark, sf, "documents").select("doc_id", "lang"), 100, "doc_id", SEED)


@register("shuffle", f"SELECT doc_id, {_rk('doc_id')} AS shuffle_rank FROM documents")
def q_shuffle(spark, sf):
    return K.shuffle(table(spark, sf, "documents").select("doc_id"), "doc_id", SEED)


@register("batches_shuffled", f"SELECT doc_id, CAST(({_rk('doc_id')} - 1) // 16 AS BIGINT) AS batch_id FROM documents")
def q_batches_shuffled(spark, sf):
    return K.batches(table(spark, sf, "documents").select("doc_id"), 16, "doc_id", seed=SEED)


@register("batches_sequential", """SELECT conv_id, turn, CAST((row_number() OVER (ORDER BY conv_id, turn) - 1) // 16 AS BIGINT) AS batch_id
FROM conversations""")
def q_batches_sequential(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    return K.batches(c, 16, "turn", order=["conv_id"])


@register("length_bucketed_batches", f"""SELECT doc_id, CAST((row_number() OVER (ORDER BY n_chars, {S.md5_key(SEED, 'doc_id')}, doc_id) - 1) // 16 AS BIGINT) AS batch_id
FROM documents""")
def q_length_batches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return K.length_bucketed_batches(d, "n_chars", 16, "doc_id", SEED).select("doc_id", "batch_id")


# --- O1, O2 ------------------------------------------------------------------
@register("ranked_sources", """SELECT source, n, row_number() OVER (ORDER BY n, source) AS position
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""")
def q_ranked_sources(spark, sf):
    c = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sequential_rank(O.ranked(c, "n", tie="source"), ["n", "source"], rank_col="position")


@register("best_run", """SELECT user_id, event_id, value FROM (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn
  FROM events WHERE value IS NOT NULL) WHERE rn = 1""")
def q_best_run(spark, sf):
    e = table(spark, sf, "events").where(F.col("value").isNotNull()).select("user_id", "event_id", "value")
    return O.best_run(e, "value", "event_id", by=["user_id"])


# --- Q1, A8 ------------------------------------------------------------------
SCORES_SQL = """(SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS cogency, CAST(embedding[2] AS DOUBLE) AS effectiveness,
  CAST(embedding[3] AS DOUBLE) AS reasonableness, CAST(embedding[4] AS DOUBLE) AS overall FROM embeddings)"""


def scores(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(J.SCORE_COLS)])


def _bins_sql(c: str) -> str:
    labels = Q.SIX_LABELS
    whens = " ".join(f"WHEN {c} <= q_{c}[{i + 2}] THEN '{lab}'" for i, lab in enumerate(labels))
    return f"CASE WHEN {c} IS NULL OR {c} < q_{c}[1] OR {c} > q_{c}[7] THEN NULL {whens} END AS tercile_{c}"


_PROBS_SQL = "[0.0, CAST(1 AS DOUBLE) / 6, CAST(1 AS DOUBLE) / 3, 0.5, CAST(2 AS DOUBLE) / 3, CAST(5 AS DOUBLE) / 6, 1.0]"
BINNED_SQL = f"""(SELECT s.vec_id, {', '.join(_bins_sql(c) for c in J.SCORE_COLS)}
FROM {SCORES_SQL} s, (SELECT {', '.join(f'quantile_cont({c}, {_PROBS_SQL}) AS q_{c}' for c in J.SCORE_COLS)} FROM {SCORES_SQL} z) q)"""


def binned_scores(spark, sf):
    b = Q.quantile_bins(scores(spark, sf), list(J.SCORE_COLS))
    return b.select("vec_id", *[f"tercile_{c}" for c in J.SCORE_COLS])


@register("quantile_bins", f"SELECT * FROM {BINNED_SQL} b")
def q_quantile_bins(spark, sf):
    return binned_scores(spark, sf)


@register("agreement_count", f"""SELECT count(*) FILTER (WHERE NOT (tercile_cogency IS NOT DISTINCT FROM tercile_effectiveness
  AND tercile_effectiveness IS NOT DISTINCT FROM tercile_reasonableness AND tercile_reasonableness IS NOT DISTINCT FROM tercile_overall)) AS n_different,
  count(*) AS n FROM {BINNED_SQL} b""")
def q_agreement_count(spark, sf):
    return A.agreement_count(binned_scores(spark, sf), [f"tercile_{c}" for c in J.SCORE_COLS])


# --- ten logits from all 64 entries of a vector: entry k counts for class k % 10 ---
LOGITS_SQL = "[" + ", ".join(" + ".join(f"CAST(embedding[{k + 1}] AS DOUBLE)" for k in range(i, 64, 10)) for i in range(10)) + "]"


def logits(c: str = "embedding"):
    one = lambda i: sum((F.col(c)[k].cast("double") for k in range(i + 10, 64, 10)), F.col(c)[i].cast("double"))
    return F.array(*[one(i) for i in range(10)])


# --- E1-E13, T9-T12, T16 -------------------------------------------------------
from tessera.functions.keys import order_hash  # noqa: E402
from tessera.operators import metrics as E  # noqa: E402
from tessera.operators import baselines as M  # noqa: E402
from tessera.operators import encode as C  # noqa: E402
from tessera.operators import augment as D  # noqa: E402


def multiclass_eval(spark, sf):
    """Gold = embeddings.label; prediction = md5-derived (the label itself for
    6 of 16 hash digits, else the digit); logits = sums over all 64 entries;
    fold = K3 test fold."""
    e = table(spark, sf, "embeddings")
    d = F.conv(F.substring(order_hash("vec_id", SEED, "pred"), 1, 1), 16, 10).cast("int")
    x = e.select("vec_id", F.col("label").alias("y"), F.when(d < 10, d).otherwise(F.col("label")).alias("y_hat"),
                 logits().alias("logits"))
    return cut_lineage(K.assign_folds(x, "vec_id", "y", 5, SEED, fold_col="fold"))


MC_SQL = f"""WITH ev0 AS (
  SELECT vec_id, label AS y, CAST(CASE WHEN d < 10 THEN d ELSE label END AS INTEGER) AS y_hat,
         {LOGITS_SQL} AS logits
  FROM (SELECT *, strpos('0123456789abcdef', substr({S.md5_key(SEED, 'vec_id', "'pred'")}, 1, 1)) - 1 AS d FROM embeddings)),
r AS (SELECT vec_id, {_rk('vec_id', by='y')} AS rk, y FROM ev0),
cls AS (SELECT y, coalesce(sum(count(*)) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM ev0 GROUP BY y),
ev AS (SELECT ev0.*, CAST((r.rk - 1 + cls.st) % 5 AS INTEGER) AS fold FROM ev0 JOIN r ON ev0.vec_id = r.vec_id JOIN cls ON r.y IS NOT DISTINCT FROM cls.y),
cm AS (SELECT fold, y, y_hat, count(*) AS n FROM ev GROUP BY fold, y, y_hat),
pc AS (SELECT fold, cls, sum(tp) AS tp, sum(pr) AS predicted, sum(sp) AS support FROM (
         SELECT fold, y AS cls, CASE WHEN y = y_hat THEN n ELSE 0 END AS tp, 0 AS pr, n AS sp FROM cm
         UNION ALL SELECT fold, y_hat, 0, n, 0 FROM cm) GROUP BY fold, cls),
pcm AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
               CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
               CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1_score FROM pc)"""


@register("confusion", MC_SQL + " SELECT fold, y, y_hat, n FROM cm")
def q_confusion(spark, sf):
    return E.confusion(multiclass_eval(spark, sf), by=["fold"])


@register("classification_report", MC_SQL + """
SELECT fold, CAST(cls AS VARCHAR) AS label, precision, recall, f1_score, CAST(support AS BIGINT) AS support FROM pcm
UNION ALL SELECT fold, 'macro avg', avg(precision), avg(recall), avg(f1_score), CAST(sum(support) AS BIGINT) FROM pcm GROUP BY fold
UNION ALL SELECT fold, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1_score * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pcm GROUP BY fold""",
          rounded=("precision", "recall", "f1_score"))
def q_classification_report(spark, sf):
    return E.classification_report(multiclass_eval(spark, sf), by=["fold"])


@register("accuracy", MC_SQL + " SELECT fold, avg(CASE WHEN y = y_hat THEN 1.0 ELSE 0.0 END) AS accuracy FROM ev GROUP BY fold",
          rounded=("accuracy",))
def q_accuracy(spark, sf):
    return E.accuracy(multiclass_eval(spark, sf), by=["fold"])


@register("macro_prf", MC_SQL + """ SELECT fold, avg(precision) AS macro_precision, avg(recall) AS macro_recall,
  avg(f1_score) AS macro_f1 FROM pcm GROUP BY fold""", rounded=("macro_precision", "macro_recall", "macro_f1"))
def q_macro_prf(spark, sf):
    return E.macro_prf(multiclass_eval(spark, sf), by=["fold"])


@register("balanced_accuracy", MC_SQL + " SELECT fold, avg(recall) AS balanced_accuracy FROM pcm WHERE support > 0 GROUP BY fold",
          rounded=("balanced_accuracy",))
def q_balanced_accuracy(spark, sf):
    return E.balanced_accuracy(multiclass_eval(spark, sf), by=["fold"])


@register("softmax_argmax", f"""SELECT vec_id, list_transform(p, lambda x: round(x, 6)) AS probs,
  CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS argmax FROM (
  SELECT vec_id, logits, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM (
    SELECT vec_id, logits, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM (
      SELECT vec_id, {LOGITS_SQL} AS logits FROM embeddings)))""")
def q_softmax_argmax(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", logits().alias("logits"))
    return e.select("vec_id", F.transform(T.softmax("logits"), lambda x: F.round(x, 6)).alias("probs"),
                    T.argmax("logits").alias("argmax"))


@register("explode_probs", f"""SELECT vec_id, {', '.join(f'round(p[{i + 1}], 6) AS prediction_class{i}' for i in range(10))} FROM (
  SELECT vec_id, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM (
    SELECT vec_id, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM (
      SELECT vec_id, {LOGITS_SQL} AS logits FROM embeddings)))""")
def q_explode_probs(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", T.softmax(logits()).alias("p"))
    out = C.explode_probs(e, "p", 10).drop("p")
    return out.select("vec_id", *[F.round(f"prediction_class{i}", 6).alias(f"prediction_class{i}") for i in range(10)])


@register("parse_vector", "SELECT vec_id, CAST(CAST(CAST(embedding AS DOUBLE[]) AS VARCHAR) AS DOUBLE[]) AS scores FROM embeddings")
def q_parse_vector(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.to_json(F.col("embedding").cast("array<double>")).alias("s"))
    return e.select("vec_id", T.parse_vector("s").alias("scores"))


def binary_eval(spark, sf):
    """Gold = quality; score p = 0.3 * quality + 0.7 * u (u a seeded uniform); fold = K3 test fold."""
    lab = labelled(spark, sf).select("doc_id", "lang", F.col("quality").alias("y"))
    u = F.conv(F.substring(order_hash("doc_id", SEED, "score"), 1, 13), 16, 10).cast("double") / float(16 ** 13)
    x = lab.withColumn("p", F.lit(0.3) * F.col("y") + F.lit(0.7) * u)
    return cut_lineage(K.assign_folds(x, "doc_id", "y", 5, SEED, fold_col="fold"))


BIN_SQL = f"""WITH b0 AS (
  SELECT doc_id, lang, quality AS y,
         CAST(0.3 AS DOUBLE) * quality + CAST(0.7 AS DOUBLE) * (CAST(('0x' || substr({S.md5_key(SEED, 'doc_id', "'score'")}, 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)) AS p
  FROM {LABELLED_SQL} x),
r AS (SELECT doc_id, {_rk('doc_id', by='y')} AS rk, y FROM b0),
cls AS (SELECT y, coalesce(sum(count(*)) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM b0 GROUP BY y),
bv AS (SELECT b0.*, CAST((r.rk - 1 + cls.st) % 5 AS INTEGER) AS fold FROM b0 JOIN r ON b0.doc_id = r.doc_id JOIN cls ON r.y IS NOT DISTINCT FROM cls.y)"""


@register("binary_prf", BIN_SQL + """
SELECT fold, CASE WHEN pp = 0 THEN 0.0 ELSE tp / pp END AS pos_precision, CASE WHEN ap = 0 THEN 0.0 ELSE tp / ap END AS pos_recall,
       CASE WHEN pp + ap = 0 THEN 0.0 ELSE 2 * tp / (pp + ap) END AS pos_f1
FROM (SELECT fold, count(*) FILTER (WHERE y = 1 AND p > 0.5) AS tp, count(*) FILTER (WHERE p > 0.5) AS pp,
             count(*) FILTER (WHERE y = 1) AS ap FROM bv GROUP BY fold)""", rounded=("pos_precision", "pos_recall", "pos_f1"))
def q_binary_prf(spark, sf):
    b = binary_eval(spark, sf).withColumn("y_hat", (F.col("p") > 0.5).cast("int"))
    return E.binary_prf(b, by=["fold"])


THRESH_SQL = """, g AS (SELECT {by}, i, CAST(i AS DOUBLE) * CAST(0.01 AS DOUBLE) AS t FROM (SELECT DISTINCT {by} FROM bv) z, range(10, 90) r(i)),
s AS (SELECT g.{by}, g.i, g.t, count(*) FILTER (WHERE bv.y = 1 AND bv.p > g.t) AS tp, count(*) FILTER (WHERE bv.y <> 1 AND bv.p > g.t) AS fp,
             count(*) FILTER (WHERE bv.y = 1) AS pos
      FROM g JOIN bv ON g.{by} = bv.{by} GROUP BY g.{by}, g.i, g.t),
f AS (SELECT *, CASE WHEN 2 * tp + fp + (pos - tp) = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + (pos - tp)) END AS f1 FROM s),
best AS (SELECT {by}, t, f1 FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY f1 DESC, i) AS rn FROM f) WHERE rn = 1),
fitted AS (SELECT {by}, CASE WHEN f1 > 0 THEN t ELSE 0.0 END AS threshold, CASE WHEN f1 > 0 THEN f1 ELSE 0.0 END AS f1 FROM best)"""


@register("best_threshold", BIN_SQL + THRESH_SQL.format(by="fold") + " SELECT fold, threshold, f1 FROM fitted",
          rounded=("threshold", "f1"))
def q_best_threshold(spark, sf):
    return E.best_threshold(binary_eval(spark, sf), by=["fold"])


@register("apply_threshold", BIN_SQL + THRESH_SQL.format(by="lang") + """
SELECT d.doc_id, CAST(b.p > f.threshold AS INTEGER) AS y_hat FROM bv b JOIN fitted f ON b.lang = f.lang JOIN documents d ON d.doc_id = b.doc_id""")
def q_apply_threshold(spark, sf):
    b = binary_eval(spark, sf)
    fitted = E.best_threshold(b, by=["lang"])
    return E.apply_threshold(b, fitted, by=["lang"]).select("doc_id", "y_hat")


REG_SQL = """(SELECT l_returnflag, l_extendedprice / 1000.0 AS y, l_quantity * p_retailprice / 1000.0 AS p
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@register("regression_metrics", f"""SELECT l_returnflag, avg((y - p) * (y - p)) AS mse,
  1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)) AS r2, corr(p, y) AS pearson
FROM (SELECT *, avg(y) OVER (PARTITION BY l_returnflag) AS m FROM {REG_SQL} x) GROUP BY l_returnflag""",
          rounded=("mse", "r2", "pearson"))
def q_regression_metrics(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_partkey", "l_extendedprice", "l_quantity")
    pa = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    # prices in thousands
    x = li.join(pa, "l_partkey").select("l_returnflag", (F.col("l_extendedprice") / 1000.0).alias("y"),
                                        (F.col("l_quantity") * F.col("p_retailprice") / 1000.0).alias("p"))
    return E.regression_report(x, by=["l_returnflag"])


@register("weighted_log_loss", MC_SQL + """,
w AS (SELECT y, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM ev GROUP BY y),
pr AS (SELECT fold, y, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM (
        SELECT fold, y, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM ev))
SELECT fold, sum(-w.weight * ln(greatest(pr.p[pr.y + 1], 2.2250738585072014e-308))) / sum(w.weight) AS log_loss FROM pr JOIN w ON pr.y = w.y GROUP BY fold""",
          rounded=("log_loss",))
def q_weighted_log_loss(spark, sf):
    ev = multiclass_eval(spark, sf).withColumn("probs", T.softmax("logits"))
    ev = A.with_class_weight(ev, "y", "weight")
    return E.weighted_log_loss(ev, "probs", "y", "weight", by=["fold"])


@register("batch_metric_mean", MC_SQL + f""",
bt AS (SELECT *, ({_rk('vec_id')} - 1) // 16 AS batch_id FROM ev),
bcm AS (SELECT batch_id, y, y_hat, count(*) AS n FROM bt GROUP BY batch_id, y, y_hat),
bpc AS (SELECT batch_id, cls, sum(tp) AS tp, sum(pr) AS predicted, sum(sp) AS support FROM (
         SELECT batch_id, y AS cls, CASE WHEN y = y_hat THEN n ELSE 0 END AS tp, 0 AS pr, n AS sp FROM bcm
         UNION ALL SELECT batch_id, y_hat, 0, n, 0 FROM bcm) GROUP BY batch_id, cls),
bf AS (SELECT batch_id, avg(CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END) AS f1 FROM bpc GROUP BY batch_id),
ba AS (SELECT batch_id, avg(CASE WHEN y = y_hat THEN 1.0 ELSE 0.0 END) AS acc FROM bt GROUP BY batch_id)
SELECT avg(acc) AS mean_batch_accuracy, avg(f1) AS mean_batch_macro_f1, count(*) AS n_batches FROM ba JOIN bf ON ba.batch_id = bf.batch_id""",
          rounded=("mean_batch_accuracy", "mean_batch_macro_f1"))
def q_batch_metric_mean(spark, sf):
    ev = K.batches(multiclass_eval(spark, sf), 16, "vec_id", seed=SEED)
    return E.batch_metric_mean(ev)


@register("format_metric", MC_SQL + " SELECT fold, printf('%.2f', avg(CASE WHEN y = y_hat THEN 1.0 ELSE 0.0 END)) AS accuracy FROM ev GROUP BY fold")
def q_format_metric(spark, sf):
    a = E.accuracy(multiclass_eval(spark, sf), by=["fold"])
    return a.select("fold", T.format_metric("accuracy").alias("accuracy"))


# --- M1, M2, A9-A11 ------------------------------------------------------------
def baseline_predictions(spark, sf):
    lf = labelled_folds(spark, sf).select("doc_id", "fold", "part", "quality")
    train, ev = lf.where(F.col("part") == "train"), lf.where(F.col("part") != "train")
    maj = M.majority_baseline(train, ev, "quality", by=["fold"]).withColumn("model", F.lit("majority"))
    uni = M.uniform_baseline(train, ev, "quality", "doc_id", SEED, by=["fold"]).withColumn("model", F.lit("uniform"))
    return maj.unionByName(uni)


BASE_SQL = LABELLED_FOLDS_SQL + f""",
tr AS (SELECT * FROM lf WHERE part = 'train'), te AS (SELECT * FROM lf WHERE part <> 'train'),
maj AS (SELECT fold, first(quality ORDER BY n DESC, quality) AS y_hat FROM (SELECT fold, quality, count(*) AS n FROM tr GROUP BY fold, quality) GROUP BY fold),
cl AS (SELECT fold, list(DISTINCT quality ORDER BY quality) AS classes FROM tr GROUP BY fold),
preds AS (
  SELECT te.doc_id, te.fold, te.part, te.quality, maj.y_hat, 'majority' AS model FROM te JOIN maj ON te.fold = maj.fold
  UNION ALL
  SELECT te.doc_id, te.fold, te.part, te.quality,
         cl.classes[1 + CAST(('0x' || substr({S.md5_key(SEED, 'te.doc_id', "'uniform'")}, 1, 13)) AS BIGINT) % len(cl.classes)], 'uniform'
  FROM te JOIN cl ON te.fold = cl.fold),
pcm AS (SELECT model, fold, part, cls, CASE WHEN sum(pr) = 0 THEN 0.0 ELSE sum(tp) / sum(pr) END AS precision,
               CASE WHEN sum(sp) = 0 THEN 0.0 ELSE sum(tp) / sum(sp) END AS recall,
               CASE WHEN sum(sp) + sum(pr) = 0 THEN 0.0 ELSE 2 * sum(tp) / (sum(sp) + sum(pr)) END AS f1_score, sum(sp) AS support
        FROM (SELECT model, fold, part, quality AS cls, CASE WHEN quality = y_hat THEN 1 ELSE 0 END AS tp, 0 AS pr, 1 AS sp FROM preds
              UNION ALL SELECT model, fold, part, y_hat, 0, 1, 0 FROM preds) GROUP BY model, fold, part, cls),
mets AS (
  SELECT model, fold, part, metric, value FROM (
    SELECT model, fold, part, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1_score) AS macro_f1
    FROM pcm GROUP BY model, fold, part) UNPIVOT (value FOR metric IN (macro_precision, macro_recall, macro_f1))
  UNION ALL SELECT model, fold, part, 'accuracy', avg(CASE WHEN quality = y_hat THEN 1.0 ELSE 0.0 END) FROM preds GROUP BY model, fold, part)"""


def baseline_metrics(spark, sf):
    p = baseline_predictions(spark, sf)
    by = ["model", "fold", "part"]
    m = E.summary(p, "quality", "y_hat", by=by)
    return m.unpivot(by, ["macro_precision", "macro_recall", "macro_f1", "accuracy"], "metric", "value")


@register("baseline_predictions", BASE_SQL + " SELECT doc_id, fold, part, model, y_hat FROM preds")
def q_baseline_predictions(spark, sf):
    return baseline_predictions(spark, sf).select("doc_id", "fold", "part", "model", "y_hat")


@register("baseline_metrics", BASE_SQL + " SELECT * FROM mets", rounded=("value",))
def q_baseline_metrics(spark, sf):
    return baseline_metrics(spark, sf)


@register("fold_average", BASE_SQL + " SELECT model, part, metric, avg(value) AS mean, count(*) AS n_folds FROM mets GROUP BY model, part, metric",
          rounded=("mean",))
def q_fold_average(spark, sf):
    return A.fold_average(baseline_metrics(spark, sf))


@register("report_summary", BASE_SQL + """ SELECT model, part, metric,
  CASE WHEN min(value) = 0 THEN 0.0 ELSE exp(avg(ln(value))) END AS geo_mean, stddev_samp(value) AS stdev, count(*) AS n
FROM mets GROUP BY model, part, metric""", rounded=("geo_mean", "stdev"))
def q_report_summary(spark, sf):
    return A.report_summary(baseline_metrics(spark, sf), by=["model", "part", "metric"])


@register("class_report_summary", BASE_SQL + """ SELECT model, part, label, metric, avg(value) AS mean, stddev_samp(value) AS stdev, count(*) AS n
FROM (SELECT model, fold, part, CAST(cls AS VARCHAR) AS label, metric, value FROM pcm
      UNPIVOT (value FOR metric IN (precision, recall, f1_score))) GROUP BY model, part, label, metric""",
          rounded=("mean", "stdev"))
def q_class_report_summary(spark, sf):
    p = baseline_predictions(spark, sf)
    rep = E.classification_report(p, "quality", "y_hat", by=["model", "fold", "part"]) \
        .where(~F.col("label").isin("macro avg", "weighted avg"))
    long = rep.unpivot(["model", "fold", "part", "label"], ["precision", "recall", "f1_score"], "metric", "value")
    return A.class_report_summary(long, by=["model", "part", "label", "metric"])


# --- T13-T15, T8, D1, D2 -----------------------------------------------------
@register("encode_labels", """SELECT d.doc_id, m.idx AS label_index, m.lang AS decoded FROM documents d LEFT JOIN (
  SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)) m
ON d.lang = m.lang""")
def q_encode_labels(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    mapping = C.fit_label_encoder(d, "lang")
    enc = C.encode_labels(d, mapping, "lang")
    dec = C.decode_labels(enc.select("doc_id", "label_index"), mapping.withColumnRenamed("lang", "decoded"), "decoded")
    return dec.select("doc_id", "label_index", "decoded")


VOCAB_SIZE, MAX_LEN = 30_000, 256
CLEAN_DOCS_SQL = f"(SELECT doc_id, {S.clean_text('text')} AS cleaned_comment FROM documents)"
VOCAB_SQL = f"""WITH toks AS (SELECT doc_id, list_filter(string_split(lower(cleaned_comment), ' '), lambda w: w <> '') AS t FROM {CLEAN_DOCS_SQL} c),
words AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS p FROM toks),
vocab AS (SELECT word, freq, CAST(row_number() OVER (ORDER BY freq DESC, word) - 1 + 4 AS INTEGER) AS id FROM (
  SELECT word, count(*) AS freq FROM words GROUP BY word ORDER BY freq DESC, word LIMIT {VOCAB_SIZE}))"""


def cleaned_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_text("text").alias("cleaned_comment"))


@register("vocabulary", VOCAB_SQL + " SELECT word, freq, id FROM vocab")
def q_vocabulary(spark, sf):
    return C.build_vocabulary(cleaned_docs(spark, sf), "cleaned_comment", VOCAB_SIZE)


@register("encode_sequences", VOCAB_SQL + f""",
enc AS (SELECT w.doc_id, list(coalesce(v.id, 1) ORDER BY w.p) AS ids FROM words w LEFT JOIN vocab v ON w.word = v.word
        WHERE w.p < {MAX_LEN - 2} GROUP BY w.doc_id),
seq AS (SELECT d.doc_id, CAST(list_resize(list_concat([2], coalesce(enc.ids, []), [3]), {MAX_LEN}, 0) AS INTEGER[]) AS input_ids
        FROM documents d LEFT JOIN enc ON d.doc_id = enc.doc_id)
SELECT doc_id, input_ids, CAST(list_transform(input_ids, lambda x: CAST(x > 0 AS INTEGER)) AS INTEGER[]) AS attention_mask FROM seq""")
def q_encode_sequences(spark, sf):
    docs = cleaned_docs(spark, sf)
    vocab = C.build_vocabulary(docs, "cleaned_comment", VOCAB_SIZE)
    enc = C.encode_sequences(docs, "cleaned_comment", "doc_id", vocab, MAX_LEN)
    return enc.select("doc_id", "input_ids", T.attention_mask("input_ids").alias("attention_mask"))


@register("compose_text", f"""SELECT c.doc_id, printf('{C.COMPOSE_TEMPLATE}', coalesce(b.tercile_cogency, 'nan'),
  coalesce(b.tercile_effectiveness, 'nan'), coalesce(b.tercile_reasonableness, 'nan'), coalesce(b.tercile_overall, 'nan'), c.cleaned_comment) AS "AQ"
FROM {CLEAN_DOCS_SQL} c LEFT JOIN {BINNED_SQL} b ON c.doc_id = b.vec_id""")
def q_compose_text(spark, sf):
    binned = binned_scores(spark, sf).withColumn("doc_id", F.col("vec_id"))
    bins = [f"tercile_{c}" for c in J.SCORE_COLS]
    return C.compose_with_lookup(cleaned_docs(spark, sf), binned, "doc_id", "vec_id", bins, "cleaned_comment", on_missing="null") \
        .select("doc_id", "AQ")


ID_SQL = ("concat_ws('#', CAST(doc_id AS VARCHAR), CAST(doc_id % 5 AS VARCHAR), CAST(doc_id % 7 AS VARCHAR), "
          "CAST(doc_id % 3 AS VARCHAR), coalesce(source, 'nan'))")


@register("augmentation_candidates", f"""WITH c AS (SELECT doc_id, quality, {S.clean_text('text')} AS cleaned_comment, {ID_SQL} AS "ID"
  FROM {LABELLED_SQL} x WHERE text IS NOT NULL),
q AS (SELECT * FROM c WHERE quality = 0 AND length(cleaned_comment) - length(replace(cleaned_comment, ' ', '')) + 1 >= 5),
f AS (SELECT "ID", arg_min(cleaned_comment, doc_id) AS sent, min(doc_id) AS o FROM q GROUP BY "ID")
SELECT sent, arg_max("ID", o) AS "ID" FROM f GROUP BY sent""")
def q_augmentation_candidates(spark, sf):
    c = require(corpus_with_key_parts(spark, sf), "text", "quality").withColumn("cleaned_comment", T.clean_text("text"))
    c = with_id(c, ["UniqueID", "small_gr", "nr", "sequence", "name"])
    return D.augmentation_candidates(c, "quality", 0, order="doc_id")


@register("augment_training", LABELLED_FOLDS_SQL + f""",
tr AS (SELECT fold, doc_id, CAST(doc_id AS VARCHAR) AS "UniqueID", quality, {S.clean_text('text')} AS cleaned_comment
       FROM lf WHERE part = 'train'),
twice AS (SELECT conv_id, text, 1 AS k FROM conversations UNION ALL SELECT conv_id, text, 2 FROM conversations WHERE role = 'system'),
sents AS (SELECT tr.fold, CAST(tr.doc_id AS VARCHAR) || chr(1) || c.text || CASE WHEN c.k > 1 THEN chr(1) || '2' ELSE '' END AS aid, c.text AS sent
          FROM tr JOIN twice c ON tr."UniqueID" = CAST(c.conv_id AS VARCHAR)),
sr AS (SELECT fold, sent, row_number() OVER (PARTITION BY fold ORDER BY {S.md5_key(SEED, 'aid', "'sentence'")}, aid) AS rk FROM sents),
dr AS (SELECT tr.*, row_number() OVER (PARTITION BY fold ORDER BY {S.md5_key(SEED, 'doc_id', "'donor'")}, doc_id) AS rk FROM tr)
SELECT fold, doc_id, "UniqueID", quality, cleaned_comment, CAST(NULL AS VARCHAR) AS augmented_from FROM tr
UNION ALL
SELECT dr.fold, dr.doc_id, 'AUGMENTED', 0, sr.sent, CAST(dr.doc_id AS VARCHAR) FROM dr JOIN sr ON dr.fold = sr.fold AND dr.rk = sr.rk""")
def q_augment_training(spark, sf):
    lf = labelled_folds(spark, sf).where(F.col("part") == "train")
    train = lf.select("fold", "doc_id", F.col("doc_id").cast("string").alias("UniqueID"), "quality",
                      T.clean_text("text").alias("cleaned_comment"))
    train = cut_lineage(train)  # read four times below: clean it once
    # system turns occur twice: a sentence repeated for an ID is appended as often
    said = table(spark, sf, "conversations")
    aug = said.unionByName(said.where("role = 'system'")).select(F.col("conv_id").cast("string").alias("ID"), F.col("text").alias("sent"))
    return D.augment_training(train.withColumn("ID", F.col("UniqueID")), aug, "quality", 0, key="ID", seed=SEED) \
        .drop("ID")


# --- M3-M10, H1 (rows-only: fitted numbers have no SQL oracle) ------------------
import numpy as np  # noqa: E402

from tessera.operators import crossfit as CF  # noqa: E402
from tessera.operators import models as MD  # noqa: E402

FOREST_TREES = 1000  # the reference's forest size


def score_frame(spark, sf):
    """Embeddings as a scored corpus: four scores, the class label and a K3 fold."""
    return cut_lineage(K.assign_folds(scores(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id"),
                                      "vec_id", "label", 5, SEED, fold_col="fold"))


_FORESTS: dict = {}


def _forest(spark, sf):
    """The forest of a table, fitted once per application: M3 and M5 read the same model."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _FORESTS:
        s = score_frame(spark, sf)
        _FORESTS[at] = MD.score_forest(s.where("fold <> 0"), s.where("fold = 0"), "label", num_trees=FOREST_TREES,
                                       seed=0, keep=["vec_id"], key="vec_id")
    return _FORESTS[at]


@register("score_forest")
def q_score_forest(spark, sf):
    return _forest(spark, sf)[1]


@register("feature_importance")
def q_feature_importance(spark, sf):
    return MD.feature_importance(_forest(spark, sf)[0], spark=spark)


@register("stacked_forest")
def q_stacked_forest(spark, sf):
    ev = multiclass_eval(spark, sf)
    preds = ev.select("vec_id", F.concat(F.lit("fold"), F.col("fold").cast("string")).alias("file"),
                      F.col("vec_id").alias("pos"), T.softmax("logits").alias("predictions"))
    base = table(spark, sf, "embeddings").select("vec_id", "label").join(ev.select("vec_id", "fold"), "vec_id")
    sc = scores(spark, sf)
    return MD.stacked_forest(base.where("fold <> 0"), base.where("fold = 0"), "label", "vec_id", sc, "vec_id",
                             preds, 10, num_trees=FOREST_TREES, seed=0)[1]


@register("fused_mlp")
def q_fused_mlp(spark, sf):
    s = cut_lineage(score_frame(spark, sf).join(
        table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 5, 60).alias("text_vec")), "vec_id"))
    return MD.fused_mlp(s.where("fold <> 0"), s.where("fold = 0"), "label", "text_vec", list(J.SCORE_COLS), 10,
                        keep=["vec_id"], key="vec_id")[1]


def labelled_text(spark, sf):
    lab = labelled(spark, sf).select("doc_id", "quality", T.clean_text("text").alias("cleaned_comment"))
    return cut_lineage(K.assign_folds(lab, "doc_id", "quality", 5, SEED, fold_col="fold"))


@register("text_classifier")
def q_text_classifier(spark, sf):
    d = labelled_text(spark, sf)
    model = MD.text_classifier(d.where("fold <> 0"), "quality", key="doc_id")
    return MD.predict(model, d.where("fold = 0"), ["doc_id", "quality"])


@register("text_regressor")
def q_text_regressor(spark, sf):
    d = labelled_text(spark, sf).withColumn("target", F.col("quality").cast("double"))
    model = MD.text_regressor(d.where("fold <> 0"), "target", key="doc_id")
    return model.transform(d.where("fold = 0")).select("doc_id", "target", "prediction")


def _linear_predictor():
    # user predictor: a fixed random projection of 64 features to 10 logits
    w = np.random.default_rng(7).normal(size=(64, 10))
    return lambda x: x @ w


def _linear_logits_sql() -> str:
    """The fixed predictor's logits in SQL: a product with each column of its weights."""
    columns = _linear_predictor()(np.eye(64)).T
    return "[" + ", ".join(f"list_dot_product(CAST(embedding AS DOUBLE[]), {[float(x) for x in w]})" for w in columns) + "]"


@register("score_corpus", f"""SELECT vec_id, list_transform(ex, lambda x: round(x / list_sum(ex), 6)) AS probability,
  CAST(list_position(ex, list_max(ex)) - 1 AS INTEGER) AS y_hat
FROM (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS ex FROM (SELECT vec_id, {_linear_logits_sql()} AS z FROM embeddings))""")
def q_score_corpus(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    scored = MD.score_corpus(e, "embedding", _linear_predictor, 10, keep=["vec_id"])
    return scored.select("vec_id", F.transform("probability", lambda x: F.round(x, 6)).alias("probability"), "y_hat")


@register("out_of_fold")
def q_out_of_fold(spark, sf):
    d = labelled(spark, sf).select("doc_id", "quality", T.clean_text("text").alias("cleaned_comment"))
    return CF.text_out_of_fold(d, "doc_id", "quality", k=5, seed=SEED)


@register("sweep")
def q_sweep(spark, sf):
    d = labelled_text(spark, sf)
    return MD.sweep(d, "quality", key="doc_id")[1]


# --- S1-S8 and streaming: round trips of derived data through shared storage --
import uuid  # noqa: E402

from pyspark.sql.types import LongType, StringType, StructField, StructType  # noqa: E402

from tessera.session import checkpoint_dir  # noqa: E402,F811
from tessera.sources import files as IO  # noqa: E402
from tessera.streaming import corpus_stream as ST  # noqa: E402


def _io_dir(spark, what: str) -> str:
    """A fresh folder for derived files under the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tessera-io/{what}-{uuid.uuid4().hex}"


SPLIT_SCHEMA = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()),
                           StructField("text", StringType())])


@register("splits_tsv_round_trip", LABELLED_FOLDS_SQL + " SELECT doc_id, fold, part, quality, text FROM lf")
def q_splits_tsv_round_trip(spark, sf):
    """S5 (TSV) then S2/S1: whole multi-line texts survive the header-TSV round trip."""
    out = _io_dir(spark, "splits")
    IO.write_splits(labelled_folds(spark, sf).select("doc_id", "quality", "text", "fold", "part"), out, fmt="tsv")
    return IO.read_splits(spark, out, SPLIT_SCHEMA, fmt="tsv-partitioned").select("doc_id", "fold", "part", "quality", "text")


@register("predictions_round_trip", f"""SELECT doc_id, text, label AS gold, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred,
  list_transform(list_transform(ex, lambda x: x / list_sum(ex)), lambda x: round(x, 6)) AS probability FROM (
  SELECT doc_id, text, label, logits, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM (
    SELECT doc_id, text, label, {LOGITS_SQL} AS logits FROM documents JOIN embeddings ON doc_id = vec_id))""")
def q_predictions_round_trip(spark, sf):
    """S6 (TSV with the whole text, vector as JSON text) then S3 (T9 parse)."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("gold"), logits().alias("l"))
    e = table(spark, sf, "documents").select("doc_id", "text").join(e, "doc_id")
    e = e.select("doc_id", "text", "gold", T.argmax("l").alias("pred"), T.softmax("l").alias("probability"))
    out = _io_dir(spark, "predictions")
    IO.write_predictions(e, out, fmt="tsv")
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("gold", IntegerType()),
                         StructField("pred", IntegerType()), StructField("probability", StringType())])
    back = IO.read_predictions(spark, out, schema, vec="probability")
    return back.select("doc_id", "text", "gold", "pred", F.transform("probability", lambda x: F.round(x, 6)).alias("probability"))


@register("distributions_written", LABELLED_FOLDS_SQL + "\n" + _vc_sql("lf", ["quality", "toxic", "lang"], by=["fold", "part"]))
def q_distributions_written(spark, sf):
    """S8 writes A3 partitioned by label column; read back with partition discovery."""
    out = _io_dir(spark, "distributions")
    IO.write_distributions(labelled_folds(spark, sf), ["quality", "toxic", "lang"], out)
    return spark.read.parquet(out).select("fold", "part", "field", "value", "n")


@register("metrics_written", BASE_SQL + " SELECT * FROM mets", rounded=("value",))
def q_metrics_written(spark, sf):
    """The long metrics table written as JSON lines and read back with its schema."""
    m = baseline_metrics(spark, sf)
    out = _io_dir(spark, "metrics")
    IO.write_metrics(m, out, fmt="json")
    return spark.read.schema(m.schema).json(out)


@register("stream_clean", f"""SELECT doc_id, {S.clean_text('text')} AS cleaned_comment,
  CAST(length({S.clean_text('text')}) - length(replace({S.clean_text('text')}, ' ', '')) + 1 AS INTEGER) AS n_words
FROM {LABELLED_SQL} x WHERE text IS NOT NULL""")
def q_stream_clean(spark, sf):
    """The cleaning chain as a Structured Streaming job over the documents table
    (availableNow trigger, Parquet sink with its checkpoint on shared storage)."""
    docs = table(spark, sf, "documents")
    # a pattern takes the table as a single file and as a folder of files
    src = ST.read_corpus_stream(spark, f"{sf.rstrip('/')}/documents.parque[t]", docs.schema)
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    cleaned = ST.clean_corpus_stream(src.join(lab, "doc_id", "inner"), label="quality")
    out = _io_dir(spark, "stream")
    q = ST.start_clean_sink(cleaned.select("doc_id", "cleaned_comment", "n_words"), f"{out}/data", f"{out}/_checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{out}/data")


@register("expected_split_sizes", f"""SELECT lang, n, ts AS test_size, vs AS val_size, n - ts - vs AS train_size FROM (
  SELECT lang, count(*) AS n, CAST(floor(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS ts,
         CAST(floor(CAST(0.15 AS DOUBLE) * count(*)) AS BIGINT) AS vs FROM {LABELLED_SQL} x GROUP BY lang)""")
def q_expected_split_sizes(spark, sf):
    return A.expected_sizes(labelled(spark, sf), by=["lang"])


# --- workflows -------------------------------------------------
from tessera.plans import workflows as W  # noqa: E402


def language_sources(spark, sf):
    """The corpus as per-language sources, like the reference's three input files."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("UniqueID"), "source",
                                             F.col("text").alias("translation"), "lang")
    langs = [r.lang for r in d.select("lang").where("lang IS NOT NULL").distinct().collect()]  # a few languages
    return {lang: d.where(F.col("lang") == lang).drop("lang") for lang in sorted(langs)}


@register("corpus_build", f"""SELECT doc_id AS "UniqueID", lang AS orig_lang, {S.clean_text('text')} AS cleaned_comment
FROM documents WHERE lang IS NOT NULL AND doc_id IS DISTINCT FROM 1""")
def q_corpus_build(spark, sf):
    return W.build_corpus(language_sources(spark, sf)).select("UniqueID", "orig_lang", "cleaned_comment")


@register("corpus_split_views", f"""WITH c AS (SELECT d.doc_id, l.quality, {S.clean_text('d.text')} AS cleaned_comment
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL AND l.quality IS NOT NULL),
u AS (SELECT * FROM c WHERE doc_id IN (SELECT min(doc_id) FROM c GROUP BY cleaned_comment)),
{_fold_sql('u', 'doc_id', 'quality')}
SELECT doc_id, fold, part, quality FROM folds""")
def q_corpus_split_views(spark, sf):
    c = corpus(spark, sf).withColumn("cleaned_comment", T.clean_text("text"))
    return W.split_corpus(c, "doc_id", "quality", "doc_id", k=5, seed=SEED).select("doc_id", "fold", "part", "quality")


@register("kfold_text_report")
def q_kfold_text_report(spark, sf):
    d = labelled(spark, sf).select("doc_id", "quality", T.clean_text("text").alias("cleaned_comment"))
    return W.kfold_text_evaluation(d, "doc_id", "quality", k=5, seed=SEED)[1]


def _report_rows_sql() -> str:
    metrics = ("precision", "recall", "f1_score")
    names = {"precision": "precision", "recall": "recall", "f1_score": "f1"}
    cls = " UNION ALL ".join(
        f"SELECT fold, CAST(cls AS VARCHAR) AS label, '{names[m]}' AS metric, {m} AS value FROM pcm" for m in metrics)
    cls += " UNION ALL SELECT fold, CAST(cls AS VARCHAR), 'support', CAST(support AS DOUBLE) FROM pcm"
    avg = []
    for kind, agg in (("macro", "avg({m})"), ("weighted", "sum({m} * support) / sum(support)")):
        for m in metrics:
            avg.append(f"SELECT fold, 'all', '{kind}_{names[m]}', {agg.format(m=m)} FROM pcm GROUP BY fold")
        avg.append(f"SELECT fold, 'all', '{kind}_support', CAST(sum(support) AS DOUBLE) FROM pcm GROUP BY fold")
    acc = "SELECT fold, 'all', 'accuracy', avg(CASE WHEN y = y_hat THEN 1.0 ELSE 0.0 END) FROM ev GROUP BY fold"
    return " UNION ALL ".join([cls, *avg, acc])


@register("reports_round_trip", MC_SQL + f""",
rows AS ({_report_rows_sql()})
SELECT 'fold' || CAST(fold AS VARCHAR) AS run, 'test' AS split, label, metric, round(value, 6) AS value FROM rows""")
def q_reports_round_trip(spark, sf):
    """E2 reports per fold written as text reports (one run per fold), then S4."""
    ev = multiclass_eval(spark, sf)
    rep = E.classification_report(ev, by=["fold"])
    acc = ev.groupBy("fold").agg(F.lit("accuracy").alias("label"),
                                 F.avg((F.col("y") == F.col("y_hat")).cast("double")).alias("precision"),
                                 F.lit(None).cast("double").alias("recall"), F.lit(None).cast("double").alias("f1_score"),
                                 F.count(F.lit(1)).alias("support"))
    rep = rep.unionByName(acc).withColumn("run", F.concat(F.lit("fold"), F.col("fold").cast("string"))) \
        .withColumn("split", F.lit("test"))
    out = _io_dir(spark, "reports")
    IO.write_reports(rep, out)
    back = IO.read_reports(spark, out)
    return back.select("run", "split", "label", "metric", F.round("value", 6).alias("value"))


# --- evaluation in one pass, null groups, NaN and zero probabilities -------------
@register("evaluate", BIN_SQL + """,
e AS (SELECT lang, y, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS h FROM bv),
k AS (SELECT lang, cls, sum(tp) AS tp, sum(pr) AS pr, sum(sp) AS sp FROM (
        SELECT lang, y AS cls, CASE WHEN y = h THEN 1 ELSE 0 END AS tp, 0 AS pr, 1 AS sp FROM e
        UNION ALL SELECT lang, h, 0, 1, 0 FROM e) GROUP BY lang, cls),
m AS (SELECT *, CASE WHEN pr = 0 THEN 0.0 ELSE tp / pr END AS p, CASE WHEN sp = 0 THEN 0.0 ELSE tp / sp END AS r,
             CASE WHEN pr + sp = 0 THEN 0.0 ELSE 2 * tp / (pr + sp) END AS f FROM k)
SELECT lang, sum(tp) / sum(sp) AS accuracy, avg(r) FILTER (sp > 0) AS balanced_accuracy, avg(p) AS macro_precision, avg(r) AS macro_recall,
       avg(f) AS macro_f1, coalesce(max(p) FILTER (cls = 1), 0) AS pos_precision, coalesce(max(r) FILTER (cls = 1), 0) AS pos_recall,
       coalesce(max(f) FILTER (cls = 1), 0) AS pos_f1 FROM m GROUP BY lang""",
          rounded=("accuracy", "balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", "pos_precision", "pos_recall", "pos_f1"))
def q_evaluate(spark, sf):
    return E.evaluate(binary_eval(spark, sf), p="p", by=["lang"])


@register("classification_report_accuracy", MC_SQL + """
SELECT fold, avg(CASE WHEN y = y_hat THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS support FROM ev GROUP BY fold""", rounded=("accuracy",))
def q_classification_report_accuracy(spark, sf):
    rep = E.classification_report(multiclass_eval(spark, sf), by=["fold"], with_accuracy=True)
    return rep.where("label = 'accuracy'").select("fold", F.col("precision").alias("accuracy"), "support")


NULL_REG_SQL = f"(SELECT nullif(l_returnflag, 'A') AS g, y, p FROM {REG_SQL} x)"


def null_group_regression(spark, sf):
    li = table(spark, sf, "lineitem").select(F.expr("nullif(l_returnflag, 'A')").alias("g"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"),
                                             (F.col("l_extendedprice") / 1000.0).alias("y"), "l_quantity")
    pa = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return li.join(pa, "p_partkey").withColumn("p", F.col("l_quantity") * F.col("p_retailprice") / 1000.0)


@register("regression_null_group", f"""SELECT g, avg((y - p) * (y - p)) AS mse, 1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)) AS r2, corr(p, y) AS pearson
FROM (SELECT *, avg(y) OVER (PARTITION BY g) AS m FROM {NULL_REG_SQL} z) GROUP BY g""", rounded=("mse", "r2", "pearson"))
def q_regression_null_group(spark, sf):
    return E.regression_report(null_group_regression(spark, sf), by=["g"])


@register("batch_regression_mean", """WITH x AS (SELECT l_orderkey % 97 AS batch_id, l_extendedprice / 1000.0 AS y, l_quantity * p_retailprice / 1000.0 AS p
  FROM lineitem JOIN part ON l_partkey = p_partkey),
b AS (SELECT batch_id, 1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)) AS r2, corr(p, y) AS c
      FROM (SELECT *, avg(y) OVER (PARTITION BY batch_id) AS m FROM x) GROUP BY batch_id)
SELECT avg(r2) AS mean_batch_r2, avg(c) AS mean_batch_pearson, count(*) AS n_batches FROM b""", rounded=("mean_batch_r2", "mean_batch_pearson"))
def q_batch_regression_mean(spark, sf):
    x = null_group_regression(spark, sf).withColumn("batch_id", F.col("l_orderkey") % 97)
    return E.batch_regression_mean(x)


@register("threshold_null_group", BIN_SQL + """,
n AS (SELECT doc_id, nullif(lang, 'en') AS g, y, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE p END AS p FROM bv),
t AS (SELECT g, i, i * CAST(0.01 AS DOUBLE) AS t, count(*) FILTER (p > i * CAST(0.01 AS DOUBLE) AND y = 1) AS tp,
             count(*) FILTER (p > i * CAST(0.01 AS DOUBLE)) AS pp, count(*) FILTER (y = 1) AS ap
      FROM n, range(10, 90) r(i) GROUP BY g, i),
f AS (SELECT *, CASE WHEN pp + ap = 0 THEN 0.0 ELSE 2 * tp / (pp + ap) END AS f1 FROM t),
b AS (SELECT g, first(CASE WHEN f1 > 0 THEN t ELSE 0.0 END ORDER BY f1 DESC, i) AS threshold FROM f GROUP BY g)
SELECT doc_id, CAST(coalesce(p > threshold, false) AS INTEGER) AS y_hat FROM n JOIN b ON n.g IS NOT DISTINCT FROM b.g""")
def q_threshold_null_group(spark, sf):
    """E7 and E8 with a null group, and scores that are NaN (no threshold is below them)."""
    b = binary_eval(spark, sf).withColumn("g", F.expr("nullif(lang, 'en')"))
    b = b.withColumn("p", F.when(F.col("doc_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("p")))
    return E.apply_threshold(b, E.best_threshold(b, by=["g"]), by=["g"]).select("doc_id", "y_hat")


@register("batches_null_order", """SELECT doc_id, CAST((row_number() OVER (ORDER BY nullif(lang, 'en') NULLS FIRST, doc_id) - 1) // 16 AS BIGINT) AS batch_id
FROM documents""")
def q_batches_null_order(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr("nullif(lang, 'en')").alias("g"))
    return K.batches(d, 16, "doc_id", order=["g"]).select("doc_id", "batch_id")


@register("best_run_nan", """SELECT user_id, event_id, value FROM (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn
  FROM events WHERE value IS NOT NULL AND event_id % 3 <> 0) WHERE rn = 1""")
def q_best_run_nan(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return O.best_run(e, "value", "event_id", by=["user_id"])


@register("log_loss_certain", """SELECT l_returnflag, sum(-ln(greatest(p, 2.2250738585072014e-308))) / count(*) AS log_loss
FROM (SELECT l_returnflag, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE 1.0 END AS p FROM lineitem) GROUP BY l_returnflag""", rounded=("log_loss",))
def q_log_loss_certain(spark, sf):
    """E12 where the gold class has probability 0 or 1."""
    x = table(spark, sf, "lineitem").select("l_returnflag", F.lit(0).alias("y"), F.lit(1.0).alias("weight"),
                                            F.when(F.col("l_linenumber") == 1, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("probs"))
    return E.weighted_log_loss(x, "probs", by=["l_returnflag"])


@register("stacked_features", f"""SELECT ev.vec_id, s.cogency, s.effectiveness, s.reasonableness, s.overall,
  {', '.join(f'round(p[{i + 1}], 6) AS prediction_class{i}' for i in range(10))}
FROM (SELECT vec_id, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM (
  SELECT vec_id, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM (SELECT vec_id, {LOGITS_SQL} AS logits FROM embeddings))) ev
JOIN {SCORES_SQL} s ON ev.vec_id = s.vec_id""")
def q_stacked_features(spark, sf):
    """The joined features of the stacked forest (J1 scores, J3 vectors, T10 columns)."""
    e = table(spark, sf, "embeddings")
    preds = e.select("vec_id", F.lit("f").alias("file"), F.col("vec_id").alias("pos"), T.softmax(logits()).alias("predictions"))
    x = J.attach_scores(e.select("vec_id"), scores(spark, sf), "vec_id", "vec_id", J.SCORE_COLS)
    x = C.explode_probs(J.attach_predictions(x, preds, "vec_id", on_missing="error"), "predictions", 10)
    return x.select("vec_id", *J.SCORE_COLS, *[F.round(f"prediction_class{i}", 6).alias(f"prediction_class{i}") for i in range(10)])


@register("report_directory", MC_SQL + f""",
rows AS ({_report_rows_sql()})
SELECT 'test' AS split, metric, count(*) AS n_runs, avg(value) AS mean FROM rows WHERE label = 'all' GROUP BY metric""", rounded=("mean",))
def q_report_directory(spark, sf):
    """Text reports of five runs, read back and averaged per metric."""
    rep = E.classification_report(multiclass_eval(spark, sf), by=["fold"], with_accuracy=True)
    rep = rep.withColumn("run", F.concat(F.lit("fold"), F.col("fold").cast("string"))).withColumn("split", F.lit("test"))
    out = _io_dir(spark, "report-directory")
    IO.write_reports(rep, out)
    back = IO.read_reports(spark, out).where("label = 'all'")
    return back.groupBy("split", "metric").agg(F.count(F.lit(1)).alias("n_runs"), F.avg("value").alias("mean"))


from tessera.plans import edge_queries, fold_queries  # noqa: E402,F401  (register their queries)
