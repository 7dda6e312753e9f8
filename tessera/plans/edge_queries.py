"""Registered queries of the rules for null keys, groups, orders and labels, of hot keys
and of the ingested file order. Their inputs derive the nulls from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.functions import text as T
from tessera.operators import augment as D
from tessera.operators import joins as J
from tessera.operators import metrics as E
from tessera.operators import profile as A
from tessera.operators import sets as U
from tessera.operators import splits as K
from tessera.operators.small import join_small
from tessera.plans.catalog import CORPUS_SQL, MC_SQL, _io_dir, corpus, cut_lineage, labelled, multiclass_eval, register, table
from tessera.plans.corpus import SEED
from tessera.sources import ingest as N
from tessera.sources.files import NA_TOKENS, TSV_WRITE


def _md5(key: str, *salt: str) -> str:
    """The order hash of a key that may be null: nulls are left out of the text."""
    return f"md5(concat_ws(':', {', '.join([repr(str(SEED)), *salt, f'CAST({key} AS VARCHAR)'])}))"


# --- K3, K4: one row has a null key -------------------------------------------------
NULL_KEY_SQL = "(SELECT nullif(doc_id, 7) AS k, lang, source FROM documents)"


def null_key(spark, sf):
    return table(spark, sf, "documents").select(F.expr("nullif(doc_id, 7)").alias("k"), "lang", "source")


@register("kfold_null_key", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_md5('k')}, k NULLS FIRST) AS rk FROM {NULL_KEY_SQL} x),
cls AS (SELECT lang, coalesce(sum(count(*)) OVER (ORDER BY lang NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM r GROUP BY lang),
e AS (SELECT r.*, CAST(f.fold AS INTEGER) AS fold, (rk - 1 + st) % 5 = f.fold AS is_test FROM r JOIN cls ON r.lang IS NOT DISTINCT FROM cls.lang, range(5) f(fold)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY fold, is_test ORDER BY {_md5('k', "'val'", 'CAST(fold AS VARCHAR)')}, k NULLS FIRST) AS rk2,
              count(*) OVER (PARTITION BY fold, is_test) AS m FROM e)
SELECT k, lang, source, fold, CASE WHEN is_test THEN 'test' WHEN rk2 <= ceil(CAST(0.25 AS DOUBLE) * m) THEN 'val' ELSE 'train' END AS part FROM r2""")
def q_kfold_null_key(spark, sf):
    return K.stratified_kfold(null_key(spark, sf), "k", "lang", 5, SEED)


@register("covering_null_key", f"""WITH r AS (SELECT k, source, row_number() OVER (ORDER BY {_md5('k')}, k NULLS FIRST) AS rk, count(*) OVER () AS n FROM {NULL_KEY_SQL} x),
b AS (SELECT *, CASE WHEN rk <= (n % 10) * (n // 10 + 1) THEN (rk - 1) // (n // 10 + 1) ELSE n % 10 + (rk - 1 - (n % 10) * (n // 10 + 1)) // (n // 10) END AS blk FROM r),
e AS (SELECT b.*, CAST(f.fold AS INTEGER) AS fold, blk = f.fold AS inb FROM b, range(10) f(fold)),
r2 AS (SELECT e.*, row_number() OVER (PARTITION BY fold, inb ORDER BY {_md5('k', "'cover'", 'CAST(fold AS VARCHAR)')}, k NULLS FIRST) AS rk2,
       floor(CAST(0.2 AS DOUBLE) * n) - CASE WHEN fold < n % 10 THEN n // 10 + 1 ELSE n // 10 END AS extra, floor(CAST(0.15 AS DOUBLE) * n) AS vs FROM e)
SELECT k, source, fold, CASE WHEN inb OR rk2 <= extra THEN 'test' WHEN rk2 <= extra + vs THEN 'val' ELSE 'train' END AS part FROM r2""")
def q_covering_null_key(spark, sf):
    return K.covering_splits(null_key(spark, sf).drop("lang"), "k", k=10, seed=SEED)


# --- U3: the first row of every text has no order ------------------------------------
NULL_ORDER_SQL = """(SELECT d.doc_id, d.source, d.text, nullif(d.doc_id, f.m) AS o FROM documents d
  JOIN (SELECT text, min(doc_id) AS m FROM documents GROUP BY text) f ON d.text IS NOT DISTINCT FROM f.text)"""


def null_order(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    # the first row of every text, by its hash: ids only
    first = d.groupBy(F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("m")).select("m")
    marked = join_small(d, first, F.col("doc_id") == F.col("m"), "left")
    return marked.select("doc_id", "source", "text", F.when(F.col("m").isNull(), F.col("doc_id")).alias("o"))


@register("dedupe_null_order", f"""SELECT doc_id, source, o FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY o NULLS LAST) AS rn FROM {NULL_ORDER_SQL} x) WHERE rn = 1""")
def q_dedupe_null_order(spark, sf):
    return U.dedupe_first(null_order(spark, sf), "text", "o").select("doc_id", "source", "o")


@register("dedupe_two_orders", f"""SELECT doc_id, source, o FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY source NULLS LAST, doc_id) AS rn FROM {NULL_ORDER_SQL} x) WHERE rn = 1""")
def q_dedupe_two_orders(spark, sf):
    return U.dedupe_first(null_order(spark, sf), "text", ["source", "doc_id"]).select("doc_id", "source", "o")


# --- A5, J5, D2: a null group ----------------------------------------------------------
GROUPED_SQL = f"(SELECT doc_id, quality, CASE WHEN doc_id % 3 > 0 THEN lang END AS g FROM {CORPUS_SQL} y WHERE quality IS NOT NULL OR doc_id % 10 = 0)"


def grouped(spark, sf):
    c = corpus(spark, sf).where("quality IS NOT NULL OR doc_id % 10 = 0")
    return c.select("doc_id", "quality", F.expr("CASE WHEN doc_id % 3 > 0 THEN lang END").alias("g"))


@register("class_weight_null_group", f"""WITH x AS (SELECT * FROM {GROUPED_SQL} z),
w AS (SELECT g, quality, sum(count(*)) OVER (PARTITION BY g) / (count(*) OVER (PARTITION BY g) * count(*)) AS weight FROM x WHERE quality IS NOT NULL GROUP BY g, quality)
SELECT x.doc_id, x.quality, x.g, w.weight FROM x LEFT JOIN w ON x.g IS NOT DISTINCT FROM w.g AND x.quality = w.quality""", rounded=("weight",))
def q_class_weight_null_group(spark, sf):
    return A.with_class_weight(grouped(spark, sf), "quality", by=["g"])


@register("pair_null_stratum", f"""WITH x AS (SELECT * FROM {GROUPED_SQL} z),
l AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY {_md5('doc_id', "'left'")}, doc_id) AS pair_rank FROM x),
r AS (SELECT conv_id || '-' || CAST(turn AS VARCHAR) AS turn_id, CASE WHEN turn % 2 = 0 THEN 'en' END AS g FROM (SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn FROM conversations)),
rr AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {_md5('turn_id', "'right'")}, turn_id) AS pair_rank FROM r)
SELECT l.doc_id, l.g, rr.turn_id, l.pair_rank FROM l JOIN rr ON l.g IS NOT DISTINCT FROM rr.g AND l.pair_rank = rr.pair_rank""")
def q_pair_null_stratum(spark, sf):
    turns = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), F.expr("CASE WHEN turn % 2 = 0 THEN 'en' END").alias("g"))
    return J.pair_by_rank(grouped(spark, sf).select("doc_id", "g"), turns, "doc_id", "turn_id", SEED, by=["g"]).select("doc_id", "g", "turn_id", "pair_rank")


@register("augment_null_fold", f"""WITH tr AS (SELECT g, doc_id, CAST(doc_id AS VARCHAR) AS "UniqueID", quality, 'text ' || CAST(doc_id AS VARCHAR) AS cleaned_comment FROM {GROUPED_SQL} z WHERE quality IS NOT NULL),
sents AS (SELECT tr.g, CAST(tr.doc_id AS VARCHAR) || chr(1) || b.text AS aid, b.text AS sent FROM tr JOIN benchmark b ON tr.doc_id = b.item_id),
sr AS (SELECT g, sent, row_number() OVER (PARTITION BY g ORDER BY {_md5('aid', "'sentence'")}, aid) AS rk FROM sents),
dr AS (SELECT tr.*, row_number() OVER (PARTITION BY g ORDER BY {_md5('doc_id', "'donor'")}, doc_id) AS rk FROM tr)
SELECT g, doc_id, "UniqueID", quality, cleaned_comment, CAST(NULL AS VARCHAR) AS augmented_from FROM tr
UNION ALL SELECT dr.g, dr.doc_id, 'AUGMENTED', 1, sr.sent, CAST(dr.doc_id AS VARCHAR) FROM dr JOIN sr ON dr.g IS NOT DISTINCT FROM sr.g AND dr.rk = sr.rk""")
def q_augment_null_fold(spark, sf):
    train = grouped(spark, sf).where("quality IS NOT NULL").select(
        "g", "doc_id", F.col("doc_id").cast("string").alias("UniqueID"), "quality", F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias("cleaned_comment"))
    train = cut_lineage(train)
    aug = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("ID"), F.col("text").alias("sent"))
    out = D.augment_training(train.withColumn("ID", F.col("UniqueID")), aug, "quality", 1, key="ID", seed=SEED, by=("g",))
    return out.drop("ID")


# --- E12: rows without a label ------------------------------------------------------------
@register("log_loss_null_label", MC_SQL + """,
x AS (SELECT fold, CASE WHEN vec_id % 4 > 0 THEN y END AS y, 1.0 + vec_id % 3 AS weight, logits FROM ev),
pr AS (SELECT fold, y, weight, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM (
        SELECT fold, y, weight, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM x))
SELECT fold, sum(-weight * ln(greatest(p[y + 1], 2.2250738585072014e-308))) / sum(weight) AS log_loss FROM pr WHERE y IS NOT NULL GROUP BY fold""",
          rounded=("log_loss",))
def q_log_loss_null_label(spark, sf):
    ev = multiclass_eval(spark, sf).select("fold", F.expr("CASE WHEN vec_id % 4 > 0 THEN y END").alias("y"), F.expr("1.0D + vec_id % 3").alias("weight"),
                                           T.softmax("logits").alias("probs"))
    return E.weighted_log_loss(ev, "probs", "y", "weight", by=["fold"])


# --- J2, J4: a key that three of ten rows share ---------------------------------------------
HOT_SQL = "(SELECT doc_id, CASE WHEN doc_id % 10 < 3 THEN (SELECT text FROM documents WHERE doc_id = 3) ELSE text END AS text FROM documents)"


def hot_texts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    hot = d.where("doc_id = 3").select(F.col("text").alias("hot"))
    held = hot.agg(F.max("hot").alias("hot"))  # one row
    return d.join(F.broadcast(held), F.lit(True)).select("doc_id", F.expr("CASE WHEN doc_id % 10 < 3 THEN hot ELSE text END").alias("text"))


@register("attach_scores_hot_text", f"""SELECT d.doc_id, s.source FROM {HOT_SQL} d LEFT JOIN (
  SELECT text, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1) s ON d.text = s.text""")
def q_attach_scores_hot_text(spark, sf):
    left = hot_texts(spark, sf)
    rows = left.count()
    out = J.attach_scores_by_text(left, table(spark, sf, "documents").select("doc_id", "text", "source"), "text", "doc_id", cols=["source"],
                                  on_missing="null", hot_rows=max(1, rows // 20))
    return out.select("doc_id", "source")


@register("match_augmented_hot_key", """SELECT l.l_orderkey, l.l_linenumber, n.n_name AS sent FROM lineitem l JOIN nation n
ON n.n_nationkey = CASE WHEN l.l_orderkey % 10 < 3 THEN 3 ELSE l.l_suppkey % 25 END""")
def q_match_augmented_hot_key(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("CAST(CASE WHEN l_orderkey % 10 < 3 THEN 3 ELSE l_suppkey % 25 END AS STRING)").alias("ID"))
    aug = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("ID"), F.col("n_name").alias("sent"))
    return J.match_augmented(li, aug, hot_rows=max(1, li.count() // 20)).select("l_orderkey", "l_linenumber", "sent")


# --- S1: ingested file order ------------------------------------------------------------------
TSV_SCHEMA = StructType([StructField("doc_id", LongType()), StructField("source", StringType()), StructField("text", StringType())])
INGESTED_SQL = "(SELECT doc_id, {0} AS source, {1} AS text FROM documents)".format(
    *[f"CASE WHEN {c} IN ({', '.join(repr(t) for t in NA_TOKENS)}) THEN NULL ELSE {c} END" for c in ("source", "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")])


def ingested(spark, sf):
    """Documents written as TSV files in the order of their ids, then ingested."""
    out = _io_dir(spark, "ingest")
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    d.orderBy("doc_id").write.options(**TSV_WRITE).csv(f"{out}/tsv")
    return N.ingest_corpus(spark, f"{out}/tsv/*.csv", TSV_SCHEMA, f"{out}/parquet")


@register("ingest_round_trip", f"SELECT doc_id, source, text, CAST(1 AS BIGINT) AS n FROM {INGESTED_SQL} x")
def q_ingest_round_trip(spark, sf):
    """The ingested rows, and how many share the row's place in its file."""
    rows = ingested(spark, sf)
    n = rows.groupBy(*N.FILE_ORDER).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(n, list(N.FILE_ORDER)).select("doc_id", "source", "text", "n")


@register("ingest_first_text", f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM {INGESTED_SQL} x) WHERE rn = 1")
def q_ingest_first_text(spark, sf):
    """U3 by the file order of the ingested table."""
    return U.dedupe_first(ingested(spark, sf), "text", list(N.FILE_ORDER)).select("doc_id", "source")


@register("ingest_first_scores", f"""SELECT d.doc_id, f.doc_id AS first_id FROM documents d LEFT JOIN (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM {INGESTED_SQL} x WHERE source IS NOT NULL) f
ON f.rn = 1 AND f.source = d.source""")
def q_ingest_first_scores(spark, sf):
    """J1 by the file order of the ingested table: the first document of each one's source."""
    rows = ingested(spark, sf).select("source", F.col("doc_id").alias("first_id"), *N.FILE_ORDER)
    return J.attach_scores(table(spark, sf, "documents").select("doc_id", "source"), rows, "source", list(N.FILE_ORDER), ["first_id"], on_missing="null") \
        .select("doc_id", "first_id")
