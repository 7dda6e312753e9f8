"""Rules for nulls, ties, hot keys and vocabularies of any size."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import encode as C
from tessera.operators import joins as J
from tessera.operators import metrics as E
from tessera.operators import profile as A
from tessera.operators import sets as U
from tessera.operators import splits as K
from tessera.operators.augment import augment_training


def test_a_null_key_stays_in_all_folds(spark):
    df = spark.createDataFrame([(None if k == 4 else k, k % 2, f"t{k}") for k in range(20)], "id long, y int, t string")
    assert K.stratified_kfold(df, "id", "y", 5, 1).count() == 100
    assert K.covering_splits(df, "id", 10, seed=1).count() == 200
    assert K.stratified_kfold(df, "id", "y", 5, 1).where("id IS NULL AND t = 't4' AND part = 'test'").count() == 1


def test_first_rows_with_null_orders(spark):
    df = spark.createDataFrame([("b", None, 1), ("a", 3, 2), ("a", None, 3), (None, 5, 4), (None, 4, 5)], "t string, o int, v int")
    for keep in (None, ["v"]):
        out = U.dedupe_first(df, "t", "o", keep=keep)
        assert sorted((r["t"] or "", r["o"], r["v"]) for r in out.collect()) == [("", 4, 5), ("a", 3, 2), ("b", None, 1)]


@pytest.mark.parametrize("rows", [[("a", 1), ("a", 1)], [("a", None), ("a", None)]])
def test_tied_first_rows_are_an_error(spark, rows):
    df = spark.createDataFrame(rows, "t string, o int")
    with pytest.raises(Exception, match="order value occurs twice"):
        U.dedupe_first(df, "t", "o").collect()
    # two groups may share an order value
    assert U.dedupe_first(spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "t string, o int"), "t", "o").count() == 2


def test_null_groups(spark):
    df = spark.createDataFrame([(1, None, 0), (2, None, 1), (3, "x", 0), (4, "x", None)], "id long, g string, y int")
    w = {r["id"]: r["weight"] for r in A.with_class_weight(df, "y", by=["g"]).collect()}
    assert w == {1: 1.0, 2: 1.0, 3: 1.0, 4: None}
    right = spark.createDataFrame([(7, None), (8, None), (9, "x"), (10, "x")], "o long, g string")
    assert J.pair_by_rank(df, right, "id", "o", 1, by=["g"]).count() == 4


def test_sentences_of_a_null_fold_are_appended(spark):
    train = spark.createDataFrame([(f, k, str(k), 0, "t", "u") for f in (None, 1) for k in range(3)], "fold int, doc_id long, ID string, y int, cleaned_comment string, UniqueID string")
    aug = spark.createDataFrame([("0", "s0"), ("1", "s1")], "ID string, sent string")
    out = augment_training(train, aug, "y", 1, key="ID")
    assert out.count() == 10
    assert sorted(r["cleaned_comment"] for r in out.where("fold IS NULL AND UniqueID = 'AUGMENTED'").collect()) == ["s0", "s1"]


def test_a_null_vector_is_an_error(spark):
    df = spark.createDataFrame([(1, [0.1, 0.9]), (2, None)], "id long, p array<double>")
    with pytest.raises(Exception, match="prediction vectors must have 2 entries"):
        C.explode_probs(df, "p", 2).collect()


def test_rows_without_label_or_weight_leave_the_loss(spark):
    rows = [("a", 0, [0.5, 0.5], 1.0), ("a", None, [0.5, 0.5], 1.0), ("a", 0, [0.5, 0.5], None), ("a", 0, None, 1.0), ("a", 1, [0.5, None], 1.0), ("b", None, [1.0, 0.0], 1.0)]
    df = spark.createDataFrame(rows, "g string, y int, p array<double>, weight double")
    out = {r["g"]: r["log_loss"] for r in E.weighted_log_loss(df, "p", by=["g"]).collect()}
    assert abs(out["a"] - 0.6931471805599453) < 1e-12 and out["b"] is None


def encoded(spark, df, vocab, **kw):
    return sorted(tuple(r) for r in C.encode_sequences(df, "t", "k", vocab, 8, **kw).select(F.coalesce("k", F.lit(-1)), F.coalesce("t", F.lit("-")), "input_ids").collect())


def test_lookup_equals_the_join(spark):
    texts = ["a b c", "", None, "zzz a", "A  b", "a b c d e f g h i j", "ü 漢 \"quoted\" back\\slash", "a b c"]
    df = spark.createDataFrame([(None if k == 3 else k // 2, t) for k, t in enumerate(texts)], "k int, t string")
    vocab = C.build_vocabulary(df, "t", 9)
    got = encoded(spark, df, vocab)
    assert got == encoded(spark, df, vocab, max_bytes=0) and len(got) == len(texts)
    empty = vocab.limit(0)
    assert encoded(spark, df, empty) == encoded(spark, df, empty, max_bytes=0)


def test_no_exchange_after_the_vocabulary(spark):
    df = spark.range(50).select(F.col("id").alias("k"), F.concat_ws(" ", F.lit("w"), F.col("id").cast("string")).alias("t"))
    plan = C.encode_sequences(df, "t", "k", C.build_vocabulary(df, "t", 30), 16)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Generate" not in text
    assert plan.where(F.element_at("input_ids", 2) == C.FIRST_WORD_ID).count() == 50
    assert plan.select(T.attention_mask("input_ids").alias("m")).where("size(m) = 16").count() == 50


def test_rows_of_a_hot_key_are_dealt_to_many_tasks(spark):
    left = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 10 < 3, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id") % 700)).alias("t")).repartition(6)
    right = spark.createDataFrame([("hot", 1, 0.5), ("hot", 2, 0.7)] + [(f"t{k}", 3, float(k)) for k in range(650)], "t string, o int, cogency double")
    l, r = J.spread_hot(left, right, "t", "t", hot_rows=100)
    most = l.groupBy("_j_kh", "_j_salt").count().agg(F.max("count")).first()[0]
    assert most <= 150 and l.where("t = 'hot'").select("_j_salt").distinct().count() == 12
    assert r.where("t = 'hot'").count() == 24 and r.where("t <> 'hot'").count() == 650
    for hot_rows in (100, 10**9):
        out = J.attach_scores_by_text(left, right, "t", "o", cols=["cogency"], on_missing="null", hot_rows=hot_rows)
        assert out.count() == 4000 and out.columns == ["id", "t", "cogency"]
        assert out.where("t = 'hot'").select("cogency").distinct().collect() == [(0.5,)]
        assert out.where("cogency IS NULL").count() == left.where("t >= 't650' AND length(t) = 4").count()
        sentences = right.select(F.col("t").alias("ID"), F.col("o").alias("sent"))
        assert J.match_augmented(left, sentences, key="t", hot_rows=hot_rows).count() == 1200 * 2 + out.where("cogency IS NOT NULL AND t <> 'hot'").count()
    with pytest.raises(Exception, match="no match for key"):
        J.attach_scores_by_text(left, right, "t", "o", cols=["cogency"], hot_rows=100).collect()
