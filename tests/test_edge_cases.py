"""Nulls, ties, NaN, duplicates and odd files: what the clean driver tables never show."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tessera.operators import augment as D
from tessera.operators import baselines as M
from tessera.operators import encode as C
from tessera.operators import joins as J
from tessera.operators import metrics as E
from tessera.operators import select as O
from tessera.operators import sets as U
from tessera.operators import splits as K
from tessera.operators.rank import hash_rank
from tessera.sources import files as IO


def test_blocks_larger_than_the_test_part_are_an_error(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    with pytest.raises(Exception, match="larger than the test part"):
        K.covering_fold_table(df, "k", k=4, seed=1).collect()


def test_sequential_batches_keep_rows_with_null_order(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None)], "k long, o long")
    out = K.batches(df, 2, "k", order=["o"]).orderBy("k").collect()
    assert [r["batch_id"] for r in out] == [0, 1, 0]


def test_a_cut_between_rows_of_one_key_is_an_error(spark):
    df = spark.createDataFrame([(min(k, 50),) for k in range(1, 100)], "k long")
    with pytest.raises(Exception, match="duplicate key"):
        for share in (0.05, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95):
            K.holdout(df, "k", 3, test=share).collect()


def test_ranks_of_null_strata_and_a_null_key(spark):
    df = spark.createDataFrame([(k, None if k % 3 else "a", f"t{k}") for k in range(30)] + [(None, "a", "n")], "k long, s string, t string")
    out = hash_rank(df, "k", 7, by=["s"], size_col="n", digits=2).collect()
    assert len(out) == 31 and sorted(r["rank"] for r in out if r["s"] is None) == list(range(1, 21))
    assert {r["n"] for r in out if r["s"] == "a"} == {11}


def test_first_match_takes_one_whole_row(spark):
    left = spark.createDataFrame([("x",)], "id string")
    right = spark.createDataFrame([("x", 1, 9, 1), ("x", 1, 2, 8)], "id string, o int, a int, b int")
    assert [tuple(r) for r in J.attach_scores(left, right, "id", "o", ["a", "b"]).collect()] == [("x", 2, 8)]


def test_dedupe_rejects_a_shared_order_value(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "t string, o int")
    with pytest.raises(Exception, match="occurs twice"):
        U.dedupe_first(df, "t", "o").collect()
    assert U.dedupe_first(df, "t", "o", keep=[]).count() == 2


def test_nan_and_null_metrics_never_win(spark):
    df = spark.createDataFrame([("g", 1, 0.5), ("g", 2, math.nan), ("g", 3, 0.7), ("g", 4, None), ("h", 1, math.nan)], "g string, step int, m double")
    assert [(r["g"], r["step"]) for r in O.best_run(df, "m", "step", by=["g"]).collect()] == [("g", 3)]
    assert [(r["g"], r["step"]) for r in O.best_run(df, "m", "step", by=["g"], higher_is_better=False).collect()] == [("g", 1)]


def test_nan_scores_are_above_no_threshold(spark):
    df = spark.createDataFrame([(None, 1, 0.9), (None, 0, math.nan), (None, 0, None), ("g", 1, 0.3), ("g", 0, 0.2)], "g string, y int, p double")
    fitted = E.best_threshold(df, by=["g"])
    assert {r["g"]: r["f1"] for r in fitted.collect()} == {None: 1.0, "g": 1.0}
    out = E.apply_threshold(df, fitted, by=["g"])
    assert out.where("y = y_hat").count() == 5


def test_regression_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 1.0, 1.5), (None, 2.0, 2.0), ("g", 1.0, 1.0), ("g", 3.0, 2.0)], "g string, y double, p double")
    out = {r["g"]: (r["mse"], r["r2"]) for r in E.regression_report(df, by=["g"]).collect()}
    assert out == {None: (0.125, 0.5), "g": (0.5, 0.5)}
    assert {r["g"]: r["r2"] for r in E.r2(df, by=["g"]).collect()} == {None: 0.5, "g": 0.5}


def test_certain_and_wrong_costs_something(spark):
    df = spark.createDataFrame([([1.0, 0.0], 0, 1.0), ([1.0, 0.0], 1, 1.0)], "probs array<double>, y int, weight double")
    assert E.weighted_log_loss(df, "probs").first()["log_loss"] == pytest.approx(354.198, abs=0.001)


def test_a_null_prediction_is_wrong_everywhere(spark):
    df = spark.createDataFrame([(1, 1), (1, None)], "y int, y_hat int")
    assert E.accuracy(df).first()["accuracy"] == 0.5 == E.summary(df).first()["accuracy"]


def test_baselines_with_string_labels_and_a_null_fold(spark):
    train = spark.createDataFrame([(1, None, "b"), (2, None, "a"), (3, "f", "c"), (4, "f", "c"), (5, "f", "a")], "k long, fold string, y string")
    test = spark.createDataFrame([(9, None), (10, "f")], "k long, fold string")
    assert {r["k"]: r["y_hat"] for r in M.majority_baseline(train, test, "y", by=["fold"]).collect()} == {9: "a", 10: "c"}
    uni = {r["k"]: r["y_hat"] for r in M.uniform_baseline(train, test, "y", "k", 1, by=["fold"]).collect()}
    assert uni[9] in "ab" and uni[10] in "ac"


def test_composed_text_keeps_rows_without_scores(spark):
    docs = spark.createDataFrame([(1, "t"), (2, "u")], "id long, text string")
    scores = spark.createDataFrame([(1, 0, "lo", "lo", "hi", "hi")], "id long, o int, a string, b string, c string, d string")
    out = C.compose_with_lookup(docs, scores, "id", "o", list("abcd"), "text", on_missing="null").collect()
    assert len(out) == 2 and any("cogency is nan" in r["AQ"] for r in out)
    with pytest.raises(Exception, match="no match for key"):
        C.compose_with_lookup(docs, scores, "id", "o", list("abcd"), "text").collect()


def test_sequences_of_repeated_keys(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "z"), (None, "x"), (2, None)], "id long, t string")
    vocab = spark.createDataFrame([("x", 4), ("y", 5), ("z", 6)], "word string, id int")
    out = C.encode_sequences(docs, "t", "id", vocab, 5)
    assert sorted(tuple(r["input_ids"]) for r in out.collect()) == [(2, 3, 0, 0, 0), (2, 4, 3, 0, 0), (2, 4, 5, 3, 0), (2, 6, 3, 0, 0)]


def test_repeated_augmented_sentences_are_all_appended(spark):
    train = spark.createDataFrame([(k, f"id{k}", f"u{k}", 0, "t") for k in range(6)], "doc_id long, ID string, UniqueID string, y int, cleaned_comment string")
    aug = spark.createDataFrame([("id1", "same"), ("id1", "same"), ("id2", "other")], "ID string, sent string")
    out = D.augment_training(train, aug, "y", 0, by=())
    assert sorted(r["cleaned_comment"] for r in out.where("UniqueID = 'AUGMENTED'").collect()) == ["other", "same", "same"]


def test_whole_numbers_written_with_a_fraction(spark, scratch):
    with open(f"{scratch}/a.tsv", "w") as f:
        f.write("k\tn\n1\t3.0\n2\tnan\n3\t9007199254740993\n")
    schema = StructType([StructField("k", IntegerType()), StructField("n", LongType())])
    out = IO.read_corpus(spark, f"{scratch}/a.tsv", schema, with_order=True)
    assert [r["n"] for r in out.orderBy("file_path", "position").collect()] == [3, None, 9007199254740993]
    with open(f"{scratch}/b.tsv", "w") as f:
        f.write("k\tn\n1\t3.5\n")
    with pytest.raises(Exception, match="not a whole number"):
        IO.read_corpus(spark, f"{scratch}/b.tsv", schema).collect()


def test_predictions_with_text_come_back_and_the_last_file_wins(spark, scratch):
    schema = StructType([StructField("k", LongType()), StructField("text", StringType()), StructField("probability", StringType())])
    text = 'tab\there "quoted" back\\slash\nline'
    one = spark.createDataFrame([(1, text, [0.1, 0.9]), (2, "many " * 2000, [0.5, 0.5])], "k long, text string, probability array<double>")
    two = spark.createDataFrame([(1, text, [0.8, 0.2])], "k long, text string, probability array<double>")
    IO.write_predictions(one.coalesce(1), f"{scratch}/split0", fmt="tsv")
    IO.write_predictions(two.coalesce(1), f"{scratch}/split1", fmt="tsv")
    back = IO.read_predictions(spark, f"{scratch}/split*", schema, vec="probability")
    assert {r["text"] for r in back.where("k = 1").collect()} == {text}
    keys = spark.createDataFrame([(1,)], "k long")
    assert J.attach_predictions(keys, back, "k", "probability").first()["probability"] == [0.8, 0.2]


def test_evaluate_agrees_with_the_single_metrics(spark):
    df = spark.createDataFrame([(k % 2, ((k * 7) % 10) / 10) for k in range(40)], "y int, p double")
    hard = df.withColumn("y_hat", (F.col("p") > 0.4).cast("int"))
    one = E.evaluate(df, p="p", threshold=0.4).first().asDict()
    many = {**E.accuracy(hard).first().asDict(), **E.balanced_accuracy(hard).first().asDict(), **E.macro_prf(hard).first().asDict(),
            **E.binary_prf(hard).first().asDict()}
    assert one == pytest.approx(many)


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_rank_gathers_all_rows_in_one_task(spark):
    df = spark.range(5000).withColumnRenamed("id", "k").withColumn("t", F.col("k").cast("string"))
    plan = _scans(hash_rank(df, "k", 1, by=["t"], digits=2))
    assert "SinglePartition" not in plan
