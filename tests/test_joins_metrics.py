import pytest
from pyspark.sql import functions as F

from tessera.operators import augment as D
from tessera.operators import joins as J
from tessera.operators import metrics as E


def test_attach_scores_first_match_g9(spark):
    right = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0)], "k string, o int, v double")
    left = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    got = sorted((r.k, r.v) for r in J.attach_scores(left, right, "k", "o", ["v"], on_missing="null").collect())
    assert got == [("a", 10.0), ("a", 10.0), ("b", None)]
    with pytest.raises(Exception):
        J.attach_scores(left, right, "k", "o", ["v"], on_missing="error").collect()


def test_attach_predictions_last_file_wins_g9(spark):
    preds = spark.createDataFrame([("a", "f1", 0, [0.9, 0.1]), ("a", "f2", 0, [0.2, 0.8])],
                                  "ID string, file string, pos long, predictions array<double>")
    left = spark.createDataFrame([("a",)], "ID string")
    assert J.attach_predictions(left, preds, "ID").first().predictions == [0.2, 0.8]


def test_text_join_uses_hash_and_text(spark):
    right = spark.createDataFrame([("t1", 1, 0.5), ("t1", 0, 0.7)], "text string, o int, cogency double")
    left = spark.createDataFrame([("t1",), ("t2",)], "text string")
    r = J.attach_scores_by_text(left, right, "text", "o", ["cogency"], on_missing="null")
    assert sorted((x.text, x.cogency) for x in r.collect()) == [("t1", 0.7), ("t2", None)]


def test_augmentation_candidates_g10(spark):
    rows = [("x", 1, "one two three four", 1), ("x", 1, "one two three four five", 2),
            ("x", 1, "six seven eight nine ten", 3), ("y", 1, "one two three four five", 4),
            ("z", 0, "a b c d e", 5)]
    df = spark.createDataFrame(rows, "ID string, label int, cleaned_comment string, o int")
    got = [tuple(r) for r in D.augmentation_candidates(df, "label", 1, order="o").select("sent", "ID").collect()]
    assert got == [("one two three four five", "y")]


def test_augment_training_sizes(spark):
    train = spark.createDataFrame([(0, i, str(i % 3), 1, f"text {i}") for i in range(10)],
                                  "fold int, doc_id long, ID string, label int, cleaned_comment string")
    train = train.withColumn("UniqueID", F.col("ID"))
    aug = spark.createDataFrame([("0", "new a"), ("1", "new c")], "ID string, sent string")
    out = D.augment_training(train, aug, "label", 3, seed=1)
    # J4 multiplies: ID 0 has 4 training rows x 1 sentence, ID 1 has 3 x 1
    assert out.count() == 10 + 4 + 3
    new = out.where("UniqueID = 'AUGMENTED'")
    assert new.where("label <> 3").count() == 0 and new.select("augmented_from").distinct().count() == 7
    too_many = spark.createDataFrame([("0", f"s{i}") for i in range(3)], "ID string, sent string")
    with pytest.raises(Exception):
        D.augment_training(train, too_many, "label", 3, seed=1).collect()  # 12 sentences, 10 donors


def test_best_threshold_g4(spark):
    df = spark.createDataFrame([(1, 0.85), (1, 0.45), (0, 0.25), (0, 0.05)], "y int, p double")
    r = E.best_threshold(df).first()
    assert r.threshold == 25 * 0.01 and r.f1 == 1.0
    none = spark.createDataFrame([(0, 0.95), (0, 0.5)], "y int, p double")
    r = E.best_threshold(none).first()
    assert (r.threshold, r.f1) == (0.0, 0.0)


def test_best_threshold_matches_brute_force(spark):
    df = spark.range(2000).select(((F.col("id") * 7919) % 3 == 0).cast("int").alias("y"),
                                  (((F.col("id") * 104729) % 1000) / 1000.0).alias("p"))
    rows = [(r.y, r.p) for r in df.collect()]
    best_t, best_f = 0, 0
    for i in range(10, 90):
        t = i * 0.01
        tp = sum(1 for y, p in rows if y == 1 and p > t)
        fp = sum(1 for y, p in rows if y != 1 and p > t)
        fn = sum(1 for y, p in rows if y == 1 and not p > t)
        f = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        if f > best_f:
            best_t, best_f = t, f
    r = E.best_threshold(df).first()
    assert r.threshold == best_t and abs(r.f1 - best_f) < 1e-12


def test_classification_report_g5(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 1], [0, 1, 1, 1, 2])), "y int, y_hat int")
    rep = {r.label: r for r in E.classification_report(df).collect()}
    assert (rep["0"].precision, rep["0"].recall, round(rep["0"].f1_score, 6), rep["0"].support) == (1.0, 0.5, 0.666667, 2)
    assert round(rep["1"].precision, 6) == 0.666667 and rep["1"].support == 3
    assert (rep["2"].precision, rep["2"].recall, rep["2"].f1_score, rep["2"].support) == (0.0, 0.0, 0.0, 0)
    m, w = rep["macro avg"], rep["weighted avg"]
    assert [round(x, 6) for x in (m.precision, m.recall, m.f1_score)] == [0.555556, 0.388889, 0.444444]
    assert [round(x, 6) for x in (w.precision, w.recall, w.f1_score)] == [0.8, 0.6, 0.666667]
    assert E.accuracy(df).first().accuracy == 0.6
    assert round(E.balanced_accuracy(df).first().balanced_accuracy, 6) == 0.583333


def test_regression_g6(spark):
    df = spark.createDataFrame(list(zip([1.0, 2.0, 3.0, 4.0], [1.5, 1.0, 3.5, 3.0])), "y double, p double")
    assert E.mse(df).first().mse == 0.625
    assert abs(E.r2(df).first().r2 - 0.5) < 1e-12
    assert round(E.pearson(df).first().pearson, 6) == 0.759257
    r = E.regression_report(df).first()
    assert abs(r.r2 - 0.5) < 1e-12 and r.mse == 0.625


def test_classification_report_label_order(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 1], [0, 1, 1, 1, 2])), "y int, y_hat int")
    rep = {r.label: r for r in E.classification_report(df, labels=[1, 0, 5]).collect()}
    assert set(rep) == {"1", "0", "5", "macro avg", "weighted avg"}
    assert rep["5"].support == 0 and rep["5"].f1_score == 0.0
    # macro over the listed classes only: F1 of 1, 0 and 5
    assert round(rep["macro avg"].f1_score, 6) == round((2 / 3 + 2 / 3 + 0) / 3, 6)


def test_join_small_checks_size(spark):
    from tessera.operators.small import join_small
    big = spark.range(1000).withColumn("g", F.col("id") % 7)
    small = spark.range(7).withColumnRenamed("id", "g").withColumn("w", F.col("g") * 2)
    under = join_small(big, small, on="g", how="left")
    over = join_small(big, small, on="g", how="left", max_rows=3)
    def hinted(df):
        return "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(under)
    # beyond the bound: no hint; the planner decides from the materialised table's real size
    assert not hinted(over)
    assert sorted(tuple(r) for r in under.collect()) == sorted(tuple(r) for r in over.collect())
