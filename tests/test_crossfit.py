"""Fold statistics by subtraction, out-of-fold models and grids."""

import math

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tessera.operators import crossfit as X
from tessera.operators import models as M
from tessera.operators.profile import class_weights
from tessera.plans import fold_queries as Q


@pytest.fixture(scope="module")
def said(spark):
    """Texts whose words follow the label, with an empty and a null text."""
    rows = []
    for k in range(120):
        y = k % 3 == 0
        words = [f"{'good' if y else 'bad'}{k % 4}", f"w{k % 7}", "Shared", f"w{k % 7}", f"rare{k}"]
        rows.append((k, int(y), None if k == 5 else "" if k == 6 else "  ".join(words)))
    return X.cut_lineage(X.with_fold(spark.createDataFrame(rows, "id long, y int, text string"), "id", "y", 4, 1))


def test_idf_equals_a_fit_on_each_training_set(said):
    features = X.fold_features(said, "id", "y", "text", 4, num_features=256)
    tf = HashingTF(inputCol="t", outputCol="tf", numFeatures=256).transform(said.withColumn("t", X.terms_of("text")))
    for f in range(4):
        fitted = IDF(inputCol="tf", outputCol="x").fit(tf.where(F.col("fold") != f)).idf.toArray()
        assert abs(fitted - features.idf[f]).max() < 1e-12


def test_weights_equal_a_fit_on_each_training_set(said):
    features = X.fold_features(said, "id", "y", "text", 4, num_features=64)
    for f in range(4):
        want = {r["y"]: r["weight"] for r in class_weights(said.where(F.col("fold") != f), "y").collect()}
        got = {r["y"]: r["weight"] for r in features.train(f).select("y", "weight").distinct().collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[y], want[y]) for y in want)


def test_fold_statistics_of_awkward_rows(spark):
    df = spark.createDataFrame([(0, ["a", "a", "b"]), (0, []), (1, ["a", None]), (1, None), (2, ["c"])], "fold int, terms array<string>")
    counts = {r["term"]: (r["d0"], r["d1"], r["d2"]) for r in X.fold_frequencies(df, "fold", "terms", 3).collect()}
    assert counts == {"a": (1, 1, 0), "b": (1, 0, 0), "c": (0, 0, 1), None: (0, 1, 0)}
    out = {(r["fold"], r["term"]): (r["docs"], r["n_docs"]) for r in X.held_out_idf(X.fold_frequencies(df, "fold", "terms", 3), [2, 2, 1]).collect()}
    assert out[(0, "a")] == (1, 3) and out[(2, "c")] == (0, 4) and len(out) == 12
    assert X.fold_frequencies(df.limit(0), "fold", "terms", 3).count() == 0


def test_a_training_set_may_lack_a_label(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 0)], "id long, y int, fold int")
    got = {r["id"]: r["weights"] for r in X.held_out_weights(df, "fold", "y", 2).collect()}
    # fold 0 trains on row 2 alone: label 1 does not occur there
    assert got == {1: [1.0, 1.0], 2: [1.0, 1.0], 3: [None, 1.0]}


def test_out_of_fold_rows_are_predicted_by_the_other_folds(said):
    out = X.text_out_of_fold(said.drop("fold"), "id", "y", "text", k=4, seed=1, num_features=1 << 12).collect()
    assert sorted(r["id"] for r in out) == list(range(120))
    assert {r["id"]: r["fold"] for r in out} == {r["id"]: r["fold"] for r in said.collect()}
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in out)
    assert sum(r["y"] == r["y_hat"] for r in out) >= 115


def test_null_label_is_an_error(spark):
    df = spark.createDataFrame([(1, 0, "a"), (2, None, "b")], "id long, y int, text string")
    with pytest.raises(Exception, match="no label for key 2"):
        X.text_out_of_fold(df, "id", "y", "text", k=2)


def test_text_is_tokenised_once(spark, said, monkeypatch):
    calls = []
    real = X.terms_of
    monkeypatch.setattr(X, "terms_of", lambda *a: calls.append(a) or real(*a))
    X.text_out_of_fold(said.drop("fold"), "id", "y", "text", k=4, seed=1, num_features=256)
    assert len(calls) == 1


GRID = {"rate": (0.5, 0.01, 0.01001), "words": (1, 4)}


def swept(folded):
    held = {}

    def features_of(s):
        if s["words"] not in held:
            held[s["words"]] = X.fold_features(folded, "id", "y", "text", 4, 512, s["words"])
        return held[s["words"]]

    head = lambda s, label: LogisticRegression(labelCol=label, weightCol="weight", regParam=s["rate"], maxIter=20)
    return X.sweep_folds(features_of, GRID, head, "r{rate}-w{words}", 4)


def test_sweep_judges_every_run_on_every_fold(said):
    metrics = X.cut_lineage(swept(said))
    assert metrics.count() == 24 and metrics.select("step", "fold").distinct().count() == 24
    best = X.best_of_sweep(metrics).first()
    summary = {r["step"]: r["pos_f1"] for r in X.run_summary(metrics).collect()}
    assert best["step"] == min(s for s, v in summary.items() if v == max(summary.values())) and best["n_folds"] == 4
    # the other partitioning of the same folds has the same best run
    again = X.best_of_sweep(swept(said.repartition(7))).first()
    assert (again["step"], again["group"]) == (best["step"], best["group"])


def test_grid_names(spark, said):
    plan = X.grid_plan(said, GRID, "r{rate}-w{words}", 4).collect()
    assert len(plan) == 24 and [r["step"] for r in plan[::4]] == list(range(6))
    assert (plan[4]["group"], plan[4]["run"], plan[4]["n_train"] + plan[4]["n_test"]) == ("r0.5-w4", "r0.5-w4-fold0", 120)
    with pytest.raises(ValueError):
        X.grid_plan(said, GRID, "r{rate}", 4)
    assert [len(X.settings_of(g)) for g in (Q.MODERATION_GRID, Q.QUALITY_GRID)] == [15, 20]
    assert X.run_key(X.settings_of(Q.QUALITY_GRID)[1], Q.QUALITY_RUN) == "quality-seqlen512-batchsize16-modellinear-qualityquality-lr7e-06"


def test_forests_over_folds(spark):
    rows = [(k, f, "test" if k % 4 == f else "train", k % 2, float(k % 2), float(k)) for k in range(60) for f in range(2)]
    views = spark.createDataFrame(rows, "id long, fold int, part string, y int, a double, b double")
    out = X.forests_over_folds(views, "y", "id", ["a", "b"], k=2, num_trees=5).collect()
    assert sorted((r["id"], r["fold"]) for r in out) == sorted((r[0], r[1]) for r in rows if r[2] == "test")
    assert all(r["y"] == r["y_hat"] for r in out)


def test_a_gradient_is_summed_over_few_partitions(said):
    features = X.fold_features(said.repartition(20), "id", "y", "text", 4, num_features=64)
    assert features.rows.rdd.getNumPartitions() > 4 and features.train(0).rdd.getNumPartitions() <= 4
    assert features.train(0).count() == said.where("fold <> 0").count()


def test_rows_are_laid_out_once_for_heads_that_sample(said):
    features = X.fold_features(said, "id", "y", "text", 4, num_features=64)
    laid = features.laid_out("id")
    where = lambda df: [[r["id"] for r in part] for part in df.select("id").rdd.glom().collect()]
    assert where(laid.train(1)) == where(X.stable_input(features.rows.where("fold <> 1"), "id"))
    assert "Exchange" not in laid.train(1)._jdf.queryExecution().executedPlan().toString()


def test_a_swept_model_is_judged_and_let_go(said, monkeypatch):
    import weakref
    alive, real, most = weakref.WeakSet(), X.fit_fold, []

    def fit(*a):
        model = real(*a)
        alive.add(model)
        most.append(len(alive))
        return model

    monkeypatch.setattr(X, "fit_fold", fit)
    features = X.fold_features(said, "id", "y", "text", 4, 64)
    head = lambda s, label: LogisticRegression(labelCol=label, weightCol="weight", regParam=s["rate"], maxIter=2)
    metrics = X.sweep_folds(lambda s: features, {"rate": (0.1, 0.2, 0.3)}, head, "r{rate}", 4, parallelism=1)
    assert len(most) == 12 and max(most) <= 3 and metrics.count() == 12


def test_sweep_tokenises_once_and_equals_a_split_of_the_grid(said, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import RegexTokenizer
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

    from tessera.operators import models as MD
    rows = said.where("text is not null").select("id", "y", "text")
    stages = MD._text_features("text", 16)
    lr = LogisticRegression(labelCol="y", featuresCol="features", maxIter=100)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 1.0]).addGrid(stages[1].numFeatures, [8, 64]).build()
    split = TrainValidationSplit(estimator=Pipeline(stages=[*stages, lr]), estimatorParamMaps=grid,
                                 evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="f1"), trainRatio=0.75, seed=42)
    want = split.fit(MD.stable_input(rows, "id"))
    calls, real = [], RegexTokenizer.transform
    monkeypatch.setattr(RegexTokenizer, "transform", lambda *a: calls.append(1) or real(*a))
    model, table = MD.sweep(rows, "y", "text", (0.01, 1.0), (8, 64), key="id")
    assert len(calls) == 1 and model.validationMetrics == pytest.approx(want.validationMetrics, abs=1e-6) and table.count() == 4
    count = lambda m: sorted((r["id"], r["prediction"]) for r in m.transform(rows).select("id", "prediction").collect())
    assert count(model.bestModel) == count(want.bestModel)


def test_a_pass_sends_a_small_share_of_what_it_reads(spark):
    # sums of 2 MB over 7.2 GB of vectors: one for each GB, and not for each quarter of one
    width, size = 1 << 18, 7_200_000_000
    sums = M.partial_sums(size, width)
    assert M.FIT_TASKS < sums and 8 * width * (sums - 1) * M.FIT_SHARE <= size
    # narrow sums are no reason for large partitions
    assert M.partial_sums(size, 1 << 10) == -(-size // M.FIT_BYTES)
    rows = spark.createDataFrame([(Vectors.sparse(width, [3, 9], [1.0, 2.0]),)], ["tf"])
    assert M.fit_partitions(rows, "tf") == M.fit_partitions(rows.limit(0), "tf") == M.FIT_TASKS
