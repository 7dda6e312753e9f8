import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.operators import models as MD
from tessera.operators.splits import assign_folds
from tessera.sources.tables import table

SF = "/root/testdata/sf0.01"


def test_mlp_layer_rule_g11():
    assert MD.mlp_hidden_layers(772, 5) == [193, 48, 12]
    assert MD.mlp_hidden_layers(68, 10) == [17]


def _scores(spark):
    e = table(spark, SF, "embeddings")
    s = e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c)
                                      for i, c in enumerate(MD.SCORE_FEATURES)])
    return assign_folds(s, "vec_id", "label", 5, 42, fold_col="fold")


def test_forest_properties(spark):
    s = _scores(spark)
    model, pred = MD.score_forest(s.where("fold <> 0"), s.where("fold = 0"), "label", num_trees=10, seed=0,
                                  keep=["vec_id"], key="vec_id")
    rows = pred.collect()
    assert len(rows) == s.where("fold = 0").count()
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in rows)
    # same seed, differently partitioned input: the stable layout makes the fit repeat
    again = MD.score_forest(s.where("fold <> 0").repartition(7), s.where("fold = 0"), "label", num_trees=10, seed=0,
                            keep=["vec_id"], key="vec_id")[1]
    assert sorted((r.vec_id, r.y_hat) for r in again.collect()) == sorted((r.vec_id, r.y_hat) for r in rows)
    imp = MD.feature_importance(model, spark=spark).collect()
    assert abs(sum(r.importance for r in imp) - 1) < 1e-9
    assert [r.importance for r in imp] == sorted(r.importance for r in imp)


def test_out_of_fold_one_prediction_per_key(spark):
    from tessera.functions.text import clean_text
    from tessera.plans.corpus import corpus
    d = corpus(spark, SF).where("quality IS NOT NULL").select("doc_id", "quality", clean_text("text").alias("cleaned_comment"))
    oof = MD.out_of_fold(d, "doc_id", "quality", lambda tr: MD.text_classifier(tr, "quality", max_iter=10), k=3)
    assert oof.count() == d.count() and oof.select("doc_id").distinct().count() == d.count()


def test_grid(spark):
    g = MD.grid(spark, {"learning_rate": [1e-5, 5e-5], "comment_parents_num": [0, 1, 2]})
    assert g.count() == 6 and g.select("run").distinct().count() == 6


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) > 0
    assert set(E.entry(spark).columns) == {"fold", "part", "quality", "n", "weight"}


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    from tessera.plans.catalog import QUERIES
    rows_only = set(QUERIES) - set(s)
    assert rows_only <= {"score_forest", "feature_importance", "stacked_forest", "fused_mlp", "text_classifier",
                         "text_regressor", "out_of_fold", "sweep", "kfold_text_report", "sweep_moderation", "sweep_quality",
                         "baseline_workflow", "stacked_workflow"}


@pytest.mark.parametrize("name", ["fold_label_profile", "clean_text", "dedupe_first", "attach_scores", "quantile_bins",
                                  "stratified_kfold", "classification_report", "encode_sequences", "augment_training"])
def test_plans_stay_in_jvm(spark, name):
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_baseline_report_workflow(spark):
    from tessera.operators.splits import stratified_kfold
    from tessera.plans.workflows import baseline_report
    s = _scores(spark).drop("fold")
    views = stratified_kfold(s, "vec_id", "label", k=3, seed=42)
    metrics, avg = baseline_report(views, "label", "vec_id", k=3, num_trees=5)
    got = {(r.model, r.part, r.metric): r.n_folds for r in avg.collect()}
    assert {m for m, _, _ in got} == {"forest", "majority", "uniform"}
    assert set(got.values()) == {3}
    assert metrics.count() == 3 * 3 * 2 * 4
