"""Models over folds and grids of settings from one pass over the text.

The training set of fold f is everything but fold f, so any count over it is the total
minus the count in fold f. Documents are tokenised and their terms counted once;
one aggregation gives the document frequencies of every fold, another the label counts,
and the inverse document frequencies and class weights of all k training sets follow
by subtraction. Only the model fits themselves loop, over folds and runs; they
read the materialised term vectors.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions._util import guard
from tessera.operators import forest
from tessera.operators.metrics import confusion, evaluate
from tessera.operators.models import SCORE_FEATURES, fit_partitions, stable_input
from tessera.operators.select import best_run
from tessera.operators.small import PARALLEL_FITS, join_small, null_safe_on, side_by_side
from tessera.operators.splits import assign_folds
from tessera.session import cut_lineage

FOLD = "fold"


def terms_of(text: str, max_terms: int | None = None) -> Column:
    """Terms of a text: lower-cased, split at white space as M7 does; the first ``max_terms``
    of them where given. A null text has none."""
    t = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", -1)
    t = F.filter(t, lambda w: w != "")
    return t if max_terms is None else F.slice(t, 1, max_terms)


def fold_frequencies(df: DataFrame, fold: str, terms: str | Column, k: int) -> DataFrame:
    """(term, d0..dk-1): documents of each fold that hold a term, one row per term. Terms of
    an array repeat freely; the shuffle is of counts combined in the tasks."""
    t = F.col(terms) if isinstance(terms, str) else terms
    once = df.select(F.col(fold).alias("_f_fold"), F.explode(F.array_distinct(t)).alias("term"))
    counts = [F.count_if(F.col("_f_fold") == f).alias(f"d{f}") for f in range(k)]
    return once.groupBy("term").agg(*counts)


def held_out_idf(frequencies: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(fold, term, docs, n_docs, idf) of the k training sets, each the total minus its fold:
    ``idf = ln((n_docs + 1) / (docs + 1))``. ``sizes`` are the documents of each fold."""
    total = reduce(lambda a, b: a + b, [F.col(f"d{f}") for f in range(len(sizes))])
    rows = F.array(*[F.struct(F.lit(f).alias(FOLD), (total - F.col(f"d{f}")).alias("docs"), F.lit(sum(sizes) - sizes[f]).cast("long").alias("n_docs"))
                     for f in range(len(sizes))])
    out = frequencies.select("term", F.explode(rows).alias("x")).select(f"x.{FOLD}", "term", "x.docs", "x.n_docs")
    return out.withColumn("idf", F.log((F.col("n_docs") + 1) / (F.col("docs") + 1)))


def fold_sizes(df: DataFrame, fold: str, k: int) -> list[int]:
    """Rows of each fold (k numbers)."""
    got = dict(df.groupBy(fold).count().collect())
    return [got.get(f, 0) for f in range(k)]


def held_out_weights(df: DataFrame, fold: str, label: str, k: int, out: str = "weights") -> DataFrame:
    """``df`` with an array of its label's class weight (A5) in each of the k training sets;
    null where a training set lacks the label. One aggregation, by subtraction."""
    counts = df.groupBy(label).agg(*[F.count_if(F.col(fold) == f).alias(f"c{f}") for f in range(k)])
    total = reduce(lambda a, b: a + b, [F.col(f"c{f}") for f in range(k)])
    per = counts.select(F.col(label).alias("_w_label"), F.array(*[total - F.col(f"c{f}") for f in range(k)]).alias("_w_n"))
    per = cut_lineage(per)  # one row per class
    sums = per.where("_w_label IS NOT NULL").agg(*[F.sum(F.col("_w_n")[f]).alias(f"n{f}") for f in range(k)],
                                                 *[F.count_if(F.col("_w_n")[f] > 0).alias(f"m{f}") for f in range(k)]).first()
    weights = F.array(*[F.try_divide(F.lit(float(sums[f"n{f}"] or 0)), F.lit(float(sums[f"m{f}"])) * F.col("_w_n")[f]) for f in range(k)])
    per = per.where("_w_label IS NOT NULL").select("_w_label", weights.alias(out))
    return join_small(df, per, F.col(label) == F.col("_w_label"), "left").drop("_w_label")


class FoldFeatures(NamedTuple):
    """Materialised term vectors with a fold, and the inverse document frequencies of the
    k training sets (arrays of ``num_features``, a parameter)."""

    rows: DataFrame
    idf: list[np.ndarray]
    label: str
    #: partitions of a training set, or none where the rows lie as a head that samples needs them
    partitions: int | None = None

    def train(self, f: int) -> DataFrame:
        rows = self.rows.where(F.col(FOLD) != f).withColumn("weight", F.col("weights")[f]).drop("weights")
        return rows if self.partitions is None else rows.coalesce(self.partitions)

    def laid_out(self, key: str) -> FoldFeatures:
        """These features with rows laid out once by ``key``, for heads that sample by partition: the
        rows of any training set keep their places."""
        return self._replace(rows=cut_lineage(stable_input(self.rows, key)), partitions=None)

    def test(self, f: int) -> DataFrame:
        return self.rows.where(F.col(FOLD) == f).drop("weights")

    def scaled(self, f: int, raw: str = "tf", out: str = "features") -> ElementwiseProduct:
        return ElementwiseProduct(scalingVec=Vectors.dense(self.idf[f]), inputCol=raw, outputCol=out)


def with_fold(df: DataFrame, key: str, label: str, k: int, seed) -> DataFrame:
    """``df`` with its K3 fold; a row whose label is null can be neither trained on nor
    judged and is an error, and so is a repeated key.

    Folds are ranked on the narrow (key, label) projection; the wide rows meet them in one
    join, against a broadcast table where its checked size allows."""
    checked = df.withColumn(label, guard(F.col(label).isNull(), F.concat(F.lit("no label for key "), F.coalesce(F.col(key).cast("string"), F.lit("null"))), F.col(label)))
    folds = assign_folds(checked.select(key, label), key, label, k, seed, fold_col=FOLD)
    folds = folds.select(F.col(key).alias("_w_key"), FOLD)
    return join_small(checked, folds, null_safe_on([key], ["_w_key"]), "inner").drop("_w_key")


def fold_features(folded: DataFrame, key: str, label: str, text: str, k: int, num_features: int = 1 << 18,
                  max_terms: int | None = None) -> FoldFeatures:
    """Hashed term counts of ``folded`` (key, label, text, fold), tokenised once, and what
    every training set needs from them."""
    weighted = held_out_weights(folded.select(key, label, FOLD, terms_of(text, max_terms).alias("terms")), FOLD, label, k)
    rows = HashingTF(inputCol="terms", outputCol="tf", numFeatures=num_features).transform(weighted).drop("terms")
    rows = cut_lineage(rows)
    found = fold_frequencies(rows.select(FOLD, F.unwrap_udt("tf")["indices"].alias("at")), FOLD, "at", k)
    sizes = fold_sizes(rows, FOLD, k)
    # at most num_features rows of k + 1 numbers
    table = found.toArrow()
    at = table.column("term").to_numpy()
    docs = np.zeros((k, num_features))
    for f in range(k):
        docs[f, at] = table.column(f"d{f}").to_numpy()
    rest = docs.sum(axis=0) - docs
    n = sum(sizes) - np.array(sizes)
    return FoldFeatures(rows, [np.log((n[f] + 1) / (rest[f] + 1)) for f in range(k)], label, fit_partitions(rows, "tf"))


def _default_head(label: str) -> Estimator:
    return LogisticRegression(labelCol=label, featuresCol="features", weightCol="weight", regParam=0.01, maxIter=100)


def fit_fold(features: FoldFeatures, f: int, head: Estimator) -> PipelineModel:
    """Model of the training set of fold ``f``: its scaling, then the fitted head."""
    scale = features.scaled(f)
    return PipelineModel([scale, head.fit(scale.transform(features.train(f)))])


def predictions(model: PipelineModel, rows: DataFrame, keep) -> DataFrame:
    pred = model.transform(rows)
    return pred.select(*keep, F.col("prediction").cast("int").alias("y_hat"), vector_to_array("probability").alias("probability"))


def text_out_of_fold(df: DataFrame, key: str, label: str, text: str = "cleaned_comment", k: int = 5, seed=42,
                     num_features: int = 1 << 18, max_terms: int | None = None, head: Estimator | None = None,
                     parallelism: int = PARALLEL_FITS) -> DataFrame:
    """M10 with M7: (key, label, fold, y_hat, probability), every row predicted by the model
    of the other folds.

    ``head`` is the classifier on ``features`` with ``weight`` as class weights. A null
    text has no terms, a null label and a repeated key are errors. The k models are
    returned by ``fit_fold``; this function keeps only what they predict."""
    features = fold_features(with_fold(df.select(key, label, text), key, label, k, seed), key, label, text, k, num_features, max_terms)
    head = head or _default_head(label)
    models = side_by_side([lambda f=f: fit_fold(features, f, head) for f in range(k)], parallelism)
    parts = [predictions(models[f], features.test(f), [key, label, FOLD]) for f in range(k)]
    return reduce(DataFrame.unionByName, parts)


def forests_over_folds(views: DataFrame, label: str, key: str, features=SCORE_FEATURES, k: int = 5, num_trees: int = 1000,
                       seed: int = 0, max_depth: int = 30, parallelism: int = PARALLEL_FITS) -> DataFrame:
    """M3 on every fold of ``views`` (fold, part): (key, fold, part, label, y_hat) of the parts
    other than train, each predicted by the forest of its fold's train part. The fits run
    side by side and read one materialised table."""
    cols = [key, FOLD, "part", label]
    rows = cut_lineage(views.select(*cols, *[c for c in features if c not in cols]))

    def judged(f: int) -> DataFrame:
        here = rows.where(F.col(FOLD) == f)
        pred = forest.fit_and_predict(here.where(F.col("part") == "train"), here.where(F.col("part") != "train"), label, list(features),
                                      num_trees, seed, max_depth, cols, key)
        return cut_lineage(pred.drop("probability"))

    return reduce(DataFrame.unionByName, side_by_side([lambda f=f: judged(f) for f in range(k)], parallelism))


# --- H1: grids ------------------------------------------------------------------
def settings_of(params: Mapping[str, Sequence]) -> list[dict]:
    """All combinations of the values, the last name varying fastest."""
    return [dict(zip(params, values)) for values in itertools.product(*params.values())]


def run_key(settings: Mapping, template: str) -> str:
    """Name of a run: the template with the settings' values."""
    return template.format(**settings)


def grid_plan(folded: DataFrame, params: Mapping[str, Sequence], template: str, k: int, fold: str = FOLD) -> DataFrame:
    """H1 plan: one row per run of the grid and fold of ``folded``: (step, group, run, the
    settings, fold, n_train, n_test). ``group`` names the settings, ``run`` adds the fold.
    Runs are numbered in grid order; the product is of a grid and k folds, both small."""
    spark = folded.sparkSession
    runs = settings_of(params)
    names = [run_key(x, template) for x in runs]
    if len(set(names)) < len(names):
        raise ValueError("the template gives two runs one name")
    sizes = fold_sizes(folded, fold, k)
    rows = [{"step": s, "group": name, "run": f"{name}-fold{f}", **x, fold: f, "n_train": sum(sizes) - sizes[f], "n_test": sizes[f]}
            for s, (x, name) in enumerate(zip(runs, names)) for f in range(k)]
    kind = {int: "long", float: "double", str: "string"}
    schema = ", ".join(["step int", "`group` string", "run string", *[f"`{n}` {kind[type(v[0])]}" for n, v in params.items()],
                        f"`{fold}` int", "n_train long", "n_test long"])
    return spark.createDataFrame(rows, schema)


def sweep_folds(features_of: Callable[[dict], FoldFeatures], params: Mapping[str, Sequence], head_of: Callable[[dict, str], Estimator],
                template: str, k: int, parallelism: int = PARALLEL_FITS) -> DataFrame:
    """H1 runs: fits every run of the grid on every fold and judges it on that fold:
    (step, group, fold, and the metrics of ``evaluate``), one row per run and fold.

    ``features_of(settings)`` gives the materialised features (the caller may share them
    between runs), ``head_of(settings, label)`` the classifier. A model is judged where it is
    fitted and let go: only its confusion counts (classes squared) stay. All runs have the same label."""
    runs = settings_of(params)
    features = [features_of(x) for x in runs]

    def judged(x: dict, ft: FoldFeatures, f: int) -> list[tuple]:
        pred = predictions(fit_fold(ft, f, head_of(x, ft.label)), ft.test(f), [F.col(ft.label).alias("y")])
        return [(r["y"], r["y_hat"], r["n"]) for r in confusion(pred).collect()]

    tasks = [lambda x=x, ft=ft, f=f: judged(x, ft, f) for x, ft in zip(runs, features) for f in range(k)]
    counts = side_by_side(tasks, parallelism)
    rows = [(i // k, run_key(runs[i // k], template), i % k, *c) for i, found in enumerate(counts) for c in found]
    label = features[0].rows.schema[features[0].label].dataType.simpleString()
    table = features[0].rows.sparkSession.createDataFrame(rows, f"step int, `group` string, `{FOLD}` int, y {label}, y_hat int, n long")
    return evaluate(table, "y", "y_hat", by=["step", "group", FOLD], n="n")


def run_summary(metrics: DataFrame, metric: str = "pos_f1") -> DataFrame:
    """(step, group, n_folds, metric): the mean of ``metric`` over a run's folds, rounded to
    12 places so that runs that are equal but for the order of a sum tie."""
    return metrics.groupBy("step", "group").agg(F.count(F.lit(1)).alias("n_folds"), F.round(F.avg(metric), 12).alias(metric))


def best_of_sweep(metrics: DataFrame, metric: str = "pos_f1") -> DataFrame:
    """The run with the best mean over its folds; the earliest of the grid wins ties (O2)."""
    return best_run(run_summary(metrics, metric), metric, "step")
