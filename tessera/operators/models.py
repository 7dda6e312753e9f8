"""Models as distributed jobs (M3-M10, H1) with ``pyspark.ml``.

Fitting is Spark MLlib (tree aggregation over partitions); inference is a
DataFrame transform. Numbers do not equal scikit-learn or torch; the
properties checked are: fixed seeds repeat, every row is scored once,
probabilities sum to 1.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import TrainValidationSplitModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tessera.functions.text import argmax, softmax
from tessera.operators import forest
from tessera.operators.encode import explode_probs
from tessera.operators.joins import attach_predictions, attach_scores
from tessera.operators.profile import with_class_weight
from tessera.operators.splits import assign_folds
from tessera.operators.small import side_by_side
from tessera.session import cut_lineage

SCORE_FEATURES = ("cogency", "effectiveness", "reasonableness", "overall")


#: Partitions of a training set whose fit samples by partition. Part of the fit's
#: definition: the same number repeats the same model on any cluster. Raise it with the
#: training set (about 100 MB a partition).
FIT_PARTITIONS = 8
#: Partitions of a training set whose fit sums a gradient as wide as the vocabulary over all
#: rows in every iteration: a partial sum of each partition is sent, so there are these few, or
#: one for every FIT_BYTES of term vectors where that is more, and for vectors of FIT_SHARE
#: times the bytes of a sum at least: what a pass sends stays a small share of what it reads.
FIT_TASKS, FIT_BYTES, FIT_SHARE = 4, 256 << 20, 512


def stable_input(df: DataFrame, key, partitions: int = FIT_PARTITIONS) -> DataFrame:
    """A deterministic physical layout for fits that sample: MLlib seeds its sampling per
    partition and row position, so the same seed only repeats when partitions
    hold the same rows in the same order. Hash-partition by the key into
    ``partitions`` and sort within partitions."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys)


def fit_partitions(rows: DataFrame, vector: str) -> int:
    """Partitions for fits on the sparse vectors of ``rows``, by their size (a term takes a place and a count)
    and their width."""
    v = F.unwrap_udt(vector)
    terms, width = rows.agg(F.sum(F.size(v["indices"]).cast("long")), F.max(v["size"])).first()
    return partial_sums(12 * (terms or 0), width or 0)


def partial_sums(size: int, width: int) -> int:
    """Partial sums of ``width`` doubles in a pass over vectors of ``size`` bytes."""
    return max(FIT_TASKS, -(-size // max(FIT_BYTES, FIT_SHARE * 8 * width)))


def _with_probs(pred: DataFrame, keep, label_out: str = "y_hat") -> DataFrame:
    return pred.select(*keep, F.col("prediction").cast("int").alias(label_out),
                       vector_to_array("probability").alias("probability"))


def score_forest(train: DataFrame, test: DataFrame, label: str, features=SCORE_FEATURES,
                 num_trees: int = 1000, seed: int = 0, max_depth: int = 30, keep=(), key=None):
    """M3: random forest on numeric score columns; returns (model, predictions).
    Depth is capped at 30; the reference grows trees fully.
    With ``key`` (a unique column) the fit repeats exactly for a fixed seed."""
    model = forest.fit(train, label, list(features), num_trees, seed, max_depth, key)
    return model, model.predict(test, list(dict.fromkeys([*keep, label])))


def feature_importance(model, names=SCORE_FEATURES, spark: SparkSession | None = None) -> DataFrame:
    """M5: (feature, importance) ascending; one row per feature (a fixed, small size)."""
    imp = model.importances.tolist()
    spark = spark or SparkSession.getActiveSession()
    rows = sorted(zip(names, imp), key=lambda r: (r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def stacked_forest(train: DataFrame, test: DataFrame, label: str, key: str, scores: DataFrame,
                   score_order, preds: DataFrame, n_classes: int, num_trees: int = 1000, seed: int = 0,
                   max_depth: int = 30, features=SCORE_FEATURES):
    """M4: J1 scores + J3 prediction vectors + T10 columns, then a forest on all of them."""
    def prep(df):
        df = attach_scores(df, scores, key=key, order=score_order, cols=list(features))
        df = attach_predictions(df, preds, key, on_missing="error")
        return explode_probs(df, "predictions", n_classes)
    cols = list(features) + [f"prediction_class{i}" for i in range(n_classes)]
    return score_forest(prep(train), prep(test), label, cols, num_trees, seed, max_depth, keep=[key], key=key)


def mlp_hidden_layers(width: int, n_classes: int) -> list[int]:
    """M6 layer rule: width // 4 repeatedly, kept while above the number of classes."""
    dims, d = [], width
    while True:
        d //= 4
        if d <= n_classes:
            return dims
        dims.append(d)


def fused_mlp(train: DataFrame, test: DataFrame, label: str, vector: str, numeric, n_classes: int,
              seed: int = 42, max_iter: int = 100, keep=(), key=None):
    """M6: text vector + standardised numeric scores concatenated, MLP head."""
    numeric = list(numeric)
    width = train.select(F.size(vector)).first()[0] + len(numeric)
    if key is not None:
        train = stable_input(train, key)
    def vec(df):
        return df.withColumn("_m_text", array_to_vector(F.col(vector).cast("array<double>")))
    num = VectorAssembler(inputCols=numeric, outputCol="_m_num")
    scale = StandardScaler(inputCol="_m_num", outputCol="_m_scaled", withMean=True, withStd=True)
    both = VectorAssembler(inputCols=["_m_text", "_m_scaled"], outputCol="features")
    layers = [width] + mlp_hidden_layers(width, n_classes) + [n_classes]
    mlp = MultilayerPerceptronClassifier(labelCol=label, featuresCol="features", layers=layers, seed=seed,
                                         maxIter=max_iter)
    model = Pipeline(stages=[num, scale, both, mlp]).fit(vec(train))
    return model, _with_probs(model.transform(vec(test)), list(keep) + [label])


def _text_features(text: str, num_features: int):
    tok = RegexTokenizer(inputCol=text, outputCol="_m_tok", pattern=r"\s+", toLowercase=True)
    tf = HashingTF(inputCol="_m_tok", outputCol="_m_tf", numFeatures=num_features)
    idf = IDF(inputCol="_m_tf", outputCol="features")
    return [tok, tf, idf]


def text_classifier(train: DataFrame, label: str, text: str = "cleaned_comment", weighted: bool = True,
                    num_features: int = 1 << 18, reg: float = 0.01, max_iter: int = 100, key=None):
    """M7: tokens -> hashed term frequencies -> IDF -> logistic regression,
    with class weights (A5) as ``weightCol`` when ``weighted``. A small L2
    penalty keeps the fit well-posed on sparse, high-dimensional text. Neither IDF
    nor the regression samples, so rows need no fixed layout; pass a materialised
    table, both read it."""
    data = with_class_weight(train, label, "_m_w") if weighted else train
    lr = LogisticRegression(labelCol=label, featuresCol="features", regParam=reg, maxIter=max_iter,
                            weightCol="_m_w" if weighted else None)
    return Pipeline(stages=_text_features(text, num_features) + [lr]).fit(data)


def text_regressor(train: DataFrame, target: str, text: str = "cleaned_comment",
                   num_features: int = 1 << 18, reg: float = 0.01, max_iter: int = 100, key=None):
    """M8: the M7 features with a (ridge) linear regression head."""
    lin = LinearRegression(labelCol=target, featuresCol="features", regParam=reg, maxIter=max_iter)
    return Pipeline(stages=_text_features(text, num_features) + [lin]).fit(train)


def predict(model, df: DataFrame, keep, label_out: str = "y_hat") -> DataFrame:
    return _with_probs(model.transform(df), keep, label_out)


def score_corpus(df: DataFrame, features: str, make_predictor: Callable, n_out: int, keep=()) -> DataFrame:
    """M9: batch inference with user code. ``make_predictor()`` is called once per
    task (load the model there) and maps a 2-D numpy batch to logits; Arrow
    batches in, logits out, then softmax (T11) and argmax (T12) in Spark."""
    keep = list(keep)

    def run(batches):
        import numpy as np
        import pandas as pd
        predictor = make_predictor()
        for pdf in batches:
            x = np.stack(pdf[features].map(lambda v: np.asarray(v, dtype="float64")).to_numpy()) \
                if len(pdf) else np.zeros((0, 0))
            logits = predictor(x) if len(pdf) else np.zeros((0, n_out))
            out = pdf[keep].copy() if keep else pd.DataFrame(index=pdf.index)
            out["logits"] = [row.tolist() for row in np.asarray(logits, dtype="float64")]
            yield out

    schema = df.select(*keep).schema.add("logits", ArrayType(DoubleType()))
    scored = df.select(*keep, features).mapInPandas(run, schema)
    return scored.select(*keep, softmax("logits").alias("probability"), argmax("logits").alias("y_hat"))


def out_of_fold(df: DataFrame, key: str, label: str, fit: Callable, k: int = 5, seed=42,
                checkpoint: bool = True) -> DataFrame:
    """K-fold fit/predict; every row is predicted by the model that did not
    see it. The fold-assigned frame is checkpointed once (lineage cut) and
    reused by all k fits; the driver loops over k only."""
    folded = assign_folds(df, key, label, k, seed, fold_col="_m_fold")
    if checkpoint:
        folded = cut_lineage(folded)
    outs = []
    for f in range(k):
        model = fit(folded.where(F.col("_m_fold") != f))
        outs.append(predict(model, folded.where(F.col("_m_fold") == f), [key, label, "_m_fold"]))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res.withColumnRenamed("_m_fold", "fold")


def grid(spark: SparkSession, params: dict) -> DataFrame:
    """H1: the Cartesian product of settings as a DataFrame with a run key
    (``name=value`` pairs joined by ``_``). Built by successive explodes."""
    names = list(params)
    combos = list(itertools.product(*[params[n] for n in names]))
    rows = [dict(zip(names, c)) for c in combos]
    df = spark.createDataFrame(rows)
    key = F.concat_ws("_", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names])
    return df.select(*names, key.alias("run"))


def best_params(table: DataFrame, metric: str = "f1") -> DataFrame:
    """H1 selection: the best run by ``metric``; the first grid entry wins ties (O2 rule)."""
    from tessera.operators.select import best_run
    t = table.withColumn("_m_step", F.monotonically_increasing_id())
    return best_run(t, metric, "_m_step").drop("_m_step")


def sweep(train: DataFrame, label: str, text: str = "cleaned_comment", reg_params=(0.0, 0.001, 0.01, 0.1, 1.0),
          num_features=(1 << 12, 1 << 16, 1 << 18), train_ratio: float = 0.75, seed: int = 42, parallelism: int = 4,
          key=None):
    """H1 run: every run of the grid for M7 fitted on one share of the rows and judged on the rest;
    returns the split model (the best run fitted on all rows, and the metrics in grid order) and a
    (params..., metric) table with the best run first."""
    tok, tf, idf = _text_features(text, 1 << 12)
    terms, rows = tok.getOutputCol(), tok.transform(stable_input(train, key) if key is not None else train)
    tfs = {n: HashingTF(inputCol=terms, outputCol=f"_m_tf{n}", numFeatures=n) for n in num_features}
    for stage in tfs.values():
        rows = stage.transform(rows)
    # the text is tokenised and hashed once for all runs; one draw per row splits it
    rows = cut_lineage(rows.select(label, *[t.getOutputCol() for t in tfs.values()], F.rand(seed).alias("_m_draw")))
    few = fit_partitions(rows, f"_m_tf{max(num_features)}")
    fitting, judging = rows.where(F.col("_m_draw") < train_ratio).coalesce(few), rows.where(F.col("_m_draw") >= train_ratio)
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="f1")
    runs = [(float(r), int(n)) for r in reg_params for n in num_features]

    def counted(part: DataFrame, n: int) -> DataFrame:
        return part.select(label, F.col(tfs[n].getOutputCol()).alias(tf.getOutputCol()))

    def head(reg: float) -> LogisticRegression:
        return LogisticRegression(labelCol=label, featuresCol="features", maxIter=100, regParam=reg)

    idfs = dict(zip(num_features, side_by_side([lambda n=n: idf.fit(counted(fitting, n)) for n in num_features], parallelism)))

    def judged(reg: float, n: int) -> float:
        fitted = head(reg).fit(idfs[n].transform(counted(fitting, n)))
        return ev.evaluate(fitted.transform(idfs[n].transform(counted(judging, n))))

    metrics = side_by_side([lambda r=r, n=n: judged(r, n) for r, n in runs], parallelism)
    reg, n = runs[int(np.argmax(metrics))]
    whole = idf.fit(counted(rows, n))
    best = PipelineModel([tok, tf.copy({tf.numFeatures: n}), whole, head(reg).fit(whole.transform(counted(rows.coalesce(few), n)))])
    table = sorted([(r, m, float(x)) for (r, m), x in zip(runs, metrics)], key=lambda r: -r[2])  # stable: the first grid entry wins ties
    return TrainValidationSplitModel(best, metrics), train.sparkSession.createDataFrame(table, "reg_param double, num_features int, f1 double")
