"""File sources and sinks.

Reads are single glob reads with the file path taken from the hidden
``_metadata`` column, so a whole directory of split or report files is one
distributed scan instead of a loop over files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, IntegralType, StringType, StructField, StructType

from tessera.functions._util import guard
from tessera.functions.text import parse_vector
from tessera.operators.profile import split_distribution
from tessera.session import cut_lineage

# pandas' default missing-value tokens, which the reference's
# TSV reads turn into NaN.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

TSV_OPTIONS = {"sep": "\t", "header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "FAILFAST"}
#: Every TSV sink doubles quotes, as the reader expects.
TSV_WRITE = {"sep": "\t", "header": "true", "quote": '"', "escape": '"'}


def _as_strings(schema: StructType) -> StructType:
    return StructType([StructField(f.name, StringType(), True) for f in schema.fields])


def _typed(c, kind):
    """Text as ``kind``; whole numbers may be written with a fraction of zero (``3.0``),
    as pandas does for integer columns with missing values."""
    if not isinstance(kind, IntegralType):
        return c.cast(kind)
    number = c.cast("double")
    whole = guard(number != F.floor(number), F.concat(F.lit("not a whole number: "), c), number.cast(kind))
    return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).cast(kind)).otherwise(whole)


def normalise_na(df: DataFrame, schema: StructType) -> DataFrame:
    """NA tokens to null, then cast to the declared types (a bad value is an error, as in pandas)."""
    out = []
    for f in schema.fields:
        c = F.col(f.name)
        c = F.when(c.isin(*NA_TOKENS), F.lit(None)).otherwise(c)
        out.append(_typed(c, f.dataType).alias(f.name))
    return df.select(*out, *[c for c in df.columns if c not in schema.names])


def read_corpus(spark: SparkSession, path: str, schema: StructType, with_path: bool = False,
                with_order: bool = False) -> DataFrame:
    """Header TSV (embedded newlines, tabs and doubled quotes allowed) with an
    explicit schema. Multi-line TSV cannot be split, so convert it to Parquet
    once and work on Parquet.

    ``with_order`` adds ``file_path`` and ``position`` (rising within a file): together
    the file order that U3 and J1 take "first" from."""
    r = spark.read.options(**TSV_OPTIONS).schema(_as_strings(schema)).csv(path)
    if with_path or with_order:
        r = r.select("*", F.col("_metadata.file_path").alias("file_path"))
    if with_order:
        r = r.withColumn("position", F.monotonically_increasing_id())
    return normalise_na(r, schema)


def read_splits(spark: SparkSession, root: str, schema: StructType | None = None, fmt: str = "tsv") -> DataFrame:
    """All ``splitN/{train,val,test}`` files under ``root`` with ``fold`` and ``part``
    from the path, in one read. ``fmt='parquet'`` / ``'tsv-partitioned'`` read the
    layouts S5 writes (``fold=N/part=P``) with partition discovery instead."""
    if fmt == "parquet":
        return spark.read.parquet(root)
    if fmt == "tsv-partitioned":
        r = spark.read.options(**TSV_OPTIONS).schema(
            StructType(_as_strings(schema).fields + [StructField("fold", IntegerType()),
                                                      StructField("part", StringType())])).csv(root)
        return normalise_na(r, schema)
    df = read_corpus(spark, f"{root.rstrip('/')}/split*/*.csv", schema, with_path=True)
    fold = F.regexp_extract("file_path", r"split(\d+)/[^/]+$", 1).cast("int")
    part = F.regexp_extract("file_path", r"/(train|val|test)\.csv$", 1)
    return df.withColumn("fold", fold).withColumn("part", part).drop("file_path")


def read_predictions(spark: SparkSession, path: str, schema: StructType, vec: str = "predictions") -> DataFrame:
    """S3: every prediction file in a directory; ``file`` (whole path) and ``pos``
    (increasing in file order within a file) feed the last-wins rule of J3."""
    df = read_corpus(spark, path, schema, with_order=True)
    return df.withColumn(vec, parse_vector(vec)).withColumnRenamed("file_path", "file").withColumnRenamed("position", "pos")


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """Text reports ``<run>/<run>_{dev,test}_results.txt`` to a long table
    (run, split, label, metric, value). Runs whose name contains ``txt`` are
    skipped. Class lines have 5 tokens, ``accuracy`` 3, ``macro avg`` /
    ``weighted avg`` 6; precision, recall and F1 are emitted under their names
    (the reference keeps only the first number of the average lines)."""
    lines = spark.read.text(f"{root.rstrip('/')}/*/*_results.txt") \
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    # a report is a file <run>/<run>_<split>_results.txt, or a folder of that
    # name holding the part files a Spark text write produces
    seg = r"/([^/]+)/([^/]+_(dev|test)_results\.txt)(/[^/]+)?$"
    run = F.regexp_extract("path", seg, 1)
    fname = F.regexp_extract("path", seg, 2)
    split = F.regexp_extract("path", seg, 3)
    t = lines.select(run.alias("run"), split.alias("split"), fname.alias("fname"),
                     F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ").alias("tok"))
    t = t.where((F.col("fname") == F.concat(F.col("run"), F.lit("_"), F.col("split"), F.lit("_results.txt")))
                & ~F.col("run").contains("txt") & (F.size("tok") > 2) & (F.col("tok")[0] != "precision"))
    n, tok = F.size("tok"), F.col("tok")

    def m(label, metric, v):
        return F.struct(label.alias("label"), metric.alias("metric"), v.alias("v"))

    every = F.lit("all")
    metrics = F.when(n == 5, F.array(*[m(tok[0], F.lit(name), tok[i + 1])
                                       for i, name in enumerate(("precision", "recall", "f1", "support"))])) \
        .when((n == 3) & (tok[0] == "accuracy"), F.array(m(every, F.lit("accuracy"), tok[1]))) \
        .when(n == 6, F.array(*[m(every, F.concat(tok[0], F.lit("_" + name)), tok[i + 2])
                                for i, name in enumerate(("precision", "recall", "f1", "support"))]))
    out = t.select("run", "split", F.explode(metrics).alias("m"))
    return out.select("run", "split", "m.label", "m.metric", F.col("m.v").cast("double").alias("value"))


def write_reports(report: DataFrame, root: str, run: str = "run", split: str = "split") -> None:
    """Text reports in the layout S4 reads: one ``<run>/<run>_<split>_results.txt``
    per (run, split) of an E2 report table (label, precision, recall,
    f1_score, support). The report is materialised once; the driver loops over the
    (few) runs only."""
    report = cut_lineage(report)
    keys = [(r[run], r[split]) for r in report.select(run, split).distinct().collect()]
    num = lambda c: F.format_string("%.10f", F.col(c))
    line = (F.when(F.col("label") == "accuracy",
                   F.concat_ws(" ", F.lit("accuracy"), num("precision"), F.col("support").cast("string")))
            .otherwise(F.concat_ws(" ", F.col("label"), num("precision"), num("recall"), num("f1_score"),
                                   F.col("support").cast("string"))))
    header = "precision recall f1-score support"
    for r, sp in keys:
        body = report.where((F.col(run) == r) & (F.col(split) == sp)).select(line.alias("value"))
        head = report.sparkSession.createDataFrame([(header,)], "value string")
        head.unionByName(body).coalesce(1).write.mode("errorifexists").text(f"{root.rstrip('/')}/{r}/{r}_{sp}_results.txt")


def write_splits(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One table partitioned by fold and part (``fold=N/part=P``);
    ``fmt='tsv'`` writes header TSV files in the same layout."""
    w = df.write.mode(mode).partitionBy("fold", "part")
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "tsv":
        w.options(**TSV_WRITE).csv(path)
    else:
        raise ValueError(fmt)


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet", vec: str = "probability",
                      mode: str = "errorifexists") -> None:
    """Gold label, predicted label and probability vector; TSV stores the
    vector as JSON text (``[0.1,0.9]``), readable again with S3."""
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "tsv":
        df.withColumn(vec, F.to_json(vec)).write.mode(mode).options(**TSV_WRITE).csv(path)
    else:
        raise ValueError(fmt)


def wide_metrics(df: DataFrame, index: str = "label", metric: str = "metric", value: str = "value",
                 metrics=None) -> DataFrame:
    """Long metrics to one row per ``index`` with a column per metric (pivot).
    Pass ``metrics`` to avoid the extra distinct job that discovers them."""
    return df.groupBy(index).pivot(metric, metrics).agg(F.first(value))


def write_metrics(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Metrics tables as JSON lines, TSV or Parquet, in as many files as the table has partitions."""
    w = df.write.mode(mode)
    if fmt == "json":
        w.json(path)
    elif fmt == "tsv":
        w.options(**TSV_WRITE).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(fmt)


def write_distributions(df: DataFrame, labels, path: str, mode: str = "errorifexists") -> None:
    """Label frequencies per fold x part x label column (A3), as one table
    instead of a text file per fold, part and label."""
    split_distribution(df, labels).write.mode(mode).partitionBy("field").parquet(path)
