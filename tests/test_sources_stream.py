import os

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tessera.sources import files as S
from tessera.streaming import corpus_stream as ST

SCHEMA = StructType([StructField("UniqueID", StringType()), StructField("translation", StringType()),
                     StructField("jlev", DoubleType()), StructField("int1", IntegerType())])


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_read_corpus_multiline_and_na(spark, scratch):
    p = f"{scratch}/raw.tsv"
    _write(p, 'UniqueID\ttranslation\tjlev\tint1\n'
              '1\t"line one\nline two\twith tab ""quoted"""\t2.0\t3\n'
              'NA\tplain\tNaN\t\n')
    rows = S.read_corpus(spark, p, SCHEMA).collect()
    assert rows[0].translation == 'line one\nline two\twith tab "quoted"'
    assert rows[0].jlev == 2.0 and rows[0].int1 == 3
    assert rows[1].UniqueID is None and rows[1].jlev is None and rows[1].int1 is None


def test_split_round_trip(spark, scratch):
    df = spark.createDataFrame([(0, "train", "a", 1.0, 1), (0, "test", "b", 2.0, 0), (1, "val", "c", None, 1)],
                               "fold int, part string, UniqueID string, jlev double, int1 int") \
        .withColumn("translation", F.lit("t\nx"))
    S.write_splits(df, f"{scratch}/pq")
    back = S.read_splits(spark, f"{scratch}/pq", fmt="parquet")
    assert back.count() == 3 and set(back.columns) >= {"fold", "part"}
    # the reference's TSV layout splitN/{train,val,test}.csv
    for fold, part, uid in [(0, "train", "a"), (0, "test", "b"), (1, "val", "c")]:
        _write(f"{scratch}/tsv/split{fold}/{part}.csv", f"UniqueID\ttranslation\tjlev\tint1\n{uid}\tt\t1.0\t1\n")
    t = S.read_splits(spark, f"{scratch}/tsv", SCHEMA)
    assert sorted((r.fold, r.part, r.UniqueID) for r in t.collect()) == [(0, "test", "b"), (0, "train", "a"), (1, "val", "c")]


def test_predictions_round_trip(spark, scratch):
    df = spark.createDataFrame([(1, 0, [0.1, 0.9]), (0, 0, [0.7, 0.3])], "gold int, pred int, probability array<double>")
    S.write_predictions(df, f"{scratch}/pred", fmt="tsv")
    schema = StructType([StructField("gold", IntegerType()), StructField("pred", IntegerType()),
                         StructField("probability", StringType())])
    back = S.read_predictions(spark, f"{scratch}/pred/*.csv", schema, vec="probability")
    assert sorted(tuple(r.probability) for r in back.collect()) == [(0.1, 0.9), (0.7, 0.3)]


def test_read_reports_g8(spark, scratch):
    rep = ("              precision    recall  f1-score   support\n\n"
           "           0       0.50      0.25      0.33         4\n"
           "           1       0.70      0.88      0.78         8\n\n"
           "    accuracy                           0.67        12\n"
           "   macro avg       0.60      0.56      0.55        12\n"
           "weighted avg       0.63      0.67      0.63        12\n")
    _write(f"{scratch}/runA/runA_dev_results.txt", rep)
    _write(f"{scratch}/runA/runA_test_results.txt", rep)
    _write(f"{scratch}/old.txt/old.txt_dev_results.txt", rep)
    r = S.read_reports(spark, scratch)
    got = {(x.split, x.label, x.metric): x.value for x in r.collect()}
    assert got[("dev", "0", "precision")] == 0.5 and got[("dev", "0", "support")] == 4
    assert got[("dev", "all", "accuracy")] == 0.67
    assert (got[("dev", "all", "macro_precision")], got[("dev", "all", "macro_recall")],
            got[("dev", "all", "macro_f1")]) == (0.6, 0.56, 0.55)
    assert r.select("run").distinct().count() == 1
    wide = S.wide_metrics(r.where("split = 'dev' AND label <> 'all'"), metrics=["precision", "recall", "f1", "support"])
    assert wide.count() == 2
    S.write_metrics(r, f"{scratch}/metrics_out")
    assert spark.read.json(f"{scratch}/metrics_out").count() == r.count()


def test_stream_cleaning(spark, scratch):
    src = f"{scratch}/in"
    spark.createDataFrame([(1, "a\tb http://x.y c", 1), (2, None, 0), (3, "[12:34] hi", None)],
                          "doc_id long, text string, quality int").write.parquet(src)
    schema = spark.read.parquet(src).schema
    cleaned = ST.clean_corpus_stream(ST.read_corpus_stream(spark, src, schema), label="quality")
    q = cleaned.writeStream.format("memory").queryName("tessera_clean").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.doc_id: r.cleaned_comment for r in spark.sql("SELECT * FROM tessera_clean").collect()}
    assert got == {1: "a b c"}
    counts = ST.label_counts_stream(ST.read_corpus_stream(spark, src, schema), "quality")
    q2 = counts.writeStream.format("memory").queryName("tessera_counts").outputMode("complete") \
        .trigger(availableNow=True).start()
    q2.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM tessera_counts").first()[0] == 3
    q3 = ST.start_clean_sink(cleaned, f"{scratch}/out", f"{scratch}/ckpt")
    q3.awaitTermination(120)
    assert spark.read.parquet(f"{scratch}/out").count() == 1


def test_stateless_operators_accept_streams(spark, scratch):
    from tessera.functions import text as T
    from tessera.functions.keys import with_id
    from tessera.operators import filters as FL
    src = f"{scratch}/vec"
    spark.createDataFrame([(1, "a", "[1.0, 3.0]", [3, 0], True), (2, None, "[2.0, 0.5]", [0, 0], False)],
                          "id long, text string, v string, ids array<int>, flag boolean").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    out = FL.exclude_flagged(stream, F.col("flag") & F.lit(False))
    out = with_id(FL.model_view(out.withColumn("label", F.col("id")), "text", "label")
                  .withColumn("v", F.lit("[1.0, 3.0]")), ["text", "label"])
    out = out.select("ID", T.clean_text("text").alias("c"), T.word_count("text").alias("w"),
                     T.softmax(T.parse_vector("v")).alias("p"), T.argmax(T.parse_vector("v")).alias("a"),
                     T.attention_mask(F.array(F.lit(3), F.lit(0))).alias("m"))
    q = out.writeStream.format("memory").queryName("tessera_stateless").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {r.ID: r for r in spark.sql("SELECT * FROM tessera_stateless").collect()}
    assert set(rows) == {"a#1", "nan#2"}
    assert rows["a#1"].a == 1 and rows["a#1"].m == [1, 0] and abs(sum(rows["a#1"].p) - 1) < 1e-12


def test_summarize_reports_workflow(spark, scratch):
    from tessera.plans.workflows import summarize_reports
    for run, acc in (("r1", "0.50"), ("r2", "0.80")):
        rep = ("              precision    recall  f1-score   support\n\n"
               f"           0       0.50      0.25      0.33         4\n"
               f"    accuracy                           {acc}        12\n"
               "   macro avg       0.60      0.56      0.55        12\n")
        _write(f"{scratch}/{run}/{run}_test_results.txt", rep)
    overall, per_class = summarize_reports(spark, scratch)
    got = {(r.split, r.metric): r for r in overall.collect()}
    assert abs(got[("test", "accuracy")].geo_mean - (0.5 * 0.8) ** 0.5) < 1e-12
    assert got[("test", "accuracy")].n == 2
    pc = {(r.label, r.metric): r for r in per_class.collect()}
    assert pc[("0", "precision")].mean == 0.5 and pc[("0", "precision")].stdev == 0.0


def test_stream_clean_reads_a_table_of_one_file_or_of_many(spark, scratch):
    from tessera.plans.catalog import q_stream_clean
    docs = spark.createDataFrame([(k, f"Text  {k}", "en", "s", 7) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    for sf, parts in (("one", 1), ("many", 3)):
        docs.repartition(parts).write.parquet(f"{scratch}/{sf}/documents.parquet")
        labels.write.parquet(f"{scratch}/{sf}/labels.parquet")
    os.makedirs(f"{scratch}/file")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{scratch}/one/{name}.parquet").toPandas().to_parquet(f"{scratch}/file/{name}.parquet")
    for sf in ("one", "many", "file"):
        out = q_stream_clean(spark, f"{scratch}/{sf}").collect()
        assert sorted((r["doc_id"], r["n_words"]) for r in out) == [(k, 2) for k in range(30)], sf
