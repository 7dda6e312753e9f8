"""Parallel TSV ingest against the one-task reader, and the file order it keeps."""

import csv
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tessera.operators.joins import attach_scores
from tessera.operators.sets import dedupe_first
from tessera.sources.files import read_corpus
from tessera.sources.ingest import FILE_ORDER, ingest_corpus, read_records

SCHEMA = StructType([StructField("id", IntegerType()), StructField("text", StringType()), StructField("score", DoubleType())])
PIECES = ["word", "two words", 'a "quote"', "tab\there", "line\nbreak", "\n\n", '"', "é漢", "NA", "", "nan", " x ", "a,b"]


def write(path, rows, end="\n", last=True):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, delimiter="\t", lineterminator=end)
        w.writerow(["id", "text", "score"])
        w.writerows(rows)
    if not last:
        with open(path, "rb+") as f:
            f.truncate(os.path.getsize(path) - len(end))


def rows(rng, n):
    return [(k, "".join(rng.choice(PIECES) for _ in range(rng.randrange(5))) + rng.choice(["", "z" * rng.randrange(60)]), rng.choice(["", "1.5", "NaN", k])) for k in range(n)]


@pytest.mark.parametrize("split", ["37b", "400b", "128m"])
def test_same_rows_as_the_one_task_reader(spark, scratch, split):
    rng = random.Random(3)
    for k, n in enumerate((120, 1, 0, 40)):
        write(f"{scratch}/part{k}.tsv", rows(rng, n), last=k != 3)
    want = read_corpus(spark, f"{scratch}/*.tsv", SCHEMA, with_order=True)
    want = sorted(((r["file_path"], r["id"], r["text"], str(r["score"])) for r in want.collect()), key=str)
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = spark.read.text(f"{scratch}/*.tsv").rdd.getNumPartitions()
        assert split == "128m" or lines > 8
        got = read_records(spark, f"{scratch}/*.tsv", SCHEMA).collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sorted(((r["source_file"], r["id"], r["text"], str(r["score"])) for r in got), key=str) == want
    assert len({(r["source_file"], r["position"]) for r in got}) == len(got)
    # positions are the bytes at which the records begin, in the order of the file
    for name in {r["source_file"] for r in got}:
        own = sorted((r["position"], r["id"]) for r in got if r["source_file"] == name)
        assert [i for _, i in own] == sorted(i for _, i in own)
        body = open(name.replace("file:", ""), "rb").read()
        assert all(body[p:p + len(str(i))] == str(i).encode() and body[p - 1:p] == b"\n" for p, i in own)


def test_round_trip_and_first_rows_in_file_order(spark, scratch):
    write(f"{scratch}/b.tsv", [(1, "same\ntext", 0.5), (2, "other", 2), (1, "late", 9)])
    write(f"{scratch}/a.tsv", [(7, "other", 3), (1, "early", 4), (8, "same\ntext", 6)], end="\r\n")
    table = ingest_corpus(spark, f"{scratch}/*.tsv", SCHEMA, f"{scratch}/corpus", by_file=True)
    assert sorted((r["id"], r["text"], r["score"], r["file_name"]) for r in table.collect()) == sorted(
        [(1, "same\ntext", 0.5, "b.tsv"), (2, "other", 2.0, "b.tsv"), (1, "late", 9.0, "b.tsv"), (7, "other", 3.0, "a.tsv"), (1, "early", 4.0, "a.tsv"), (8, "same\ntext", 6.0, "a.tsv")])
    # first in file order: a.tsv comes before b.tsv
    first = dedupe_first(table.drop("file_name"), "text", list(FILE_ORDER))
    assert sorted(r["id"] for r in first.collect()) == [1, 1, 7, 8]
    keys = spark.createDataFrame([(1,), (2,)], "id int")
    got = attach_scores(keys, table, "id", list(FILE_ORDER), ["text", "score"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "early", 4.0), (2, "other", 2.0)]


def test_open_quotes_are_an_error(spark, scratch):
    with open(f"{scratch}/x.tsv", "w") as f:
        f.write('id\ttext\tscore\n1\t"never closed\t2\n')
    with pytest.raises(Exception, match="quotes are not closed"):
        read_records(spark, f"{scratch}/x.tsv", SCHEMA).collect()


def test_bad_field_is_an_error(spark, scratch):
    write(f"{scratch}/x.tsv", [("one", "t", 1)])
    with pytest.raises(Exception):
        read_records(spark, f"{scratch}/x.tsv", SCHEMA).select(F.sum("id")).collect()
