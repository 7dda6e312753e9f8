"""S1 ingest: multi-line TSV into Parquet once, in parallel, with the file order kept.

A reader of multi-line records takes a file as one task, since a line break may
stand inside quotes. Here files are read as lines, in splits of any size. A line break ends
a record where the quotes before it in the file are even, so all that a split needs to
know is whether quotes are open at its start: the parity of the quotes in the splits
before it. A first pass adds up quotes and bytes for each split (a row per split); the
second joins lines to records while it streams through a split. Only the pieces of records
that reach over a split's border are put together afterwards, at most two for each split.

Every record is named by its file and ``position``, the byte at which it begins: unique,
rising in file order and the same whatever the splits are.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions._util import guard
from tessera.session import cut_lineage
from tessera.sources.files import TSV_OPTIONS, _as_strings, normalise_na

#: Columns that name a record: the file order that U3 and J1 take "first" from.
FILE_ORDER = ("source_file", "position")

_PIECES = "source_file string, position long, record string, opened boolean, closed boolean"


def _lines(spark: SparkSession, path) -> DataFrame:
    r = spark.read.option("lineSep", "\n").text(path)
    return r.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _splits(lines: DataFrame) -> DataFrame:
    """One row for each split: bytes and parity of the quotes of its file before it."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    # every line has its line break; only the last of a file may lack it
    per = cut_lineage(lines.groupBy("source_file", "block").agg(F.sum(quotes).alias("quotes"), F.sum(F.octet_length("line") + 1).alias("bytes")))
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source_file")
    odd = guard(F.sum("quotes").over(whole) % 2 == 1, F.concat(F.lit("quotes are not closed in "), F.col("source_file")), F.sum("quotes").over(before))
    return per.select("source_file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"), (F.coalesce(odd, F.lit(0)) % 2).cast("int").alias("open"))


def _pieces(splits):
    """Records of the splits of a task, in order; the first and last piece of a split may
    be part of a record only (``opened``: it begins here, ``closed``: it ends here)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = ["source_file", "position", "record", "opened", "closed"]
        at = None
        held: list[str] = []
        position = start = 0
        opened = quoted = False
        out: list[list] = [[] for _ in names]

        def close(closed: bool) -> None:
            for column, value in zip(out, (at[0], start, "\n".join(held), opened, closed)):
                column.append(value)
            held.clear()

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
                                               pa.array(out[3], pa.bool_()), pa.array(out[4], pa.bool_())], names=names)
            for column in out:
                column.clear()
            return made

        for b in batches:
            for file, block, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if (file, block) != at:
                    if held:
                        close(False)
                    at = (file, block)
                    position, quoted = splits.value[at]
                    quoted = bool(quoted)
                    opened, start = not quoted, position
                held.append(line)
                position += len(line.encode()) + 1
                if line.count('"') % 2:
                    quoted = not quoted
                if not quoted:
                    close(True)
                    opened, start = True, position
            yield batch()
        if held:
            close(False)
        yield batch()

    return run


def records(spark: SparkSession, path) -> DataFrame:
    """(source_file, position, record): the records of TSV files as text, header and blank
    lines left out. Quotes enclose fields and are doubled inside them, as S5 and S6
    write them; a file whose quotes do not close is an error."""
    lines = _lines(spark, path)
    # a row per split of the files: their bytes over spark.sql.files.maxPartitionBytes
    table = {(r["source_file"], r["block"]): (r["start"], r["open"]) for r in _splits(lines).collect()}
    held = spark.sparkContext.broadcast(table)
    pieces = lines.mapInArrow(_pieces(held), _PIECES)
    whole = pieces.where("opened and closed").select(*FILE_ORDER, "record")
    parts = pieces.where("not (opened and closed)")
    # at most two pieces a split: number the records they belong to, then join the pieces
    in_file = Window.partitionBy("source_file").orderBy("position")
    numbered = parts.withColumn("nth", F.sum(F.col("opened").cast("int")).over(in_file))
    joined = numbered.groupBy("source_file", "nth").agg(F.array_sort(F.collect_list(F.struct("position", "record"))).alias("p"))
    joined = joined.select("source_file", F.col("p")[0]["position"].alias("position"),
                           F.concat_ws("\n", F.transform("p", lambda x: x["record"])).alias("record"))
    every = whole.unionByName(joined).where("position > 0")
    clean = F.regexp_replace("record", "\r$", "")
    return every.withColumn("record", clean).where("record <> ''")


def read_records(spark: SparkSession, path, schema: StructType) -> DataFrame:
    """S1 as ``read_corpus``, split at will: the columns of ``schema`` with ``source_file`` and
    ``position``. Empty files give nothing; a field that is not of its type is an error."""
    options = {k: v for k, v in TSV_OPTIONS.items() if k not in ("header", "multiLine")}
    row = F.from_csv("record", _as_strings(schema).simpleString()[7:-1].replace(":", " "), options)
    parsed = records(spark, path).withColumn("_i_row", row)
    return normalise_na(parsed.select(*[F.col(f"_i_row.`{f.name}`").alias(f.name) for f in schema.fields], *FILE_ORDER), schema)


def ingest_corpus(spark: SparkSession, path, schema: StructType, out: str, mode: str = "errorifexists", by_file: bool = False) -> DataFrame:
    """Converts TSV files to a Parquet table at ``out`` and returns it.

    Rows keep their file order as (``source_file``, ``position``), which U3 (``dedupe_first``)
    and J1 (``attach_scores``) take as their ``order``. Each split writes its own rows, so
    nothing is shuffled but the records that cross a border. ``by_file`` lays the table
    out in a folder per file: for few, large files."""
    rows = read_records(spark, path, schema)
    if by_file:
        rows = rows.withColumn("file_name", F.regexp_extract("source_file", r"([^/]+)$", 1))
    writer = rows.write.mode(mode)
    (writer.partitionBy("file_name") if by_file else writer).parquet(out)
    return spark.read.parquet(out)
