"""JSON-lines readers: tags, evaluation cases, labels and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline import schemas
from treeline.functions.text import strip
from treeline.operators.datasets import with_default_grading
from treeline.operators.symbols import valid_tags


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file (its name), line (from 1 in its file) and ord (over all files, in the order of their paths).

    Files are split as usual. Rows of a split are numbered where they are read; the lines of all
    splits are counted, and running sums over one row a split give the lines before each.
    """
    place = F.monotonically_increasing_id().alias("place")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), place)
    splits = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select(
        F.col("path").alias("_path"), F.col("block").alias("_block"), "first",
        before(W.partitionBy("path").orderBy("block")).alias("in_file"),
        before(W.partitionBy(F.lit(0)).orderBy("path", "block")).alias("in_all"),
    )
    rows = lines.join(splits, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")))
    here = F.col("place") - F.col("first") + 1
    return rows.select(
        "value", F.element_at(F.split("path", "/"), -1).alias("file"),
        (F.col("in_file") + here).alias("line"), (F.col("in_all") + here).alias("ord"),
    )


def _checked_json(lines: DataFrame) -> Column:
    """The JSON text of a line; a line that is none fails with its file and number."""
    where = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(": not JSON: "), F.substring("value", 1, 100))
    return F.when(F.try_parse_json("value").isNull(), F.raise_error(where).cast("string")).otherwise(F.col("value"))


def _records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """`r` per JSON line and its place `ord`; blank and `#` lines are skipped, a bad line fails the read."""
    lines = numbered_lines(spark, path).withColumn("value", strip(F.col("value")))
    kept = lines.filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    return kept.select(F.from_json(_checked_json(kept), schema, {"mode": "FAILFAST"}).alias("r"), "ord")


def read_tags(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Symbol definitions from a tag generator's JSON lines, files relative to the repository at `root`.

    A line that is no JSON fails the load with its file and number; a record with a field of
    another type loses that field, and so is dropped if it needs it.
    """
    lines = numbered_lines(spark, path).filter(strip(F.col("value")) != "")
    return valid_tags(lines.select(F.from_json(_checked_json(lines), schemas.TAG).alias("r")).select("r.*"), root)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases in file order (`ord`, the line), with default grading where none is given."""
    cases = _records(spark, path, schemas.CASE).select("r.*", "ord")
    order = [c for c in cases.columns if c != "ord"]
    return with_default_grading(cases).select(*dict.fromkeys([*order, "grading", "ord"]))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return _records(spark, path, schemas.LABEL).select("r.*")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Run traces, one JSON document per file, with the file name; unreadable ones are dropped."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    parsed = F.from_json("value", schemas.TRACE + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return (
        raw.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("run_file"), parsed.alias("r"))
        .filter("r._corrupt IS NULL")
        .select("run_file", "r.*")
        .drop("_corrupt")
    )


def usable_answers(traces: DataFrame) -> DataFrame:
    """Per case the first completed non-empty answer in file order, else the first answer."""
    answer = F.coalesce("answer", F.lit(""))
    worse = ~((F.col("status") == "completed") & (answer != ""))
    order = F.struct(F.coalesce(worse, F.lit(True)), F.col("run_file"))
    return traces.groupBy("case_id").agg(F.min_by(answer, order).alias("answer"))
