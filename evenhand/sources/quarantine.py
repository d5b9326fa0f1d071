"""Scans that lose no record: what does not fit the schema is listed with its file, its place in it and the reason.

Every record of the input is either one of ``rows`` or one of ``rejected`` (file, record, reason, content). ``record`` counts the lines of a
file that are not blank from 1, header lines included, and does not depend on how files are split into tasks. Reasons are ``width: 3 of 5``
(fields found and wanted), ``type: age, hours`` (columns whose text is not of their type), ``not JSON``, ``no run`` and ``unreadable``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from evenhand.operators.sizes import small_side
from evenhand.sources import readers, schemas

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Checked:
    """Records that fit, as the reader of the same name gives them, and all others."""

    rows: DataFrame
    rejected: DataFrame


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, record, value): the lines of text files that are not blank, with their number.

    A line's number is its place within the part of the file that its task reads, on top of the lines in the parts before.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select("value", *where).where(F.col("value").rlike(r"[^\x00-\x20]"))
    placed = lines.withColumn("at", F.monotonically_increasing_id())
    sizes = placed.groupBy("file", "block").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    # A row for each part of a file; beyond a broadcast, lines are shuffled by their part.
    starts = small_side(sizes.select("file", "block", "start", before))
    record = F.col("before") + F.col("at") - F.col("start") + 1
    return placed.join(starts, ["file", "block"]).select("file", record.alias("record"), "value")


def checked_lines(lines: DataFrame, schema: str, **options: str) -> Checked:
    """CSV lines (file, record, value) against a schema, with the options of a CSV scan."""
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    settings = {"columnNameOfCorruptRecord": CORRUPT, **options}
    as_text = ", ".join(f"`c{i}` STRING" for i in range(len(names)))
    row = F.from_csv("value", f"{schema}, {CORRUPT} STRING", settings)
    read = lines.select("file", "record", "value", row.alias("row"))
    fits = F.col("row").getField(CORRUPT).isNull()
    rows = read.where(fits).select(*[F.col("row").getField(n).alias(n) for n in names])

    outside_quotes = F.regexp_replace("value", r'"(?:[^"\\]|\\.)*"', "")
    fields = F.size(F.split(outside_quotes, ","))
    wrong = [F.when(F.col("text").getField(f"c{i}").isNotNull() & F.col("row").getField(n).isNull(), F.lit(n)) for i, n in enumerate(names)]
    columns = F.array_compact(F.array(*wrong))
    reason = (
        F.when(fields != len(names), F.concat(F.lit("width: "), fields.cast("string"), F.lit(f" of {len(names)}")))
        .when(F.size(columns) > 0, F.concat(F.lit("type: "), F.array_join(columns, ", ")))
        .otherwise(F.lit("unreadable"))
    )
    failed = read.where(~fits).withColumn("text", F.from_csv("value", f"{as_text}, {CORRUPT} STRING", settings))
    return Checked(rows, failed.select("file", "record", reason.alias("reason"), F.col("value").alias("content")))


def header_csv(spark: SparkSession, path: str, schema: str) -> Checked:
    """``readers.header_csv``: a header line, columns by position."""
    return checked_lines(numbered_lines(spark, path).where("record > 1"), schema)


def _text_schema(names: Sequence[str]) -> str:
    return ", ".join(f"`{n.strip()}` STRING" for n in names)


def text_columns(spark: SparkSession, path: str) -> Checked:
    """``readers.text_columns``: the header names the columns, all are text; only the width can be wrong."""
    return header_csv(spark, path, _text_schema(readers.header_names(spark, path)))


def described_csv(spark: SparkSession, path: str, marker: str = "LIMIT_BAL") -> Checked:
    """``readers.described_csv``: the header may stand below one descriptive line."""
    names, top = readers.described_header(spark, path, marker)
    return checked_lines(numbered_lines(spark, path).where(F.col("record") > top), _text_schema(names))


def adult_files(spark: SparkSession, folder: str) -> tuple[Checked, Checked]:
    """``readers.adult_files``: the banner of the test file, a first line of one field, is no record."""
    banner = (F.col("record") == 1) & ~F.contains("value", F.lit(","))
    lines = {name: numbered_lines(spark, f"{folder}/{name}") for name in ("adult.data", "adult.test")}
    options = {"nullValue": "?", "ignoreLeadingWhiteSpace": "true"}
    return (
        checked_lines(lines["adult.data"], schemas.ADULT, **options),
        checked_lines(lines["adult.test"].where(~banner), schemas.ADULT, **options),
    )


def run_results(spark: SparkSession, glob: str, prefix: str = "draft_results_") -> Checked:
    """``readers.run_results``: a file is a record, one without a byte none; the content of what is no run is kept whole."""
    files = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    settings = {"columnNameOfCorruptRecord": CORRUPT}
    read = files.withColumn("row", F.from_json("value", f"{schemas.RUN}, {CORRUPT} STRING", settings))
    broken = F.col("row").isNull() | F.col("row").getField(CORRUPT).isNotNull()
    filled = F.col("row.dataset").isNotNull() | F.col("row.pipeline").isNotNull() | F.col("row.round_logs").isNotNull()
    names = [f.name for f in T.StructType.fromDDL(schemas.RUN).fields]
    label = readers.run_label(F.element_at(F.split("file", "/"), -1), prefix)
    rows = read.where(~broken & filled).select(*[F.col("row").getField(n).alias(n) for n in names], label.alias("label"))
    reason = F.when(broken, F.lit("not JSON")).otherwise(F.lit("no run"))
    rejected = read.where(broken | ~filled).select("file", F.lit(1).cast("bigint").alias("record"), reason.alias("reason"), F.col("value").alias("content"))
    return Checked(rows, rejected)
