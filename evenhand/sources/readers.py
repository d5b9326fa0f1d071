"""Scans of the raw tables and of run results. Schemas are given, never inferred."""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenhand.sources import ledger, schemas


def header_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line; columns are matched by position with the schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def text_columns(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV with the columns its own header names, all as text."""
    return _named_text(spark, path, header_names(spark, path), skip=1)


def header_names(spark: SparkSession, path: str) -> list[str]:
    """The fields of the first line."""
    return _fields(_first_lines(spark, path, 1)[0])


def _first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    return [row.value for row in spark.read.text(path).limit(n).collect()]


def _fields(line: str) -> list[str]:
    return next(csv.reader([line]))


def _named_text(spark: SparkSession, path: str, names: Sequence[str], skip: int) -> DataFrame:
    schema = ", ".join(f"`{n.strip()}` STRING" for n in names)
    if skip == 1:
        return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    # A line above the header: both are lines of the file like any other, known by their text.
    top = _first_lines(spark, path, skip)
    rows = spark.read.schema(schema).option("header", False).csv(path)
    for line in top:
        cells = _fields(line)
        same = F.lit(True)
        for name, cell in zip(rows.columns, cells):
            same = same & F.col(f"`{name}`").eqNullSafe(F.lit(cell if cell != "" else None))
        rows = rows.filter(~same)
    return rows


def described_csv(spark: SparkSession, path: str, marker: str = "LIMIT_BAL") -> DataFrame:
    """CSV whose header may stand below one descriptive line: the header is the line with ``marker``."""
    names, top = described_header(spark, path, marker)
    return _named_text(spark, path, names, skip=top)


def described_header(spark: SparkSession, path: str, marker: str) -> tuple[list[str], int]:
    """The fields of the header of such a file, and the number of lines down to it."""
    lines = _first_lines(spark, path, 2)
    first = _fields(lines[0])
    if marker in [c.strip() for c in first] or len(first) <= 1:
        return first, 1
    return _fields(lines[1]), 2


def adult_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Training and test file of the census table: no header, '?' is null, blanks behind commas, and a
    banner line (one field only, so its second column is null) on top of the test file."""
    def read(name: str) -> DataFrame:
        return (
            spark.read.schema(schemas.ADULT)
            .option("header", False)
            .option("nullValue", "?")
            .option("ignoreLeadingWhiteSpace", True)
            .csv(f"{folder}/{name}")
        )

    banner = F.col("education").isNull() & F.col("income").isNull() & F.col("fnlwgt").isNull()
    return read("adult.data"), read("adult.test").filter(~banner)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob has a file, on whatever file system it names."""
    return len(matching_files(spark, path)) > 0


def matching_files(spark: SparkSession, glob: str) -> list[str]:
    """Sorted files behind a glob."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(glob)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(target)
    return sorted(s.getPath().toString() for s in found) if found else []


def first_source(spark: SparkSession, sources: Sequence[tuple[Sequence[str], Callable[..., Any]]]) -> Any:
    """Read the first source whose paths all exist: ``[((glob, ...), reader)]`` in order of priority.

    A reader takes the session and, for each glob, the first file in sorted order that it names.
    """
    for globs, reader in sources:
        found = [matching_files(spark, glob) for glob in globs]
        if all(found):
            return reader(spark, *[files[0] for files in found])
    raise FileNotFoundError("none of " + ", ".join(glob for globs, _ in sources for glob in globs))


def run_results(spark: SparkSession, glob: str, prefix: str = "draft_results_") -> DataFrame:
    """Nested run results, one JSON document per file; files that cannot be read, and empty documents,
    are left out. ``label`` is the file name without its prefix and extension.
    """
    raw = (
        spark.read.schema(schemas.RUN + ", _corrupt_record STRING")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .json(glob)
    )
    name = run_label(F.col("_metadata.file_name"), prefix)
    # Spark wants a parsed column beside the corrupt one, even where only rows are counted.
    filled = F.col("dataset").isNotNull() | F.col("pipeline").isNotNull() | F.col("round_logs").isNotNull()
    return raw.withColumn("label", name).filter(F.col("_corrupt_record").isNull() & filled).drop("_corrupt_record")


def run_label(file_name: Column, prefix: str) -> Column:
    """A file name without the prefix and its extension."""
    return F.regexp_extract(file_name, rf"^(?:{prefix})?(.*?)(?:\.json)?$", 1)


def written_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs that ``writers.write_runs`` committed: the latest of each dataset and label."""
    return ledger.latest(spark, folder, f"{schemas.RUN}, label STRING", ("dataset", "label"))
