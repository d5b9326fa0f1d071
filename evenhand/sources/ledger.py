"""Results in a folder that are replaced by key: a commit appears whole or not at all.

A commit is one distributed write into a hidden folder, which is then renamed to ``commit=N``. N is the next number, and the rename
fails if another writer took it, so commits have an order without clocks, and a killed write leaves nothing that is read. Readers take
every key's row from the latest commit that has it. A repeated or concurrent write of the same key therefore replaces and never
doubles. The file system's rename of a folder has to be atomic, as in HDFS and local ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

STAGED = "_staged"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, folder: str):
    return _path(spark, folder).getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the commits, in order."""
    found = _system(spark, folder).globStatus(_path(spark, f"{folder}/commit=*"))
    return sorted(int(s.getPath().getName().partition("=")[2]) for s in found or [])


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Whether ``source`` became ``target``; False if that was there before."""
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, target).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(_path(spark, source), _path(spark, target), options)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() in ("FileAlreadyExistsException", "DirectoryNotEmptyException"):
            return False
        raise
    return True


def commit(rows: DataFrame, folder: str, keys: Sequence[str]) -> int:
    """Write the rows, one for each key, as one commit; returns its number."""
    spark = rows.sparkSession
    # The scheme, so that both kinds of Hadoop interface mean the same file system.
    folder = _system(spark, folder).makeQualified(_path(spark, folder)).toString()
    staged = f"{folder}/{STAGED}/{uuid.uuid4().hex}"
    rows.write.json(staged)
    written = spark.read.schema(rows.schema).json(staged)
    if not written.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"several rows of one {', '.join(keys)}")
    number = max(commits(spark, folder), default=0) + 1
    while not _renamed(spark, staged, f"{folder}/commit={number}"):
        number += 1
    return number


def latest(spark: SparkSession, folder: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """The latest row of each key; an empty table before the first commit. Rows that were written without commits count as the oldest."""
    system, glob = _system(spark, folder), _path(spark, f"{folder}/[!_.]*")
    if not system.globStatus(glob):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(f"{schema}, commit INT").json(folder)
    columns = [c for c in found.columns if c != "commit"]
    row = F.max_by(F.struct(*columns), F.coalesce("commit", F.lit(-1))).alias("_row")
    ordered = spark.createDataFrame([], schema).columns
    return found.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(row).select("_row.*").select(*ordered)


def compact(spark: SparkSession, folder: str, schema: str, keys: Sequence[str]) -> int:
    """Write the latest rows as one commit, then delete those before it."""
    before = commits(spark, folder)
    number = commit(latest(spark, folder, schema, keys), folder, keys)
    for old in before:
        _system(spark, folder).delete(_path(spark, f"{folder}/commit={old}"), True)
    return number
