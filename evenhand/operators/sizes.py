"""Size checks before a broadcast, and cutting lineage in a shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Bytes that a broadcast side may hold.
BROADCAST_BYTES = 32 << 20
# What a text, and the number of entries of an array or map, is taken for where only the schema is known.
TEXT_BYTES = 64
ENTRIES = 64
FOLDER_SETTING = "spark.checkpoint.dir"


# Folders made for local sessions that name none, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, else the context's own one.

    A session whose driver is also its only executor gets a temporary folder that goes with the process.
    Anywhere else, local clusters included, that would be a machine-local path, so it is refused.
    """
    context = spark.sparkContext
    folder = spark.conf.get(FOLDER_SETTING, None) or context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError(f"set {FOLDER_SETTING} to a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        folder = _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="evenhand-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _LOCAL_FOLDERS[context.applicationId]


# Tables written since the innermost ``written_tables`` began.
_WRITTEN: list[list[str]] = []


@contextmanager
def written_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are written inside the block when it ends; its results must not need them any more."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _WRITTEN.pop():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def _bytes(size: str) -> int:
    """A size setting in bytes: a number, or one with a unit such as 128m or 134217728b."""
    text = size.strip().lower().removesuffix("b")
    unit = {"k": 2**10, "m": 2**20, "g": 2**30}.get(text[-1:], 1)
    return int(text.rstrip("kmg")) * unit


def cut_lineage(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from there.

    The table survives lost executors, and its size is known to the planner. It stays in the folder,
    as checkpoints do, unless it is written within ``written_tables``. Its row groups are as large as the share of a scan
    task, so that the table can be read with as many tasks as the session wants.
    """
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/evenhand/{uuid.uuid4().hex}"
    share = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    writer = df.write.partitionBy(*partition_by).option("parquet.block.size", _bytes(share))
    writer.parquet(path)
    # Partition columns come back in their own types, not in those guessed from directory names.
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(kind: T.DataType) -> int:
    """About what a value of the type takes."""
    if isinstance(kind, T.StructType):
        return 16 + sum(row_bytes(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return ENTRIES * row_bytes(kind.elementType)
    if isinstance(kind, T.MapType):
        return ENTRIES * (row_bytes(kind.keyType) + row_bytes(kind.valueType))
    return TEXT_BYTES if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def small_side(df: DataFrame, bound: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a join side for broadcast if it is known to hold at most ``limit`` bytes, else leave the join to Spark.

    ``bound`` is a row bound that follows from the arguments of an operator (clients x strata, say).
    Without one the side, always an aggregate, is written once and counted.
    """
    rows = limit // row_bytes(df.schema)
    if bound is not None:
        return F.broadcast(df) if bound <= rows else df
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= rows else kept
