"""Arrow batches that go back to Spark with columns added or replaced."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T


def schema_with(schema: T.StructType, added: str) -> T.StructType:
    """``schema`` with the columns ``added`` (as text) in place of columns of their names."""
    new = T.StructType.fromDDL(added)
    names = {f.name for f in new.fields}
    return T.StructType([f for f in schema.fields if f.name not in names] + new.fields)


def replace_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    own = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in columns}
    return pa.RecordBatch.from_arrays([*own.values(), *columns.values()], [*own, *columns])
