"""Written tables, the folder that they go to, and broadcast checks."""

import pathlib

import pytest
from pyspark.sql import functions as F, types as T

from evenhand.operators import prepare, sizes


class _Context:
    def __init__(self, master):
        self.master, self.applicationId = master, f"test-{master}"

    def getCheckpointDir(self):
        return None


class _Session:
    def __init__(self, master, folder=None):
        self.sparkContext = _Context(master)
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: folder)})()


def test_only_a_local_process_gets_a_folder_of_its_own():
    assert sizes.shared_folder(_Session("local[4]")) == sizes.shared_folder(_Session("local[4]"))
    assert sizes.shared_folder(_Session("yarn", "s3a://bucket/shared")) == "s3a://bucket/shared"
    for master in ("local-cluster[3,2,1024]", "yarn", "spark://host:7077"):
        with pytest.raises(RuntimeError):
            sizes.shared_folder(_Session(master))


def test_tables_of_a_block_are_deleted(spark):
    with sizes.written_tables(spark):
        kept = sizes.cut_lineage(spark.range(5))
        path = pathlib.Path(kept.inputFiles()[0].removeprefix("file:").removeprefix("//")).parent
        assert kept.count() == 5 and path.exists()
    assert not path.exists()


def test_broadcast_is_by_bytes(spark):
    narrow = spark.range(10)
    wide = narrow.withColumn("q", F.array(F.lit(0.0)))
    assert sizes.row_bytes(wide.schema) > 60 * 8 and sizes.row_bytes(T.StringType()) == sizes.TEXT_BYTES

    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    rows = 200_000
    assert hinted(sizes.small_side(narrow, rows)) and not hinted(sizes.small_side(wide, rows))
    assert hinted(sizes.small_side(narrow)) and not hinted(sizes.small_side(narrow, limit=100))


def test_resolved_columns(spark):
    def found(columns, *candidates):
        return prepare.resolve_column(spark.createDataFrame([], ", ".join(f"`{c}` int" for c in columns)), *candidates)

    assert found(["AGE_group", " age "], "age") == " age "
    assert found(["y2", "default", "Y"], "Y", "default") == "Y"
    assert found(["my_default", "other_y"], "y", "default") == "my_default"
    assert found(["z", "b_sex", "sex_b"], "sex") == "b_sex"
    with pytest.raises(KeyError):
        found(["a"], "b")
