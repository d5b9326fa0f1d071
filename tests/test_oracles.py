"""Every registered query against its SQL counterpart, at the smallest scale."""

import re

import pytest
from check_oracles import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"f13_round_driver"}))
def test_returns_rows(spark, sf_dir, name):
    first = QUERIES[name](spark, sf_dir)
    assert first.count() > 0
    assert len(set(first.columns)) == len(first.columns)


def test_entry_is_lazy_and_stable(spark):
    df = entry.entry(spark)
    assert df.columns == ["client_id", "n", "accuracy", "f1", "eo_gap", "dp_gap", "eod_gap"]
    assert df.count() == 5


def test_names_and_coverage():
    assert set(ORACLES) <= set(QUERIES)
    rows = {m.group(1) for name in QUERIES if (m := re.match(r"([a-z]\d+)_", name))}
    expected = {f"b{i}" for i in range(2, 21)} - {"b18"}
    expected |= {"a9", "a10"} | {f"c{i}" for i in range(1, 6)} | {f"d{i}" for i in range(1, 16)}
    expected |= {f"e{i}" for i in range(1, 12)} - {"e8"}
    expected |= {f"f{i}" for i in range(1, 14)} | {f"g{i}" for i in range(1, 14)} | {f"h{i}" for i in range(1, 17)}
    assert expected <= rows
