"""Every registered query at the smallest scale against DuckDB."""

import sys

import pytest

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
import check_queries
from sluicework.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check_queries.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    verdict, n = check_queries.compare(spark, SF, name, entry.queries(), entry.oracle_sql(), duck)
    assert verdict == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
