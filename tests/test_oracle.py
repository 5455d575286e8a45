"""Every registered query with SQL must return exactly what its SQL returns (smallest data)."""

import compare
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    found = QUERIES[name](spark, FOLDER)
    assert compare.differences(found, con, SQL[name]) == ""
    assert not found.isEmpty()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["plan_id", "tone", "n"]


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_every_kind_of_duplicate_occurs(spark, folder):
    found = QUERIES["near_duplicates"](spark, folder).groupBy("reason").count().collect()
    assert {r.reason for r in found} == {"same_path", "same_bytes", "near_duplicate"} and all(r["count"] > 0 for r in found)
