"""Every registered query at the smallest scale: against its SQL, or its row count."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import connect, difference

ROWS_ONLY = sorted(set(queries()) - set(oracle_sql()))


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, sf, db, name):
    frame = queries()[name](spark, sf)
    assert "CartesianProduct" not in plan(frame) and "NestedLoopJoin" not in plan(frame)
    assert difference(frame, db, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, sf, name):
    frame = queries()[name](spark, sf)
    assert "CartesianProduct" not in plan(frame) and "NestedLoopJoin" not in plan(frame)
    assert frame.count() > 0


def test_scans_read_only_what_they_use(spark, sf):
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan(queries()["class_balance"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(queries()["duplicate_texts_top100"](spark, sf))
    assert "Expand" not in plan(queries()["categorical_columns"](spark, sf))


def test_entry(spark):
    row = entry(spark).first()
    assert 0 <= row["overall_score"] <= 100


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
