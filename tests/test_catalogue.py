"""Every registered query of the reference's operators runs; those with SQL give the same rows."""

import pytest

from millrace.plans.catalogue import ORACLES, QUERIES
from tests.compare import both


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    mine, theirs = both(spark, sf_dir, QUERIES[name], ORACLES[name])
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    made = QUERIES[name](spark, sf_dir)
    assert made.columns
    made.count()


def test_entry(spark):
    import __spark_entry__

    made = __spark_entry__.entry(spark)
    assert made.columns == ["information_cd", "shop_id", "row_id", "created_at", "score", "area"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
