"""Every query runs; those with SQL agree with it on the smallest tables."""

import pytest

import __spark_entry__ as entry
from strandline.plans.oracles import SQL
from strandline.plans.queries import QUERIES
from tests.compare import duck, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name in SQL:
        wanted = duck(sf_dir, SQL[name])
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)
    else:
        assert len(found.columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
