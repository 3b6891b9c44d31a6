"""Every query that SQL can express, against DuckDB; the others give rows."""

import pytest
from conftest import same

import __spark_entry__ as entry

OWN = {name: q for m in entry.MODULES for name, q in m.QUERIES.items()}


@pytest.mark.parametrize("name", [n for n, (_, sql) in OWN.items() if sql])
def test_against_sql(spark, small, duck, name):
    run, sql = OWN[name]
    assert same(run(spark, small).toPandas(), duck.execute(sql).df())


@pytest.mark.parametrize("name", [n for n, (_, sql) in OWN.items() if not sql])
def test_runs(spark, small, name):
    assert OWN[name][0](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
