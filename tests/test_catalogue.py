"""Every query against its SQL on the smallest tables; those without SQL must run and give rows."""

import pytest

from nearfield.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, sf, duck, same_rows):
    made = catalogue.queries()[name](spark, sf).toPandas()
    if name in catalogue.oracle_sql():
        want = duck.execute(catalogue.oracle_sql()[name]).df()
        assert sorted(made.columns) == sorted(want.columns)
        assert same_rows(made) == same_rows(want)
    else:
        assert len(made)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 125  # the 25 vectors whose number 20 divides
    assert set(e.oracle_sql()) <= set(e.queries())
