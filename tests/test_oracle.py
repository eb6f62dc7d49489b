"""Every query with an oracle matches DuckDB on the tiny scale factor (the driver runs the
same comparison at sf0.01; tests/oracle_harness.py runs it on any scale)."""

import pytest

from conftest import SF_TINY
from oracle_harness import canon, duck

import __spark_entry__ as E

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_TINY)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF_TINY).toPandas()
    dk = con.sql(ORACLE[name]).df()
    c1, r1 = canon(sp)
    c2, r2 = canon(dk)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2
