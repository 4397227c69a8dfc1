"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import digest, duck_con, type_mismatches

SF = "/root/testdata/sf0.001"
KEYS = sorted(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck_con(SF)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    sql = E.oracle_sql().get(key)
    df = E.queries()[key](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    if sql is None:
        assert len(srows) >= 0
        return
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert not type_mismatches(df, cur.description)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]
