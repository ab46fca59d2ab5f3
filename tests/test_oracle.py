"""Every registered query with an oracle must equal its DuckDB SQL at sf0.001
(row count, column names, types and an order-insensitive value hash)."""

import duckdb
import pytest

import __spark_entry__ as E
from evalframe.sources.tables import TABLES
from tests.conftest import SF_SMALL
from tools.oracle_check import SPARK_TO_DUCK, digest

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.execute(ORACLES[name])
    drows = rel.fetchall()
    dcols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(dcols)
    st = {c: SPARK_TO_DUCK.get(t, t) for c, t in sdf.dtypes}
    dt = {d[0]: str(d[1]) for d in rel.description}
    assert st == dt
    assert len(srows) == len(drows)
    assert digest(srows, sdf.columns)[0] == digest(drows, dcols)[0]


def test_every_query_has_a_callable():
    qs = E.queries()
    assert set(ORACLES) <= set(qs)
    assert len(qs) >= 60
