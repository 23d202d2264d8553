"""Every query with an oracle must equal its DuckDB SQL on the same tables."""

import pytest

from _oracle import canonical, connect
from conftest import SF_SMALL
from tessera.plans import catalog
from tessera.plans import training  # noqa: F401 - registers the model queries

ORACLES = catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(ORACLES[name])
    ocols, orows = rel.columns, rel.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert canonical(df.columns, srows) == canonical(ocols, orows)
