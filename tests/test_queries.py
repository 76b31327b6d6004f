"""Every registered query of the engine against its SQL in DuckDB, or for rows at least."""

import pytest

from sedge import plans
from tests.compare import connect, rows
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in plans.ORACLES:
        assert got
        return
    result = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want


def test_every_query_has_an_oracle():
    """But for the one that folds code, which tests/test_whole.py has."""
    assert set(plans.QUERIES) - set(plans.ORACLES) == {"compression_ratio"}
