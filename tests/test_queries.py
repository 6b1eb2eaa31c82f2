"""Every query of the engine against its SQL, on the smallest tables."""

import pytest

from tessera.plans import inputs, interactions, oracles, queries
from tests.compare import DATA, same

SMALL = str(DATA / "sf0.001")
QUERIES, ORACLE = queries.QUERIES | inputs.QUERIES | interactions.QUERIES, oracles.ORACLE | inputs.ORACLE | interactions.ORACLE


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLE:
        same(df, ORACLE[name], SMALL)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["game_id", "item_idx", "phi"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
