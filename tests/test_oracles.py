"""Every query with SQL gives the SQL's rows on the smallest tables."""

import pytest

from burstlake.plans import registry

SF = "/root/testdata/sf0.001"


def rows(frame):
    columns = sorted(frame.columns)
    plain = [[None if v is None or v != v else float(v) if not isinstance(v, (str, bool)) and hasattr(v, "__float__") else v for v in frame[c].astype(object)] for c in columns]
    return columns, sorted(zip(*plain), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, tables, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), tables(SF).execute(registry.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
