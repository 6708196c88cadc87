"""Every query of the catalog against its SQL."""

import pytest
from conftest import rows, sql_rows

from sedgewren import catalog


#: Sequential, hierarchical or parsed: tested against plain loops and written values in test_reports.
WITHOUT_SQL = {"x_replay", "x_boosted", "r_complete_linkage", "e_structure"}


def test_every_other_query_has_sql():
    assert set(catalog.QUERIES) - WITHOUT_SQL == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(name, spark, sf, duck):
    df = catalog.QUERIES[name](spark, sf)
    names, want = sql_rows(duck, catalog.ORACLES[name])
    assert sorted(df.columns) == names
    assert rows(df) == want
