"""Every registered query against its independent SQL (DuckDB) on the small tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from ledgerlens.plans.registry import load_all
from ledgerlens.plans.verify import compare, duck_connection

from conftest import SF_SMALL

NAMES = sorted(load_all())


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_SMALL)


def test_every_query_has_a_sql_check():
    assert all(e.sql for e in load_all().values())
    assert set(NAMES) <= set(queries()) and set(NAMES) <= set(oracle_sql())


def test_registry_covers_survey_ids():
    ids = {i for e in load_all().values() for i in e.ids}
    expected = ({f"C{i:02d}" for i in (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14, 15, 16,
                                       17, 18, 19, 20, 21, 22)}
                | {f"E{i:02d}" for i in range(1, 33)} | {f"I{i:02d}" for i in range(1, 22)}
                | {f"P{i:02d}" for i in range(1, 22)} | {f"R{i:02d}" for i in range(1, 8)}
                | {"X01", "X02", "X03", "X04"})
    assert expected <= ids


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = queries()[name](spark, SF_SMALL)
    assert compare(df, con, oracle_sql()[name]) == []


def test_entry_runs(spark):
    df = entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns == ["rank", "region", "category", "sub_category", "disc_bucket",
                          "total_loss", "raw_loss"]
