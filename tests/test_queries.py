"""Every registered query against its SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pytest
from parlance.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(columns: dict[str, list]) -> Counter:
    names = sorted(columns)
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in zip(*[columns[n] for n in names], strict=True))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_sql(spark, sf, con, name):
    got = registry.queries()[name](spark, sf).toArrow()
    expected = con.sql(registry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(expected.column_names)
    for n in got.column_names:
        assert str(got.schema.field(n).type).removeprefix("large_") == str(expected.schema.field(n).type).removeprefix("large_"), n
    assert rows(got.to_pydict()) == rows(expected.to_pydict())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 34
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
