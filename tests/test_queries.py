"""Every registered query of the library's own operators against its SQL twin; those without one by their properties elsewhere."""

import compare
import pytest

from tidemark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    compare.check(spark, registry.QUERIES[name], registry.SQL[name])


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert all(f.__name__ == n for n, f in registry.QUERIES.items())
