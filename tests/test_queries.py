"""Every query with SQL agrees with DuckDB on the smallest tables."""

import pytest

from framegrid.plans import boxes, control, crops, evaluation, files, keying, matte, more, motion, partials, service  # noqa: F401
from framegrid.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, same):
    same(QUERIES[name], ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
