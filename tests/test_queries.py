"""Every query with SQL gives the SQL's rows on the small tables."""

import pytest

import lodestrata.plans.analysis_queries  # noqa: F401
import lodestrata.plans.catalogue_queries  # noqa: F401
import lodestrata.plans.detail_queries  # noqa: F401
import lodestrata.plans.incremental_queries  # noqa: F401
import lodestrata.plans.lookup_queries  # noqa: F401
from lodestrata.plans.oracles import ORACLES
from lodestrata.plans.queries import QUERIES
from tests.oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert spark_rows(df) == duck_rows(ORACLES[name], sf_dir, df.columns)


def test_entry_has_rows(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
