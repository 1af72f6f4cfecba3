"""Every query of the catalogue against DuckDB."""

import pytest
from conftest import SF, same

from docweave.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    same(catalogue.queries()[name](spark, SF), duck, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry_module(spark):
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["layout_lines", "nearest_next_row"])
def test_tokens_of_orders_are_moved_once(spark, name):
    """They are numbered and nested by the same key, and boxes are made after the move."""
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
