"""A spread of registered queries against their SQL on the smallest tables."""
import pytest

import __spark_entry__ as entry
from opsloom.checks.compare import compare, connect

NAMES = ["ledger_summary", "category_breakdown", "commit_rows", "categorize", "classify_kind", "merchant_outliers", "alert_suppression", "counter_rate",
         "corpus_scan", "filters_export", "question_intent", "merge_catalogs", "plan_conflicts", "library_inventory", "statement_rows"]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    ok, message, *_ = compare(spark, con, sf, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_entry_and_keys(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
