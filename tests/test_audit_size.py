"""What the registered audit queries exchange as the log grows."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")

NAMES = [
    "a17_join_not_inner",
    "a14_offset_sensitive",
    "a18_join_on_invalid",
    "a19_join_on_sensitive",
    "a26_first_verdict",
    "a15_limit_required",
    "a22_sensitive_select_expr",
    "a12_param_non_sensitive",
    "a24_scope_param_scope_mismatch",
    "a13_distinct_sensitive",
    "a28_audit_summary",
    "a16_limit_exceeds",
    "a25_param_unused",
    "a24_metadata_param_no_scope",
    "a23_sensitive_loc",
    "a21_sensitive_cmp",
]


@pytest.mark.parametrize("name", NAMES)
def test_no_node_is_sent_by_name(spark, name):
    """Without help by the sizes that Spark measures as it runs: the plan itself keeps nodes where their query is."""
    plan = entry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    exchanges = [line for line in plan.splitlines() if "Exchange hash" in line]
    assert joins and exchanges
    assert not [line for line in joins + exchanges if "lower(" in line]
