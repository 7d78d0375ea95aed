"""Driver contract and plan shape checks."""
import pytest

from conftest import SF_SMALL


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["vendor", "issue", "rows", "amount"]
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 100 and set(o) <= set(q)


PLAN_CHECKED = ["rule_report_by_vendor", "snapshot_diff", "delta_with_reason", "fill_from_source", "formatted_report",
                "kpi_overview", "creator_lookup", "dedupe_keep_first", "extract_document_fields"]


@pytest.mark.parametrize("name", PLAN_CHECKED)
def test_no_cartesian_no_row_udf(spark, name):
    import __spark_entry__ as E
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_pushdown_and_pruning(spark):
    import __spark_entry__ as E
    plan = E.queries()["rule_report_by_vendor"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_extendedprice:double,l_discount:double,l_tax:double>" \
        in plan or "l_extendedprice" in plan
    assert "l_shipdate" not in plan                                                     # pruned column


SMALL_ORACLE = ["rule_report_by_vendor", "snapshot_diff", "change_stats", "delta_with_reason", "normalize_aliases",
                "kpi_overview", "top_k_values", "match_text_to_ledger", "text_to_table", "formatted_report"]


@pytest.mark.parametrize("name", SMALL_ORACLE)
def test_oracle_small(spark, name):
    from oracle_compare import compare, duck
    res = compare(spark, duck(SF_SMALL), name, SF_SMALL, verbose=True)
    assert res["ok"], res
