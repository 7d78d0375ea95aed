"""Every oracle SQL plans in DuckDB over the driver tables, and names the same columns as
its Spark query (the driver sorts columns by name before hashing values)."""
import pytest

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    from oracle_compare import duck
    return duck(SF_SMALL)


def test_every_oracle_plans(con):
    import __spark_entry__ as E
    bad = {}
    for name, sql in E.oracle_sql().items():
        try:
            con.execute("EXPLAIN " + sql)
        except Exception as e:  # collect all failures
            bad[name] = str(e)[:200]
    assert not bad, bad


def test_oracle_columns_match_spark_schema(spark, con):
    import __spark_entry__ as E
    q = E.queries()
    for name in ["rule_report_by_vendor", "formatted_report", "normalize_aliases", "snapshot_diff", "kpi_overview",
                 "extract_document_fields", "tax_classify", "delta_with_reason"]:
        cols = [d[0] for d in con.execute(E.oracle_sql()[name] + " LIMIT 0").description]
        assert sorted(cols) == sorted(q[name](spark, SF_SMALL).columns), name
