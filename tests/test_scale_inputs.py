"""Input files are written from one derivation of the ledger, and wide row logic runs compiled."""

import pytest

from conftest import SF_SMALL


@pytest.mark.parametrize("name", ["first_row_fields", "scan_recursive_window"])
def test_ledger_is_derived_once(spark, monkeypatch, name):
    from tallyspark.plans import catalog, fixtures as FX, registry  # noqa: F401
    derived = spark.sparkContext.accumulator(0)
    rows = [(str(k * 100000 + k), f"INV-{k}", f"V{k}", "2001-07-20", "10.50") for k in range(400)]
    schema = "InvID string, PurchaseInvNo string, PartyName string, PurchaseInvDate string, Total string"
    counted = spark.sparkContext.parallelize(rows, 2).map(lambda r: (derived.add(1), r)[1])
    monkeypatch.setattr(FX, "ledger", lambda spark, sf: spark.createDataFrame(counted, schema))
    got = registry.QUERIES[name](spark, "none").collect()
    assert len(got) == (4 if name == "first_row_fields" else 400)
    assert derived.value == 400


def test_registered_queries_keep_methods_short(spark):
    from tallyspark.plans import catalog, registry  # noqa: F401
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    registry.QUERIES["status_summary"](spark, SF_SMALL)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_small_measured_sides_are_broadcast_and_stages_have_several_tasks_a_core(spark):
    from tallyspark.plans import catalog, registry  # noqa: F401
    registry.QUERIES["status_summary"](spark, SF_SMALL)
    assert int(spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold")) == 64 << 20
    for name in ("spark.sql.adaptive.coalescePartitions.minPartitionNum", "spark.sql.files.minPartitionNum"):
        assert int(spark.conf.get(name)) == 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["scan", "scan_workbook"])
def test_ledger_of_mixed_files_is_derived_once(spark, monkeypatch, name):
    import datetime as dt
    from tallyspark.plans import catalog, fixtures as FX, registry  # noqa: F401
    derived = spark.sparkContext.accumulator(0)

    def counted(rows, schema):
        return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(lambda r: (derived.add(1), r)[1]), schema)

    led = [(str(k * 100000 + k), f"INV-{k}", f"V{k}", "2001-07-20", "10.50") for k in range(200)]
    inv = [(k * 100000 + k, k, dt.date(2001, 7, 20)) for k in range(200)]
    monkeypatch.setattr(FX, "ledger", lambda spark, sf: counted(led, "InvID string, PurchaseInvNo string, PartyName string, PurchaseInvDate string, Total string"))
    monkeypatch.setattr(FX, "invoices", lambda spark, sf: counted(inv, "invoice_id long, order_key long, order_date date"))
    assert len(registry.QUERIES[name](spark, "none").collect()) == 200 and derived.value == (200 if name == "scan" else 400)
