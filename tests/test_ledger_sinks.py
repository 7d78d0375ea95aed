"""Run ledger maintenance and sinks (T25/T26/T29, idempotence, bundling)."""
import datetime as dt

from pyspark.sql import functions as F

from tallyspark.operators import ledger as L
from tallyspark.operators import sinks as SK
from tallyspark.session import scratch_path

from conftest import rows

D = lambda d: dt.date(2024, 1, d)


def runs(spark):
    return spark.createDataFrame([(1, D(2), D(5), D(5), "a", False, None), (2, D(8), D(11), D(11), "b", False, None)],
                                 "id long, start_date date, end_date date, run_date date, run_type string, "
                                 "archived boolean, archived_date date")


def test_archive_idempotent_and_purge_total(spark):
    r = runs(spark)
    a1 = L.archive_before(r, "2024-01-06", "2024-01-31", "start_date")
    a2 = L.archive_before(a1, "2024-01-06", "2024-01-31", "start_date")
    assert rows(a1) == rows(a2)
    assert rows(L.active(a1), "id") == [(2,)]
    assert L.purge_archived(a1, "2024-05-01").count() == 1 and L.purge_archived(a1, "2024-02-01").count() == 2


def test_retention_boundary(spark):
    df = spark.createDataFrame([(D(1),), (D(2),)], "run_date date")
    assert rows(L.retain_snapshots(df, "2024-01-31", 30)) == [(D(1),), (D(2),)]     # T29: 30 days back kept
    assert rows(L.retain_snapshots(df, "2024-02-01", 30)) == [(D(2),)]


def test_run_bounds_fallback(spark):
    r = runs(spark)
    b = L.run_bounds(r, r).first()
    assert b["last_run_source"] == "run_windows" and b["last_run_date"] == D(11)
    b2 = L.run_bounds(r.withColumn("archived", F.lit(True)), r.withColumnRenamed("run_date", "x")).first()
    assert b2["last_run_source"] == "run_log" and b2["last_run_date"] == D(11)         # T25


def test_upsert_keeps_newest(spark):
    s = ("id long, start_date date, end_date date, run_date date, run_type string, cumulative_start date, "
         "cumulative_end date, total_days_validated int, archived boolean, archived_date date, created_at timestamp")
    a = spark.createDataFrame([(1, D(1), D(2), D(2), "x", D(1), D(2), 1, False, None, dt.datetime(2024, 1, 2, 1))], s)
    b = spark.createDataFrame([(2, D(1), D(2), D(2), "y", D(1), D(2), 1, False, None, dt.datetime(2024, 1, 2, 5))], s)
    assert rows(L.upsert_run_windows(a, b), "id", "run_type") == [(2, "y")]


def test_bundles(spark):
    files = spark.createDataFrame([("m", "a", 5), ("m", "b", 7), ("m", "c", 2), ("n", "a", 4)],
                                  "batch string, name string, size long")
    assert rows(SK.bundle_stop(files, "batch", "name", "size", 10), "batch", "name") == [("m", "a"), ("n", "a")]
    assert rows(SK.bundle_skip(files, "batch", "name", "size", 10), "batch", "name") == [("m", "a"), ("m", "c"), ("n", "a")]


def test_snapshot_save_replaces_partition(spark):
    path = scratch_path(spark, "snap-test")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "InvID long, v string")
    SK.save_snapshot(df, path, "2024-01-02", ["InvID"])
    SK.save_snapshot(df.withColumn("InvID", F.lit(None).cast("long")), path, "2024-01-03", ["InvID", "absent"])
    stored, meta = SK.save_snapshot(df.limit(1), path, "2024-01-02", ["InvID"])
    got = {str(r["run_date"]): (r["rows"], r["non_null"], r["detected_keys"]) for r in meta.collect()}
    assert stored.count() == 3
    assert got == {"2024-01-02": (1, {"InvID": 1}, ["InvID"]), "2024-01-03": (2, {"InvID": 0}, []), "None": (3, {"InvID": 1}, [])}


def test_status_sheets_and_summary(spark):
    df = spark.createDataFrame([("valid", 10.0, "A"), ("VALID", 20.5, "A"), ("odd", None, "B"), (None, 1.0, None), ("FLAGGED", 3.0, "B")],
                               "Status string, Amount double, Vendor string")
    sheets = SK.write_status_sheets(df, scratch_path(spark, "sheets"), vendor="Vendor")
    assert {k: v.count() for k, v in sheets.items() if k != "SUMMARY"} == {"ALL": 5, "VALID": 2, "INVALID": 0, "FLAGGED": 1, "UNKNOWN": 2}
    lines = dict(rows(sheets["SUMMARY"]))
    assert lines["Valid Records"] == "2 (40.0%)" and lines["Total Amount"] == "₹34.50" and lines["Median Amount"] == "₹6.50"
    assert lines["Top Vendor"] == "A" and lines["Unique Vendors"] == "2"
    empty = SK.write_status_sheets(df.limit(0), scratch_path(spark, "sheets"), vendor="Vendor")
    assert dict(rows(empty["SUMMARY"]))["Valid Records"] == "0 (0%)" and empty["ALL"].count() == 0


def test_validation_report_is_newest_first(spark):
    df = spark.createDataFrame([(i, "bad" if i % 3 == 0 else None, dt.datetime(2024, 1, 1 + i * 7 % 28)) for i in range(30)],
                               "n int, discrepancies string, created_at timestamp")
    every, some, n = SK.write_validation_report(df, scratch_path(spark, "report"))
    for out, size in ((every, 30), (some, 10)):
        times = [r["created_at"] for r in out.collect()]
        assert len(times) == size and times == sorted(times, reverse=True)
    assert n == {"rows": 30, "discrepancies": 10}


def test_validation_report_is_dealt_for_its_order_only(spark, monkeypatch):
    plans, replace = [], SK.VersionedTable.replace
    monkeypatch.setattr(SK.VersionedTable, "replace", lambda self, rows: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), replace(self, rows))[1])
    df = spark.createDataFrame([(i, "bad" if i % 3 == 0 else None, dt.datetime(2024, 1, 1 + i * 7 % 28)) for i in range(40)],
                               "n int, discrepancies string, created_at timestamp").repartition(2)
    every, some, n = SK.write_validation_report(df, scratch_path(spark, "report"), ordered=False)
    assert "rangepartitioning" not in plans[0] and n == {"rows": 40, "discrepancies": 14}
    for out, size in ((every, 40), (some, 14)):
        assert out.count() == size and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    files = {}
    for r in every.selectExpr("_metadata.file_path AS f", "created_at").collect():
        files.setdefault(r["f"], []).append(r["created_at"])
    assert all(times == sorted(times, reverse=True) for times in files.values())
