"""Registered queries: summaries, KPIs, dashboard filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import sinks as SK
from ..operators import summary as S
from ..session import scratch_path
from . import fixtures as FX
from .registry import query, s_parse_date, s_pct, s_strip

DASH = ("dashboard",)


def s_mode(expr: str, src: str) -> str:
    return f"(SELECT v FROM (SELECT {expr} AS v, count(*) AS n FROM {src} WHERE {expr} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"


@query("invoice_summary", f"""SELECT count(*) AS total_invoices, {len(FX.LEDGER_COLUMNS)} AS columns_count,
  min({s_parse_date('"PurchaseInvDate"')}) AS earliest, max({s_parse_date('"PurchaseInvDate"')}) AS latest,
  sum(TRY_CAST({s_strip('"Total"')} AS DECIMAL(18,2))) AS total_amount,
  round(avg(TRY_CAST({s_strip('"Total"')} AS DECIMAL(18,2))), 2) AS average_amount,
  min(TRY_CAST({s_strip('"Total"')} AS DECIMAL(18,2))) AS min_amount,
  max(TRY_CAST({s_strip('"Total"')} AS DECIMAL(18,2))) AS max_amount FROM ledger""", ("ledger",))
def invoice_summary(spark, sf):
    return S.invoice_summary(FX.ledger(spark, sf), "PurchaseInvDate", "Total")


def _report(spark, sf):
    d = FX.dashboard(spark, sf)
    vs = (F.when(F.col("Validation_Status") == "PASS", F.lit("VALID"))
           .when(F.col("Validation_Status") == "FAIL", F.lit("ERROR")).otherwise(F.lit("ISSUES FOUND")))
    return d.withColumn("Status", X.standardize_status(validation_status=vs))


_REPORT = """(SELECT *, CASE "Validation_Status" WHEN 'PASS' THEN 'VALID' WHEN 'FAIL' THEN 'INVALID' ELSE 'FLAGGED' END
  AS "Status" FROM dashboard)"""


@query("status_summary", f"""SELECT status, count, {s_pct('count', 'sum(count) OVER ()')} AS percent,
  {s_pct("sum(CASE WHEN status = 'VALID' THEN count ELSE 0 END) OVER ()", 'sum(count) OVER ()')} AS success_rate
FROM (SELECT "Status" AS status, count(*) AS count FROM {_REPORT} GROUP BY 1)""", DASH)
def status_summary(spark, sf):
    return S.status_summary(_report(spark, sf))


@query("write_status_sheets", f"""SELECT status, count(*) AS rows, sum("Amount") AS amount FROM (SELECT "Status" AS status, "Amount" FROM {_REPORT}
  UNION ALL SELECT 'ALL', "Amount" FROM {_REPORT}) GROUP BY 1""", DASH)
def write_status_sheets(spark, sf):
    sheets = SK.write_status_sheets(_report(spark, sf), scratch_path(spark, "status_sheets"))
    parts = [sheets[s].select(F.lit(s).alias("status"), "Amount") for s in ("ALL", *SK.STATUSES)]
    return reduce(DataFrame.unionByName, parts).groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.sum("Amount").alias("amount"))


def _share(status: str) -> str:
    return f"""concat(count_if("Status" = '{status}'), ' (', round(CAST(count_if("Status" = '{status}') AS DECIMAL(18,6)) * 100 / count(*), 1), '%)')"""


def _rupees(x: str) -> str:
    return f"'₹' || format('{{:,.2f}}', {x})"


@query("status_sheet_summary", f"""SELECT unnest(['Total Records', 'Valid Records', 'Invalid Records', 'Flagged Records', 'Unknown Status', 'Success Rate',
    'Total Amount', 'Average Amount', 'Median Amount', 'Max Amount', 'Min Amount', 'Unique Vendors', 'Top Vendor']) AS metric,
  unnest([CAST(count(*) AS VARCHAR), {_share('VALID')}, {_share('INVALID')}, {_share('FLAGGED')}, {_share('UNKNOWN')},
    concat(round(CAST(count_if("Status" = 'VALID') AS DECIMAL(18,6)) * 100 / count(*), 1), '%'),
    {_rupees('sum("Amount")')}, {_rupees('round(avg("Amount"), 2)')}, {_rupees('round(median("Amount"), 2)')}, {_rupees('max("Amount")')}, {_rupees('min("Amount")')},
    CAST(count(DISTINCT "Vendor_Name") AS VARCHAR),
    (SELECT "Vendor_Name" FROM dashboard WHERE "Vendor_Name" IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)]) AS value FROM {_REPORT}""", DASH)
def status_sheet_summary(spark, sf):
    return SK.write_status_sheets(_report(spark, sf), scratch_path(spark, "status_sheets"), vendor="Vendor_Name")["SUMMARY"]


@query("amount_stats", """SELECT sum("Amount") AS total_amount, round(avg("Amount"), 2) AS average_amount,
  median(CAST("Amount" AS DOUBLE)) AS median_amount, max("Amount") AS max_amount, min("Amount") AS min_amount FROM dashboard""", DASH)
def amount_stats(spark, sf):
    return S.amount_stats(FX.dashboard(spark, sf), "Amount")


@query("vendor_stats", f"""SELECT count(DISTINCT "PartyName") AS unique_vendors,
  {s_mode('"PartyName"', 'ledger')} AS top_vendor FROM ledger""", ("ledger",))
def vendor_stats(spark, sf):
    return S.vendor_stats(FX.ledger(spark, sf), "PartyName")


_RUN_STATUS = "CASE run_type WHEN 'error' THEN 'INVALID' WHEN 'signup' THEN 'FLAGGED' ELSE 'VALID' END"


@query("trend_by_run", f"""SELECT run_date AS report_date, strftime(run_date, '%Y-%m') AS month, count(*) AS total_records,
  count_if({_RUN_STATUS} = 'VALID') AS valid_records, count_if({_RUN_STATUS} = 'INVALID') AS invalid_records,
  {s_pct(f"count_if({_RUN_STATUS} = 'VALID')", 'count(*)')} AS success_rate FROM runs GROUP BY run_date""", ("runs",))
def trend_by_run(spark, sf):
    r = FX.run_snapshots(spark, sf)
    st = F.when(F.col("run_type") == "error", "INVALID").when(F.col("run_type") == "signup", "FLAGGED").otherwise("VALID")
    return S.trend_by_run(r.withColumn("status", st), "run_date", "status")


@query("status_buckets", """SELECT count_if(contains("Validation_Status", 'PASS')) AS passed,
  count_if(contains("Validation_Status", 'FAIL')) AS failed, count_if(contains("Validation_Status", 'WARNING')) AS warnings
FROM dashboard""", DASH)
def status_buckets(spark, sf):
    return S.status_buckets(FX.dashboard(spark, sf))


_LOCH = """split_part(coalesce("Location", ''), ',', 1)"""
_KPI = f"""SELECT count(*) AS total_invoices, count_if(contains("Validation_Status", 'PASS')) AS passed,
  count_if(contains("Validation_Status", 'WARNING')) AS warnings, count_if(contains("Validation_Status", 'FAIL')) AS failed,
  count(DISTINCT "Invoice_Currency") AS currencies, {s_mode('"Invoice_Currency"', 'dashboard')} AS primary_currency,
  count(DISTINCT {_LOCH}) AS locations, {s_mode(_LOCH, 'dashboard')} AS primary_location,
  count_if("Due_Date_Notification" IN ('YES', 'OVERDUE')) AS urgent_payments,
  count_if(trim(coalesce("Invoice_Creator_Name", '')) NOT IN ('Unknown', '')) AS known_creators FROM dashboard"""


@query("kpi_overview", f"""SELECT *, {s_pct('passed', 'total_invoices')} AS pass_rate,
  {s_pct('warnings', 'total_invoices')} AS warning_rate, {s_pct('failed', 'total_invoices')} AS fail_rate,
  {s_pct('known_creators', 'total_invoices')} AS creator_coverage FROM ({_KPI})""", DASH)
def kpi_overview(spark, sf):
    return S.kpi_overview(FX.dashboard(spark, sf))


def _vc(expr, dim, k=None):
    lim = f" ORDER BY n DESC, value NULLS FIRST LIMIT {k}" if k else ""
    return (f"(SELECT '{dim}' AS dimension, value, n FROM (SELECT CAST({expr} AS VARCHAR) AS value, count(*) AS n "
            f"FROM dashboard GROUP BY 1){lim})")


_GSTC = """CASE WHEN contains(coalesce("GST_Validation_Result", ''), '✅') THEN 'Correct'
  WHEN contains(coalesce("GST_Validation_Result", ''), '❌') THEN 'Error' ELSE 'Warning' END"""


@query("top_k_values", " UNION ALL ".join([
    _vc('"Validation_Status"', "status"), _vc('"Invoice_Currency"', "currency"),
    _vc('"Due_Date_Notification"', "due_alert"), _vc(_GSTC, "gst_class"), _vc(_LOCH, "location", 10),
    _vc('"Invoice_Creator_Name"', "creator", 8)]), DASH)
def top_k_values(spark, sf):
    return S.top_k_values(FX.dashboard(spark, sf))


_FILTER_COLS = ["Validation_Status", "Location", "Invoice_Currency", "Invoice_Creator_Name"]


@query("distinct_values", " UNION ALL ".join(
    f"""SELECT DISTINCT '{c}' AS column_name, CAST("{c}" AS VARCHAR) AS value FROM dashboard WHERE "{c}" IS NOT NULL"""
    for c in _FILTER_COLS), DASH)
def distinct_values(spark, sf):
    return S.distinct_values(FX.dashboard(spark, sf), _FILTER_COLS)


_SHOW = ["Invoice_Number", "Vendor_Name", "Amount", "Due_Date", "Due_Date_Notification", "Validation_Status"]


@query("explore_filter", f"""SELECT {', '.join(f'"{c}"' for c in _SHOW)} FROM dashboard
WHERE "Validation_Status" = 'PASS' AND "Invoice_Currency" = 'INR'""", DASH)
def explore_filter(spark, sf):
    return S.explore(FX.dashboard(spark, sf), _SHOW, Validation_Status="PASS", Location="All",
                     Invoice_Currency="INR", Invoice_Creator_Name=None)


@query("urgent_payments", """SELECT * FROM dashboard WHERE "Due_Date_Notification" IN ('YES', 'OVERDUE')
ORDER BY "Due_Date", "Invoice_ID" LIMIT 10""", DASH)
def urgent_payments(spark, sf):
    return S.urgent_payments(FX.dashboard(spark, sf))


@query("session_counters", """SELECT session_id, count_if(operation = 'file_read' AND status = 'success') AS files_ok,
  count_if(operation = 'file_read' AND status = 'failed') AS files_failed,
  count_if(operation = 'invoice_insert' AND status <> 'failed') AS invoices_processed,
  count_if(status = 'failed') AS errors, count_if(status = 'warning') AS warnings FROM proc_log GROUP BY 1""",
       ("proc_log",))
def session_counters(spark, sf):
    return S.session_counters(FX.processing_log(spark, sf))


_CLS = """CASE WHEN contains("Validation_Status", 'PASS') THEN 'passed' WHEN contains("Validation_Status", 'FAIL') THEN 'failed'
  WHEN contains("Validation_Status", 'WARNING') THEN 'warning' END"""


@query("pass_rate_impact", f"""SELECT class, invoices, amount,
  {s_pct("sum(CASE WHEN class = 'passed' THEN invoices ELSE 0 END) OVER ()", 'sum(invoices) OVER ()')} AS pass_rate
FROM (SELECT {_CLS} AS class, count(*) AS invoices, sum("Amount") AS amount FROM dashboard
      WHERE {_CLS} IS NOT NULL GROUP BY 1)""", DASH)
def pass_rate_impact(spark, sf):
    return S.pass_rate_impact(FX.dashboard(spark, sf), "Validation_Status", "Amount")


@query("bulk_update_rollup", """SELECT CAST(ts AS DATE) AS batch, count(*) AS total,
  count_if(event_type <> 'error') AS successful, count_if(event_type = 'error') AS failed FROM events GROUP BY 1""")
def bulk_update_rollup(spark, sf):
    from ..session import table
    e = table(spark, sf, "events").select(F.to_date("ts").alias("batch"), (F.col("event_type") != "error").alias("ok"))
    return S.outcome_rollup(e, "batch", "ok")


@query("bulk_update_failed", """SELECT event_id, CAST(ts AS DATE) AS batch, user_id FROM events WHERE event_type = 'error'""")
def bulk_update_failed(spark, sf):
    from ..session import table
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("batch"), "user_id", (F.col("event_type") != "error").alias("ok"))
    return S.failed_rows(e, "ok").drop("ok")
