"""Registered queries: change tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import diff as D
from . import fixtures as FX
from .registry import query

SNAP = ("snap_cur", "snap_prev")
AS_OF_EVENTS = "2024-01-31"  # FIXTURES B6
_CMP = ["invoice_number", "vendor_name", "gst_number", "order_date", "invoice_date_raw", "net_c", "tax_c",
        "amount_raw", "lines", "location", "o_custkey", "order_key", "supp_key"]
_DIFF_SQL = f"""
SELECT coalesce(c.invoice_id, p.invoice_id) AS invoice_id,
       CASE WHEN p.invoice_id IS NULL THEN 'added' WHEN c.invoice_id IS NULL THEN 'deleted'
            WHEN {' OR '.join(f'c.{x} IS DISTINCT FROM p.{x}' for x in _CMP)} THEN 'modified'
            ELSE 'unchanged' END AS change_type,
       CASE WHEN c.invoice_id IS NOT NULL AND p.invoice_id IS NOT NULL THEN
            concat_ws(', ', {', '.join(f"CASE WHEN c.{x} IS DISTINCT FROM p.{x} THEN '{x}' END" for x in _CMP)})
            ELSE '' END AS changed_columns,
       coalesce(c.vendor_name, p.vendor_name) AS vendor_name
FROM snap_cur c FULL OUTER JOIN snap_prev p ON c.invoice_id = p.invoice_id"""


def _diff(spark, sf):
    cur, prev = FX.snapshot_pair(spark, sf)
    return D.snapshot_diff(cur, prev, key="invoice_id", order="invoice_id")


@query("snapshot_diff", _DIFF_SQL, SNAP)
def snapshot_diff(spark, sf):
    return _diff(spark, sf).select("invoice_id", "change_type", "changed_columns", "vendor_name")


@query("change_stats", f"SELECT change_type, count(*) AS rows FROM ({_DIFF_SQL}) GROUP BY 1", SNAP)
def change_stats(spark, sf):
    return D.change_stats(_diff(spark, sf))


@query("top_new_vendors", f"""SELECT vendor_name, count(*) AS added_rows FROM ({_DIFF_SQL}) WHERE change_type = 'added'
GROUP BY 1 ORDER BY added_rows DESC, vendor_name LIMIT 3""", SNAP)
def top_new_vendors(spark, sf):
    return D.top_new_vendors(_diff(spark, sf), "vendor_name")


@query("modified_since_last", f"""SELECT invoice_id, CASE WHEN change_type IN ('modified', 'added') THEN 'Yes' ELSE 'No' END
  AS modified_since_last_check FROM ({_DIFF_SQL}) WHERE change_type <> 'deleted'""", SNAP)
def modified_since_last(spark, sf):
    d = _diff(spark, sf).where(F.col("change_type") != "deleted")
    return d.select("invoice_id", F.when(F.col("change_type").isin("modified", "added"), F.lit("Yes"))
                    .otherwise(F.lit("No")).alias("modified_since_last_check"))


@query("added_keys", "SELECT DISTINCT invoice_id FROM snap_cur WHERE invoice_id NOT IN (SELECT invoice_id FROM snap_prev)", SNAP)
def added_keys(spark, sf):
    cur, prev = FX.snapshot_pair(spark, sf)
    return D.key_sets(cur, prev, "invoice_id", "added")


@query("deleted_keys", "SELECT DISTINCT invoice_id FROM snap_prev WHERE invoice_id NOT IN (SELECT invoice_id FROM snap_cur)", SNAP)
def deleted_keys(spark, sf):
    cur, prev = FX.snapshot_pair(spark, sf)
    return D.key_sets(cur, prev, "invoice_id", "deleted")


@query("common_keys", "SELECT invoice_id FROM snap_cur INTERSECT SELECT invoice_id FROM snap_prev", SNAP)
def common_keys(spark, sf):
    cur, prev = FX.snapshot_pair(spark, sf)
    return D.key_sets(cur, prev, "invoice_id", "common")


_DK = ['"Invoice No"', '"Vendor Name"', '"Invoice Date"']
_DC = ['"GSTIN"', '"PAN"', '"HSN Code"', '"Taxable Value"', '"Total Amount"']


def _side(src):
    return (f"(SELECT *, row_number() OVER (PARTITION BY {', '.join(_DK)} ORDER BY invoice_id) AS rn, "
            f"count(*) OVER (PARTITION BY {', '.join(_DK)}) AS n FROM {src})")


_DELTA_SQL = f"""
SELECT {', '.join(f'coalesce(c.{k}, p.{k}) AS {k}' for k in _DK)},
       {', '.join(f'coalesce(c.{k}, p.{k}) AS {k}' for k in _DC)},
       CASE WHEN p.rn IS NULL THEN 'New Upload' WHEN c.rn IS NULL THEN 'Deleted' ELSE 'Modified' END AS "Status",
       CASE WHEN p.rn IS NULL THEN 'Not found in previous file' WHEN c.rn IS NULL THEN 'Missing in current file'
            ELSE concat_ws(', ', {', '.join(f"CASE WHEN c.{k} <> p.{k} THEN '{k[1:-1]} changed' END" for k in _DC)}) END
         AS "Reason",
       greatest(coalesce(c.n, 0), coalesce(p.n, 0)) AS dup_rows
FROM (SELECT * FROM {_side('dcur')} WHERE rn = 1) c
FULL OUTER JOIN (SELECT * FROM {_side('dprev')} WHERE rn = 1) p
  ON {' AND '.join(f'c.{k} = p.{k}' for k in _DK)}
WHERE p.rn IS NULL OR c.rn IS NULL OR {' OR '.join(f'c.{k} <> p.{k}' for k in _DC)}"""


@query("delta_with_reason", _DELTA_SQL, ("dcur", "dprev"))
def delta_with_reason(spark, sf):
    cur, prev = FX.snapshot_pair(spark, sf)
    return D.delta_with_reason(FX.delta_frame(cur), FX.delta_frame(prev), order="invoice_id")


@query("detect_keys", " UNION ALL ".join(
    f"""SELECT {i} AS preference, '{c}' AS column_name, count(DISTINCT "{c}") AS distinct_values, count("{c}") AS non_null,
       count(*) AS total_rows, count(DISTINCT "{c}") > count("{c}") * 0.8 AS choose_ok,
       count(DISTINCT "{c}") > count(*) * 0.8 AS list_ok FROM ledger"""
    for i, c in enumerate(["InvID", "PurchaseInvNo", "VoucherNo"])), ("ledger",))
def detect_keys(spark, sf):
    return D.detect_keys(FX.ledger(spark, sf), K.KEY_CANDIDATES_CHOOSE)


@query("dedupe_keep_first", """SELECT invoice_id, invoice_number, vendor_name FROM (
  SELECT *, row_number() OVER (PARTITION BY invoice_number ORDER BY invoice_id) AS rn FROM invoices
  WHERE lower(trim(invoice_number)) NOT IN ('nan','none','null','nat','')) WHERE rn = 1
UNION ALL SELECT invoice_id, invoice_number, vendor_name FROM invoices
  WHERE invoice_number IS NULL OR lower(trim(invoice_number)) IN ('nan','none','null','nat','')""", ("invoices",))
def dedupe_keep_first(spark, sf):
    inv = FX.invoices(spark, sf).select("invoice_id", "invoice_number", "vendor_name")
    return D.dedupe_keep_first(inv, ["invoice_number"], "invoice_id")


@query("choose_key", """WITH r AS (SELECT count(DISTINCT "InvID") > count("InvID") * 0.8 AS id_ok, count(DISTINCT "VoucherNo") > count("VoucherNo") * 0.8 AS voucher_ok FROM ledger)
SELECT unnest(['both', 'no InvID before', 'preferred', 'repeated', 'none']) AS case_name,
  unnest([CASE WHEN id_ok THEN 'InvID' END, CASE WHEN voucher_ok THEN 'VoucherNo' END, CASE WHEN voucher_ok THEN 'VoucherNo' END,
          CASE WHEN voucher_ok THEN 'VoucherNo' END, NULL]) AS chosen FROM r""", ("ledger",))
def choose_key(spark, sf):
    """The key of a comparison: columns of both sides, the preferred one first, as long as it tells rows apart."""
    led = FX.ledger(spark, sf).select("InvID", "VoucherNo", "PartyName", "Currency")
    same = led.withColumn("InvID", F.lit("1"))
    cases = [("both", led, led, None), ("no InvID before", led, led.drop("InvID"), None), ("preferred", led, led, "VoucherNo"),
             ("repeated", same, led, "Currency"), ("none", led.drop("VoucherNo"), led.drop("InvID"), "PartyName")]
    return spark.createDataFrame([(n, D.choose_key(a, b, k)) for n, a, b, k in cases], "case_name string, chosen string")


@query("dedupe_exact", """SELECT DISTINCT * FROM (SELECT * FROM ledger UNION ALL SELECT * FROM ledger WHERE CAST("InvID" AS BIGINT) % 3 = 0
  UNION ALL SELECT * REPLACE ("Narration" || ' ' AS "Narration") FROM ledger WHERE CAST("InvID" AS BIGINT) % 5 = 0)""", ("ledger",))
def dedupe_exact(spark, sf):
    """Whole rows: some are repeated, some differ in their last column only."""
    led = FX.ledger(spark, sf)
    k = F.col("InvID").cast("long")
    # the ledger is made once; equal rows have equal numbers, so that one shuffle by them serves the whole rows
    ends = F.array_compact(F.array(F.lit(""), F.when(k % 3 == 0, ""), F.when(k % 5 == 0, " ")))
    rows = led.withColumn("_end", F.explode(ends)).withColumn("Narration", F.concat("Narration", "_end")).drop("_end")
    return rows.repartition("InvID").distinct()


@query("latest_two_runs", """SELECT DISTINCT run_date FROM runs ORDER BY run_date DESC LIMIT 2""", ("runs",))
def latest_two_runs(spark, sf):
    return D.latest_runs(FX.run_snapshots(spark, sf), n=2)


@query("previous_snapshot", f"""SELECT * FROM runs WHERE run_date = (SELECT max(run_date) FROM runs
  WHERE run_date < DATE '{AS_OF_EVENTS}')""", ("runs",))
def previous_snapshot(spark, sf):
    return D.previous_snapshot(FX.run_snapshots(spark, sf), AS_OF_EVENTS)


@query("latest_partition", f"""SELECT * FROM runs WHERE run_date = (SELECT max(run_date) FROM runs
  WHERE run_date <= DATE '2024-01-15')""", ("runs",))
def latest_partition(spark, sf):
    return D.latest_partition(FX.run_snapshots(spark, sf), "2024-01-15")
