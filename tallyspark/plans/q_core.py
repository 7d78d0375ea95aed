"""Registered queries: expressions, normalisation, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import exprs as X
from ..functions.json_safe import to_json_records
from ..operators import normalize as N
from ..operators import rules as R
from ..operators.normalize import col
from . import fixtures as FX
from .registry import (query, s_blank, s_null_tokens, s_num, s_parse_amount, s_parse_date, s_strip)

AS_OF = "2001-08-01"  # FIXTURES B6: as-of date for the B1 tables
GST_RE = K.GSTIN_RE
LEDGER_CTE = ("ledger",)
INV_CTE = ("invoices",)


# ----------------------------------------------------------------- flagship
_Q = "'"
_ISSUE_LIST = "list_filter([" + ",\n".join(
    [f"CASE WHEN {s_blank('l.' + chr(34) + f + chr(34))} THEN 'missing value in {_Q}{_Q}{f}{_Q}{_Q}' END"
     for f in K.REQUIRED_COLUMNS]
    + ["CASE WHEN d.n > 1 THEN 'duplicate invoice number' END",
       f"CASE WHEN l.\"Total\" IS NOT NULL AND {s_num('l.\"Total\"')} IS NULL THEN 'invalid amount value' END",
       f"CASE WHEN {s_num('l.\"Total\"')} < 0 THEN 'negative amount' END",
       f"CASE WHEN l.\"PurchaseInvDate\" IS NOT NULL AND {s_parse_date('l.\"PurchaseInvDate\"')} IS NULL "
       "THEN 'invalid date' END"]) + "], lambda x: x IS NOT NULL)"
_RULED = f"""(SELECT l.*, {_ISSUE_LIST} AS issues
      FROM ledger l LEFT JOIN (SELECT "PurchaseInvNo" AS k, count(*) AS n FROM ledger
                               WHERE NOT {s_blank('"PurchaseInvNo"')} GROUP BY 1) d
        ON l."PurchaseInvNo" = d.k AND NOT {s_blank('l."PurchaseInvNo"')})"""

FLAGSHIP_SQL = f"""
SELECT coalesce({s_null_tokens('"PartyName"')}, '') AS vendor, issue, count(*) AS rows,
       sum({s_parse_amount('"Total"')}) AS amount
FROM (SELECT *, unnest(issues) AS issue FROM {_RULED} r) t
GROUP BY 1, 2"""


@query("rule_report_by_vendor", FLAGSHIP_SQL, LEDGER_CTE)
def rule_report_by_vendor(spark, sf):
    """Which invoices fail which rule, how many and how much money, per vendor."""
    return R.issue_money_by_vendor(R.apply_rules(FX.ledger(spark, sf)), "PartyName", "Total")


@query("rule_report", f"""
SELECT issue, count(*) AS rows FROM (SELECT unnest(issues) AS issue FROM {_RULED} r) t GROUP BY issue""", LEDGER_CTE)
def rule_report(spark, sf):
    return R.rule_report(R.apply_rules(FX.ledger(spark, sf)))


@query("rule_required_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {'false' if c == 'GSTNO' else 'true'} AS present, "
    + ("count_if(false)" if c == "GSTNO" else f"count_if(NOT {s_blank(chr(34) + c + chr(34))})") + " AS filled_rows FROM ledger"
    for c in K.REQUIRED_COLUMNS), LEDGER_CTE)
def rule_required_columns(spark, sf):
    return R.required_columns(FX.ledger(spark, sf).drop("GSTNO"))


@query("rule_missing_values", " UNION ALL ".join(
    f"SELECT '{f}' AS field, count_if({s_blank(chr(34) + f + chr(34))}) AS missing_rows FROM ledger"
    for f in K.REQUIRED_COLUMNS), LEDGER_CTE)
def rule_missing_values(spark, sf):
    return R.missing_values(FX.ledger(spark, sf))


@query("rule_duplicates", f"""
SELECT l."InvID", l."PurchaseInvNo", d.dup_count FROM ledger l
JOIN (SELECT "PurchaseInvNo", count(*) AS dup_count FROM ledger WHERE NOT {s_blank('"PurchaseInvNo"')}
      GROUP BY 1 HAVING count(*) > 1) d ON l."PurchaseInvNo" = d."PurchaseInvNo" """, LEDGER_CTE)
def rule_duplicates(spark, sf):
    return R.duplicates(FX.ledger(spark, sf)).select("InvID", "PurchaseInvNo", "dup_count")


@query("rule_bad_amount", f"""
SELECT "InvID", "Total", CASE WHEN "Total" IS NOT NULL AND {s_num('"Total"')} IS NULL THEN 'invalid amount value'
                              WHEN {s_num('"Total"')} < 0 THEN 'negative amount' END AS problem
FROM ledger WHERE ("Total" IS NOT NULL AND {s_num('"Total"')} IS NULL) OR {s_num('"Total"')} < 0""", LEDGER_CTE)
def rule_bad_amount(spark, sf):
    return R.bad_amounts(FX.ledger(spark, sf)).select("InvID", "Total", "problem")


@query("rule_bad_date", f"""
SELECT "InvID", "PurchaseInvDate" FROM ledger
WHERE "PurchaseInvDate" IS NOT NULL AND {s_parse_date('"PurchaseInvDate"')} IS NULL""", LEDGER_CTE)
def rule_bad_date(spark, sf):
    return R.bad_dates(FX.ledger(spark, sf)).select("InvID", "PurchaseInvDate")


@query("mark_rows", f"""
SELECT "InvID", CASE WHEN len(issues) = 0 THEN 'VALID' ELSE 'FLAGGED' END AS "Validation_Status",
       array_to_string(issues, '; ') AS "Issues_Found",
       CASE WHEN len(issues) = 0 THEN '✅' ELSE '' END AS "Correct",
       CASE WHEN len(issues) = 0 THEN '' ELSE '🚩' END AS "Flagged"
FROM {_RULED} r""", LEDGER_CTE)
def mark_rows(spark, sf):
    return R.mark_rows(R.apply_rules(FX.ledger(spark, sf))).select(
        "InvID", "Validation_Status", "Issues_Found", "Correct", "Flagged")


@query("mark_issue_rows", f"""
SELECT "InvID", "PurchaseInvNo", "Total" FROM ledger
WHERE "InvID" IN (SELECT "InvID" FROM {_RULED} r WHERE len(issues) > 0)""", LEDGER_CTE)
def mark_issue_rows(spark, sf):
    led = FX.ledger(spark, sf)
    bad = R.rows_with_issues(R.apply_rules(led)).select("InvID")
    return led.join(bad, "InvID", "left_semi").select("InvID", "PurchaseInvNo", "Total")


# ----------------------------------------------------------------- main pipeline
@query("row_discrepancies", """
SELECT hash_value, discrepancies FROM validations WHERE discrepancies IS NOT NULL""", ("validations",))
def row_discrepancies(spark, sf):
    return FX.validations(spark, sf).select("hash_value", "discrepancies").where(F.col("discrepancies").isNotNull())


@query("drop_blank_numbers", "SELECT * FROM validations", ("validations",))
def drop_blank_numbers(spark, sf):
    return FX.validations(spark, sf)


@query("has_discrepancy", "SELECT invoice_number, vendor_name, amount, discrepancies FROM validations "
       "WHERE discrepancies IS NOT NULL", ("validations",))
def has_discrepancy(spark, sf):
    return (FX.validations(spark, sf).where(F.col("discrepancies").isNotNull())
            .select("invoice_number", "vendor_name", "amount", "discrepancies"))


@query("row_hash", "SELECT invoice_number, hash_value FROM validations", ("validations",))
def row_hash(spark, sf):
    return FX.validations(spark, sf).select("invoice_number", "hash_value")


@query("extract_gst", "SELECT hash_value, gst_no FROM validations", ("validations",))
def extract_gst(spark, sf):
    return FX.validations(spark, sf).select("hash_value", "gst_no")


@query("extract_invoice_date", f"""SELECT "InvID", coalesce({s_parse_date('"PurchaseInvDate"')}, CAST("Voucherdate" AS DATE)) AS inv_date FROM ledger""", LEDGER_CTE)
def extract_invoice_date(spark, sf):
    """Dates as exports have them: with a time of day, or the name of the month; else those of the next date column."""
    iso = F.when(col("PurchaseInvDate").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), col("PurchaseInvDate").try_cast("date"))
    k = col("InvID").cast("long") % 3
    raw = (F.when((k == 0) & iso.isNotNull(), F.date_format(iso, "dd-MMM-yyyy")).when(k == 1, F.concat(col("PurchaseInvDate"), F.lit(" 09:30:00")))
            .otherwise(col("PurchaseInvDate")))
    led = FX.ledger(spark, sf).select("InvID", raw.alias("Invoice Date"), col("Voucherdate").alias("Created Date"), col("Due Date"))
    return _ledger_first(spark, sf, K.INVOICE_DATE_TOKENS, "inv_date", parse=True, led=led)


@query("extract_currency", f"""SELECT "InvID", upper(coalesce({s_null_tokens('"Currency"')}, 'USD')) AS inv_currency FROM ledger""", LEDGER_CTE)
def extract_currency(spark, sf):
    return _ledger_first(spark, sf, K.CURRENCY_TOKENS, "inv_currency", upper=True, default=K.DEFAULT_CURRENCY_EXTRACT)


@query("extract_location", "SELECT hash_value, location FROM validations", ("validations",))
def extract_location(spark, sf):
    return FX.validations(spark, sf).select("hash_value", "location")


def _ledger_first(spark, sf, tokens, name, parse=False, upper=False, default="", led=None):
    led = N.clean_headers(FX.ledger(spark, sf) if led is None else led, drop_empty_columns=False)
    cols = N.header_cols(led.columns, tokens, exclude=K.DUE_DATE_TOKENS if tokens is K.INVOICE_DATE_TOKENS else None)
    v = (X.first_date(*[col(c) for c in cols]) if parse
         else X.first_text(*[col(c) for c in cols], upper=upper, default=default))
    return led.select(F.col("invid").alias("InvID"), v.alias(name))


@query("extract_due_date", f"""SELECT "InvID", {s_parse_date('"Due Date"')} AS due_date FROM ledger""", LEDGER_CTE)
def extract_due_date(spark, sf):
    return _ledger_first(spark, sf, K.DUE_DATE_TOKENS, "due_date", parse=True)


@query("extract_mop", f"""SELECT "InvID", coalesce({s_null_tokens('"Method_of_Payment"')}, '') AS mop FROM ledger""",
       LEDGER_CTE)
def extract_mop(spark, sf):
    return _ledger_first(spark, sf, K.MOP_TOKENS, "mop")


@query("extract_account_head", f"""SELECT "InvID", coalesce(CASE WHEN CAST("InvID" AS BIGINT) % 3 = 0 THEN NULL
  ELSE {s_null_tokens('"PurchaseLEDGER"')} END, {s_null_tokens('"State"')}, '') AS account_head FROM ledger""", LEDGER_CTE)
def extract_account_head(spark, sf):
    # two account columns: the first one is blank in every third row
    led = FX.ledger(spark, sf).withColumn("gl_code", F.when(F.col("InvID").cast("long") % 3 == 0, F.lit(" ")).otherwise(F.col("PurchaseLEDGER")))
    return _ledger_first(spark, sf, K.ACCOUNT_TOKENS, "account_head", led=led.withColumn("cost_center", F.col("State")))


@query("parse_dates", f"""SELECT invoice_id, invoice_date_raw, {s_parse_date('invoice_date_raw')} AS invoice_date
FROM invoices""", INV_CTE)
def parse_dates(spark, sf):
    return FX.invoices(spark, sf).select("invoice_id", "invoice_date_raw",
                                         X.parse_date("invoice_date_raw").alias("invoice_date"))


@query("parse_amount", f"""SELECT invoice_id, amount_raw, {s_parse_amount('amount_raw')} AS amount,
  coalesce({s_parse_amount('amount_raw')} < 0 OR {s_parse_amount('amount_raw')} > 1000000, false) AS out_of_range
FROM invoices""", INV_CTE)
def parse_amount(spark, sf):
    a = X.parse_amount("amount_raw")
    return FX.invoices(spark, sf).select("invoice_id", "amount_raw", a.alias("amount"),
                                         F.coalesce(X.amount_out_of_range(a), F.lit(False)).alias("out_of_range"))


@query("null_tokens", f"""SELECT "InvID", {s_null_tokens('"State"')} AS state, {s_null_tokens('"GSTNO"')} AS gstno,
  {s_null_tokens('"Currency"')} AS currency FROM ledger""", LEDGER_CTE)
def null_tokens(spark, sf):
    return FX.ledger(spark, sf).select("InvID", X.null_tokens("State").alias("state"),
                                       X.null_tokens("GSTNO").alias("gstno"), X.null_tokens("Currency").alias("currency"))


@query("derive_location", f"""SELECT "InvID", coalesce({s_null_tokens('"State"')},
  CASE WHEN length({s_null_tokens('"GSTNO"')}) >= 2 THEN substr({s_null_tokens('"GSTNO"')}, 1, 2) END, '') AS location
FROM ledger""", LEDGER_CTE)
def derive_location(spark, sf):
    return FX.ledger(spark, sf).select("InvID", X.derive_location("State", "GSTNO").alias("location"))


def _s_due_alert(d, as_of):
    return (f"(CASE WHEN {d} IS NULL THEN '' WHEN date_diff('day', DATE '{as_of}', {d}) < 0 THEN 'OVERDUE' "
            f"WHEN date_diff('day', DATE '{as_of}', {d}) <= 2 THEN 'YES' ELSE 'NO' END)")


@query("due_alert", f"""SELECT "InvID", {s_parse_date('"Due Date"')} AS due_date,
  {_s_due_alert(s_parse_date('"Due Date"'), AS_OF)} AS due_date_notification FROM ledger""", LEDGER_CTE)
def due_alert(spark, sf):
    d = X.parse_date(col("Due Date"))
    return FX.ledger(spark, sf).select("InvID", d.alias("due_date"), X.due_alert(d, AS_OF).alias("due_date_notification"))


def _s_num0(x):
    return f"coalesce(TRY_CAST(replace({s_strip(x)}, ',', '') AS DECIMAL(18,2)), CAST(0 AS DECIMAL(18,2)))"


_TAX = [_s_num0(f'"{c}"') for c in ("CGSTInputAmt", "SGSTInputAmt", "IGST/VATInputAmt", "VAT")]


@query("tax_classify", f"""SELECT "InvID", {_TAX[0]} AS cgst, {_TAX[1]} AS sgst, {_TAX[2]} AS igst, {_TAX[3]} AS vat,
  {_TAX[0]} + {_TAX[1]} + {_TAX[2]} + {_TAX[3]} AS total_tax,
  CASE WHEN {_TAX[2]} > 0 THEN 'IGST' WHEN {_TAX[0]} + {_TAX[1]} > 0 THEN 'GST' WHEN {_TAX[3]} > 0 THEN 'VAT' ELSE '' END
    AS tax_type FROM ledger""", LEDGER_CTE)
def tax_classify(spark, sf):
    c, s, i, v = [X.parse_number_or_zero(col(n)) for n in ("CGSTInputAmt", "SGSTInputAmt", "IGST/VATInputAmt", "VAT")]
    return FX.ledger(spark, sf).select("InvID", c.alias("cgst"), s.alias("sgst"), i.alias("igst"), v.alias("vat"),
                                       X.tax_total(c, s, i, v).alias("total_tax"), X.tax_type(c, s, i, v).alias("tax_type"))


@query("tds_status", f"""SELECT "InvID", CASE WHEN {_s_num0('"TDS"')} > 0 THEN 'Deducted'
  WHEN {s_strip('"TDS"')} IS NOT NULL AND {s_strip('"TDS"')} NOT IN ('', '0', '0.0') THEN {s_strip('"TDS"')}
  ELSE 'Not Deducted' END AS tds_status FROM ledger""", LEDGER_CTE)
def tds_status(spark, sf):
    return FX.ledger(spark, sf).select("InvID", X.tds_status("TDS").alias("tds_status"))


_CR = f"""trim(regexp_replace(coalesce("Inv Created By", ''), '\\s*\\(.*\\)$', ''), {chr(39)} {chr(39)} || chr(9) || chr(10) || chr(13))"""


@query("clean_creator", f"""SELECT "InvID", CASE WHEN {_CR} = '' OR lower({_CR}) IN
  ('n/a','na','null','none','unknown','system') THEN 'System Generated' ELSE {_CR} END AS creator FROM ledger""",
       LEDGER_CTE)
def clean_creator(spark, sf):
    # initcap differs from Python title() (T9); the oracle compares the untitled form
    return FX.ledger(spark, sf).select("InvID", X.clean_creator(col("Inv Created By"), title=False).alias("creator"))


@query("invoice_hash", """SELECT invoice_id, sha256(concat_ws('|', coalesce(invoice_number, ''), coalesce(vendor_name, ''),
  coalesce(invoice_date_raw, ''), coalesce(gst_number, ''), '', '', coalesce(CAST(net_c AS VARCHAR), '0'),
  coalesce(amount_raw, '0'))) AS hash FROM invoices""", INV_CTE)
def invoice_hash(spark, sf):
    return FX.invoices(spark, sf).select("invoice_id", X.invoice_hash(
        "invoice_number", "vendor_name", "invoice_date_raw", "gst_number", F.lit(None), F.lit(None),
        "net_c", "amount_raw").alias("hash"))


#: Raw statuses that reach every entry of the status map, and none.
_RAW_STATUS = {"✅ valid": "VALID", "Invalid": "INVALID", "🚩 flagged": "FLAGGED", "new": "FLAGGED", " issues found ": "FLAGGED", "unknown": "UNKNOWN",
               "❌ ERROR": "INVALID", "paid": "UNKNOWN", "": "UNKNOWN", None: "UNKNOWN"}
_STATUS_SQL = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_RAW_STATUS.values()))


@query("standardize_status", f"""SELECT "InvID", CASE CAST("InvID" AS BIGINT) % {len(_RAW_STATUS)} {_STATUS_SQL} END AS from_status,
  CASE WHEN {s_blank('"Narration"')} OR CAST("InvID" AS BIGINT) % 2 = 0 THEN 'VALID' ELSE 'FLAGGED' END AS from_issues,
  CASE CAST("InvID" AS BIGINT) % {len(_RAW_STATUS)} {_STATUS_SQL} END AS from_validation, 'UNKNOWN' AS from_none FROM ledger""", LEDGER_CTE)
def standardize_status(spark, sf):
    k = col("InvID").cast("long")
    raw = F.element_at(F.array(*[F.lit(s) for s in _RAW_STATUS]), (k % len(_RAW_STATUS) + 1).cast("int"))
    issues = F.when(k % 2 == 0, F.lit(" NaN ")).otherwise(col("Narration"))
    return FX.ledger(spark, sf).select("InvID", X.standardize_status(status=raw).alias("from_status"), X.standardize_status(issues=issues).alias("from_issues"),
                                       X.standardize_status(validation_status=raw).alias("from_validation"), X.standardize_status().alias("from_none"))


@query("gst_result_class", f"""SELECT hash_value, CASE WHEN gst_no <> '' AND length(gst_no) = 15 AND substr(gst_no, 15, 1) < 'M' THEN 'Correct'
  WHEN gst_no <> '' THEN 'Error' ELSE 'Warning' END AS gst_class FROM validations""", ("validations",))
def gst_result_class(spark, sf):
    v = FX.validations(spark, sf)
    res = F.when((F.length("gst_no") == 15) & (F.substring("gst_no", 15, 1) < "M"), F.lit("✅ valid")).when(F.col("gst_no") != "", F.lit("GST ❌ not found"))
    return v.select("hash_value", X.gst_result_class(res).alias("gst_class"))


@query("location_head", """SELECT "InvID", split_part(coalesce("PurchaseLEDGER" || ', ' || "State", ''), ',', 1) AS head
FROM ledger""", LEDGER_CTE)
def location_head(spark, sf):
    loc = F.concat_ws(", ", col("PurchaseLEDGER"), col("State"))
    return FX.ledger(spark, sf).select("InvID", X.location_head(loc).alias("head"))


@query("name_date", """SELECT page_id, CAST(try_strptime(regexp_extract(url, '(\\d{4}-\\d{2}-\\d{2})', 1), '%Y-%m-%d') AS DATE)
  AS name_date FROM (SELECT page_id, 'report_' || strftime(DATE '2024-01-01' + CAST(page_id % 40 AS INTEGER), '%Y-%m-%d')
  || '_' || url AS url FROM pages)""")
def name_date(spark, sf):
    from ..session import table
    p = table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("report_"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"),
                                                                         (F.col("page_id") % 40).cast("int")), "yyyy-MM-dd"),
                            F.lit("_"), F.col("url")).alias("url"))
    return p.select("page_id", X.name_date("url").alias("name_date"))


@query("format_amount", """SELECT hash_value, amount, coalesce('₹' || format('{:,.2f}', amount), 'N/A') AS shown FROM validations""", ("validations",))
def format_amount(spark, sf):
    return FX.validations(spark, sf).select("hash_value", "amount", X.format_amount("amount").alias("shown"))


# ----------------------------------------------------------------- frame normalisation
def _clean_sql():
    parts = []
    from .fixtures import LEDGER_COLUMNS
    for c in LEDGER_COLUMNS:
        n = N.clean_header_name(c)
        parts.append(f"""CASE WHEN {s_strip(chr(34) + c + chr(34))} IN ('nan', 'None', '') THEN NULL
                         ELSE {s_strip(chr(34) + c + chr(34))} END AS "{n}" """)
    return "SELECT " + ", ".join(parts) + " FROM ledger"


@query("clean_headers", _clean_sql(), LEDGER_CTE)
def clean_headers(spark, sf):
    return N.clean_headers(FX.ledger(spark, sf))


@query("column_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, avg(CASE WHEN {s_num(chr(34) + c + chr(34))} IS NOT NULL THEN 1 ELSE 0 END) AS numeric_ratio,
        avg(length(coalesce("{c}", ''))) AS mean_length FROM ledger"""
    for c in ["PurchaseInvNo", "PartyName", "Total", "TaxableValue", "InvID"]), LEDGER_CTE)
def column_profile(spark, sf):
    return N.column_profile(FX.ledger(spark, sf), ["PurchaseInvNo", "PartyName", "Total", "TaxableValue", "InvID"])


def _share(c: str) -> str:
    return f"avg(CASE WHEN {s_num(chr(34) + c + chr(34))} IS NOT NULL THEN 1.0 ELSE 0.0 END)"


@query("map_columns", f"""
WITH p AS (SELECT {_share('PurchaseInvNo')} AS inv, {_share('InvID')} AS id, {_share('PartyName')} AS party,
                  avg(length(coalesce("PartyName", ''))) AS party_len, {_share('Total')} AS total, {_share('TaxableValue')} AS taxable,
                  {_share('Narration')} AS note, avg(length(coalesce("Narration", ''))) AS note_len FROM ledger)
SELECT 'invoice_number' AS target, 'voucher_ref' AS column_name, CAST(2 + (inv < 1)::INT + (inv < 0.5)::INT AS INT) AS score FROM p
UNION ALL SELECT 'invoice_number', 'billing_key', CAST((id < 1)::INT + (id < 0.5)::INT AS INT) FROM p
UNION ALL SELECT 'vendor', 'party_label', CAST(2 + 2 * (party < 1)::INT + (party_len >= 6)::INT AS INT) FROM p
UNION ALL SELECT 'vendor', 'payee_note', CAST(2 * (note < 1)::INT + (note_len >= 6)::INT AS INT) FROM p
UNION ALL SELECT 'amount', 'grand_amt', CAST(4 + 3 * (total >= 0.6)::INT AS INT) FROM p
UNION ALL SELECT 'amount', 'base_value', CAST(1 + 3 * (taxable >= 0.6)::INT AS INT) FROM p""", LEDGER_CTE)
def map_columns(spark, sf):
    """Headers that no known name fits: candidates are scored by name and profile."""
    led = FX.ledger(spark, sf).select(
        F.col("PurchaseInvNo").alias("voucher_ref"), F.col("InvID").alias("billing_key"), F.col("PartyName").alias("party_label"),
        F.col("Narration").alias("payee_note"), F.col("Total").alias("grand_amt"), F.col("TaxableValue").alias("base_value"),
        F.col("TDS").alias("tds_value"), F.col("Voucherdate").alias("voucher_date"))
    return N.column_candidates(led).select("target", "column_name", F.col("score").cast("int").alias("score"))


@query("profile_quality", f"""SELECT count(*) AS total_rows, {len(__import__('tallyspark.plans.fixtures', fromlist=['x']).LEDGER_COLUMNS)} AS total_columns,
  count_if(purchaseinvno IS NULL) AS empty_invoice_numbers,
  count(*) - count(DISTINCT purchaseinvno) - CASE WHEN count_if(purchaseinvno IS NULL) > 0 THEN 1 ELSE 0 END
    AS duplicate_invoice_numbers,
  count_if({s_num('total')} IS NULL) AS invalid_amounts, count_if({s_num('total')} < 0) AS negative_amounts
FROM ({_clean_sql()})""", LEDGER_CTE)
def profile_quality(spark, sf):
    led = N.clean_headers(FX.ledger(spark, sf))
    return R.profile_quality(led, "purchaseinvno", "total")


_NORM_SQL = f"""
SELECT coalesce({s_null_tokens('"InvID"')}, '') AS "Invoice_ID",
       coalesce({s_null_tokens('"PurchaseInvNo"')}, '') AS "Invoice_Number",
       {s_parse_date('"PurchaseInvDate"')} AS "Invoice_Date",
       coalesce({s_null_tokens('"PartyName"')}, '') AS "Vendor_Name",
       coalesce({s_null_tokens('"GSTNO"')}, '') AS "GST_Number",
       TRY_CAST({s_strip('"Total"')} AS DECIMAL(38,6)) AS "Amount",
       coalesce(TRY_CAST({s_strip('"Total"')} AS DECIMAL(38,12)) <> TRY_CAST({s_strip('"Total"')} AS DECIMAL(38,6)), false) AS "Amount_Inexact",
       coalesce({s_null_tokens('"Inv Created By"')}, '') AS "Invoice_Creator_Name",
       '' AS "Method_of_Payment",
       {s_parse_date('"Due Date"')} AS "Due_Date",
       coalesce({s_null_tokens('"Narration"')}, '') AS "Remarks",
       coalesce({s_null_tokens('"State"')}, '') AS "Raw_State",
       coalesce({s_null_tokens('"Currency"')}, 'INR') AS "Invoice_Currency",
       coalesce({s_null_tokens('"SCID"')}, '') AS "SCID",
       coalesce({s_null_tokens('"State"')}, CASE WHEN length({s_null_tokens('"GSTNO"')}) >= 2
                THEN substr({s_null_tokens('"GSTNO"')}, 1, 2) END, '') AS "Location",
       {_s_due_alert(s_parse_date('"Due Date"'), AS_OF)} AS "Due_Date_Notification"
FROM ledger"""


@query("normalize_aliases", _NORM_SQL, LEDGER_CTE)
def normalize_aliases(spark, sf):
    return N.normalize_aliases(FX.ledger(spark, sf), AS_OF)


@query("normalize_exact_amounts", """SELECT "InvID" AS "Invoice_ID", CASE WHEN k % 3 = 0 THEN n + CAST('0.004567' AS DECIMAL(38,6))
    WHEN k % 3 = 1 THEN CAST('98765432109876543.21' AS DECIMAL(38,6)) + k ELSE n END AS "Amount", k % 3 = 2 AS "Amount_Inexact"
  FROM (SELECT "InvID", CAST("InvID" AS BIGINT) AS k, CAST(CAST("InvID" AS BIGINT) % 1000 AS DECIMAL(38,6)) AS n FROM ledger)""", LEDGER_CTE)
def normalize_exact_amounts(spark, sf):
    """Amounts with six decimals, of nineteen digits, and with more decimals than are kept."""
    k = col("InvID").cast("long")
    raw = (F.when(k % 3 == 0, F.concat((k % 1000).cast("string"), F.lit(".004567"))).when(k % 3 == 1, (F.lit("98765432109876543.21").cast("decimal(38,2)") + k).cast("string"))
            .otherwise(F.concat((k % 1000).cast("string"), F.lit(".0000004"))))
    led = FX.ledger(spark, sf).withColumn("Total", raw)
    return N.normalize_aliases(led, AS_OF).select("Invoice_ID", "Amount", "Amount_Inexact")


@query("rename_dashboard", """SELECT coalesce(invoice_number, '') AS "Invoice_Number", coalesce(vendor_name, '') AS "Vendor_Name",
  amount AS "Amount", coalesce(status, '') AS status, coalesce(discrepancies, '') AS "Issues_Found",
  coalesce(location, '') AS "Location" FROM validations""", ("validations",))
def rename_dashboard(spark, sf):
    v = FX.validations(spark, sf).select("invoice_number", "vendor_name", "amount", "status", "discrepancies", "location")
    out = N.rename_dashboard(v.withColumnRenamed("status", "status_raw"))
    return out.withColumnRenamed("status_raw", "status")


_LEDGER_COLUMNS = ["InvID", "VoucherNo", "Voucherdate", "PurchaseInvNo", "PurchaseInvDate", "PartyName", "GSTNO", "State", "PurchaseLEDGER",
                   "TaxableValue", "Total", "Currency", "IGST/VATInputAmt", "CGSTInputAmt", "SGSTInputAmt", "VAT", "TDS", "Narration",
                   "Inv Created By", "Due Date", "Method_of_Payment", "SCID"]


@query("to_json_record", f"""SELECT "InvID", to_json(struct_pack({', '.join(f'"{c}" := "{c}"' for c in _LEDGER_COLUMNS)})) AS record FROM ledger""", LEDGER_CTE)
def to_json_record(spark, sf):
    return to_json_records(FX.ledger(spark, sf).select(*_LEDGER_COLUMNS), ["InvID"])


@query("to_json_nested", """SELECT l_orderkey, concat('{"l_orderkey":', l_orderkey, ',"made":"', strftime(min(o_orderdate), '%Y-%m-%d'), '","at":"',
    strftime(CAST(min(o_orderdate) AS TIMESTAMP) + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S'), '","odd":',
    CASE l_orderkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN 'null' WHEN 2 THEN 'null' ELSE '0.5' END, ',"note":null,"lines":[',
    string_agg(concat('{"line":', l_linenumber, ',"price":', CAST(l_extendedprice AS DECIMAL(18,2)), ',"ratio":',
      CASE WHEN l_linenumber % 2 = 0 THEN 'null' ELSE concat(l_linenumber, '.0') END, ',"shipped":["', strftime(l_shipdate, '%Y-%m-%d'), '",null]}'), ',' ORDER BY place),
    '],"flags":{', string_agg(concat('"', place, '":"', strftime(l_shipdate, '%Y-%m-%d'), '"'), ',' ORDER BY place), '},"raw":"', base64(encode(CAST(l_orderkey AS VARCHAR))), '"}') AS record
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)), l_shipdate) - 1 AS place FROM lineitem)
  JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey""")
def to_json_nested(spark, sf):
    """Orders with their lines: arrays of structs with arrays, a map with number keys, days, times, decimals, NaN and infinities."""
    from ..session import table
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
                    F.when(F.col("l_linenumber") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("l_linenumber").cast("double")).alias("ratio"),
                    F.array(F.to_date("l_shipdate"), F.lit(None).cast("date")).alias("shipped"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("made"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    odd = F.element_at(F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(float("-inf")), F.lit(0.5)), (F.col("l_orderkey") % 4 + 1).cast("int"))
    flags = F.map_from_entries(F.transform("lines", lambda x, i: F.struct(i, x["shipped"][0])))
    df = lines.join(orders, "l_orderkey").select(
        "l_orderkey", "made", (F.col("made").cast("timestamp") + F.expr("INTERVAL 90 MINUTE")).alias("at"), odd.alias("odd"),
        F.lit(None).cast("string").alias("note"), "lines", flags.alias("flags"), F.encode(F.col("l_orderkey").cast("string"), "UTF-8").alias("raw"))
    return to_json_records(df, ["l_orderkey"])
