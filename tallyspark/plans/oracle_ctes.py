"""DuckDB forms of the Spark fixtures in ``fixtures.py`` (used only by the oracle SQL).

``with_ctes(body, names...)`` prefixes a query body with the CTEs it needs,
dependencies first.
"""

from __future__ import annotations

_DATE_CASES = " ".join(
    f"WHEN k % 5 = {i} THEN strftime(CAST(o_orderdate AS DATE), '{f}')"
    for i, f in enumerate(["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y/%m/%d"]))

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "inv_lines": ((), """
  SELECT l_orderkey AS k, l_suppkey AS v,
         sum((CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS INTEGER)) + 50) // 100)
           AS net_c,
         sum((CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS INTEGER))
              * CAST(round(l_tax * 100) AS INTEGER) + 5000) // 10000) AS tax_c,
         count(*) AS lines
  FROM lineitem GROUP BY l_orderkey, l_suppkey"""),
    "invoices": (("inv_lines",), f"""
  SELECT k * 100000 + v AS invoice_id,
         CASE WHEN k % 97 = 0 THEN '' WHEN k % 89 = 0 THEN 'INV-' || CAST(k AS VARCHAR)
              ELSE 'INV-' || CAST(k AS VARCHAR) || '-' || CAST(v AS VARCHAR) END AS invoice_number,
         CASE WHEN k % 83 = 0 THEN '' ELSE s_name END AS vendor_name,
         CASE WHEN k % 79 = 0 THEN NULL ELSE CAST(n_nationkey + 10 AS VARCHAR) || 'ABCDE'
              || lpad(CAST(v % 10000 AS VARCHAR), 4, '0') || 'F1Z5' END AS gst_number,
         CAST(o_orderdate AS DATE) AS order_date,
         CASE WHEN k % 73 = 0 THEN 'not-a-date' {_DATE_CASES} END AS invoice_date_raw,
         net_c, tax_c,
         CASE WHEN k % 71 = 0 THEN 'N/A'
              ELSE (CASE WHEN k % 4 = 0 THEN '₹ ' ELSE '' END)
                || (CASE WHEN k % 67 = 0 THEN '-' || CAST((net_c + tax_c) // 100 AS VARCHAR) || '.00'
                         ELSE CAST((net_c + tax_c) // 100 AS VARCHAR) || '.'
                              || lpad(CAST((net_c + tax_c) % 100 AS VARCHAR), 2, '0') END) END AS amount_raw,
         lines, n_name AS location, o_custkey, k AS order_key, v AS supp_key
  FROM inv_lines JOIN orders ON o_orderkey = k JOIN supplier ON s_suppkey = v
       JOIN nation ON n_nationkey = s_nationkey"""),
    "snap_cur": (("invoices",), """
  SELECT * REPLACE (CASE WHEN order_key % 17 = 0 THEN net_c + 100 ELSE net_c END AS net_c)
  FROM invoices WHERE order_key % 13 <> 0"""),
    "snap_prev": (("invoices",), """
  SELECT * FROM invoices WHERE order_key % 11 <> 0"""),
}


def register(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body)


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS ({CTES[n][1]}\n)" for n in order)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {parts},\n{stripped[5:]}"
    return f"WITH {parts}\n{body}"


def _cents(c: str) -> str:
    return f"(CAST(({c}) // 100 AS VARCHAR) || '.' || lpad(CAST(({c}) % 100 AS VARCHAR), 2, '0'))"


register("ledger", ("invoices",), f"""
  SELECT CAST(invoice_id AS VARCHAR) AS "InvID",
         'V' || CAST(invoice_id AS VARCHAR) AS "VoucherNo",
         strftime(CAST(order_date + CAST(order_key % 7 AS INTEGER) AS DATE), '%Y-%m-%d') AS "Voucherdate",
         invoice_number AS "PurchaseInvNo",
         invoice_date_raw AS "PurchaseInvDate",
         vendor_name AS "PartyName",
         gst_number AS "GSTNO",
         CASE WHEN order_key % 31 = 0 THEN '' ELSE location END AS "State",
         CASE order_key % 3 WHEN 0 THEN 'Purchase Goods' WHEN 1 THEN 'Purchase Services' ELSE 'Import Purchase' END AS "PurchaseLEDGER",
         {_cents('net_c')} AS "TaxableValue",
         amount_raw AS "Total",
         CASE order_key % 5 WHEN 0 THEN 'USD' WHEN 1 THEN '' ELSE 'INR' END AS "Currency",
         CASE WHEN order_key % 4 = 0 THEN {_cents('tax_c')} ELSE '0' END AS "IGST/VATInputAmt",
         CASE WHEN order_key % 4 = 1 THEN {_cents('tax_c // 2')} ELSE '0' END AS "CGSTInputAmt",
         CASE WHEN order_key % 4 = 1 THEN {_cents('tax_c - tax_c // 2')} ELSE '0' END AS "SGSTInputAmt",
         CASE WHEN order_key % 4 = 2 THEN (CASE WHEN order_key % 53 = 0 THEN '18%' ELSE {_cents('tax_c')} END)
              ELSE '' END AS "VAT",
         CASE WHEN order_key % 9 = 0 THEN {_cents('net_c // 100')} WHEN order_key % 9 = 1 THEN '0' ELSE '' END AS "TDS",
         'Order ' || CAST(order_key AS VARCHAR) AS "Narration",
         CASE WHEN order_key % 19 = 0 THEN '' WHEN order_key % 23 = 0 THEN 'system'
              WHEN order_key % 5 = 0 THEN c_name || ' (AP)' ELSE c_name END AS "Inv Created By",
         strftime(CAST(order_date + 30 AS DATE), '%Y-%m-%d') AS "Due Date",
         CASE order_key % 3 WHEN 0 THEN 'NEFT' WHEN 1 THEN 'RTGS' ELSE '' END AS "Method_of_Payment",
         CASE WHEN order_key % 6 = 0 THEN '' ELSE 'SC-' || CAST(order_key % 1000 AS VARCHAR) END AS "SCID"
  FROM invoices LEFT JOIN customer ON c_custkey = o_custkey""")


_WS = "' ' || chr(9) || chr(10) || chr(13)"
_GST = r"(?i)\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]\b"
_INV_COLS = ["invoice_id", "invoice_number", "vendor_name", "gst_number", "order_date", "invoice_date_raw",
             "net_c", "tax_c", "amount_raw", "lines", "location", "o_custkey", "order_key", "supp_key"]


def _pd(x: str) -> str:
    n = (f"(CASE WHEN lower(trim(CAST({x} AS VARCHAR), {_WS})) IN ('nan','none','null','nat','') THEN NULL "
         f"ELSE trim(CAST({x} AS VARCHAR), {_WS}) END)")
    fmts = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y/%m/%d"]
    return "CAST(coalesce(" + ", ".join(f"try_strptime({n}, '{f}')" for f in fmts) + ") AS DATE)"


register("validations", ("invoices",), f"""
  SELECT invoice_number, vendor_name, amount, 'processed' AS status,
         nullif(concat_ws('; ',
             CASE WHEN amount IS NULL THEN 'Invalid or missing amount' WHEN amount <= 0 THEN 'Zero or negative amount' END,
             CASE WHEN lower(coalesce(vendor_name, '')) IN ('', 'nan', 'unknown') THEN 'Missing vendor information' END), '')
           AS discrepancies,
         'invoices' AS file_path, hash_value, 'production_s1' AS processed_by,
         coalesce(nullif(upper(regexp_extract(gst_number, '{_GST}', 0)), ''),
                  nullif(upper(regexp_extract(vendor_name, '{_GST}', 0)), ''), '') AS gst_no,
         coalesce({_pd('order_date')}, {_pd('invoice_date_raw')}) AS inv_date,
         CAST(NULL AS DATE) AS due_date, 'USD' AS inv_currency,
         coalesce(CASE WHEN lower(trim(location, {_WS})) IN ('nan','none','null','nat','') THEN NULL
                       ELSE trim(location, {_WS}) END, '') AS location,
         '' AS mop, '' AS account_head
  FROM (SELECT trim(invoice_number, {_WS}) AS invoice_number, trim(vendor_name, {_WS}) AS vendor_name,
               TRY_CAST(regexp_replace(amount_raw, '[^0-9.\\-]', '', 'g') AS DECIMAL(18,2)) AS amount,
               sha256(concat_ws(chr(1), {", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(2))" for c in _INV_COLS)})) AS hash_value,
               gst_number, order_date, invoice_date_raw, location
        FROM invoices) t
  WHERE lower(coalesce(invoice_number, '')) NOT IN ('', 'nan')""")


_DELTA = """SELECT invoice_number AS "Invoice No", vendor_name AS "Vendor Name", invoice_date_raw AS "Invoice Date",
       coalesce(gst_number, '') AS "GSTIN", coalesce(substr(gst_number, 3, 10), '') AS "PAN",
       CAST(lines AS VARCHAR) AS "HSN Code", """ + _cents("net_c") + """ AS "Taxable Value",
       amount_raw AS "Total Amount", invoice_id FROM {src}"""
register("dcur", ("snap_cur",), _DELTA.format(src="snap_cur"))
register("dprev", ("snap_prev",), _DELTA.format(src="snap_prev"))
register("runs", (), """SELECT event_id, CAST(ts AS DATE) AS run_date, event_type AS run_type, user_id, value FROM events""")


register("ledger_b3", ("ledger",), "SELECT * REPLACE (" + ", ".join(
    f"""CASE WHEN CAST("InvID" AS BIGINT) // 100000 % 7 = 0 THEN '' ELSE "{c}" END AS "{c}" """
    for c in ["Inv Created By", "Due Date", "State", "Currency", "SCID", "Narration"]) + ") FROM ledger")
register("creator_src", ("invoices",), """SELECT invoice_number AS "Invoice No", c_name AS "Inv Created By", invoice_id
  FROM invoices JOIN customer ON c_custkey = o_custkey WHERE order_key % 3 <> 0""")


def _nt(x: str) -> str:
    return (f"(CASE WHEN lower(trim(CAST({x} AS VARCHAR), {_WS})) IN ('nan','none','null','nat','') THEN NULL "
            f"ELSE trim(CAST({x} AS VARCHAR), {_WS}) END)")


_AMT = """TRY_CAST(regexp_replace("Total", '[^0-9.\\-]', '', 'g') AS DECIMAL(18,2))"""
_DUE = _pd('"Due Date"')
_CRS = f"""trim(regexp_replace(coalesce("Inv Created By", ''), '\\s*\\(.*\\)$', ''), {_WS})"""
register("dashboard", ("ledger",), f"""
  SELECT "InvID" AS "Invoice_ID", "PurchaseInvNo" AS "Invoice_Number", "PartyName" AS "Vendor_Name",
         {_AMT} AS "Amount", {_pd('"PurchaseInvDate"')} AS "Invoice_Date", {_DUE} AS "Due_Date",
         CASE WHEN {_DUE} IS NULL THEN '' WHEN date_diff('day', DATE '2001-07-15', {_DUE}) < 0 THEN 'OVERDUE'
              WHEN date_diff('day', DATE '2001-07-15', {_DUE}) <= 2 THEN 'YES' ELSE 'NO' END AS "Due_Date_Notification",
         coalesce({_nt('"Currency"')}, 'INR') AS "Invoice_Currency",
         coalesce({_nt('"State"')}, CASE WHEN length({_nt('"GSTNO"')}) >= 2 THEN substr({_nt('"GSTNO"')}, 1, 2) END, '')
           AS "Location",
         CASE WHEN {_nt('"Inv Created By"')} IS NULL THEN 'Unknown'
              WHEN {_CRS} = '' OR lower({_CRS}) IN ('n/a','na','null','none','unknown','system') THEN 'System Generated'
              ELSE {_CRS} END AS "Invoice_Creator_Name",
         CASE WHEN {_AMT} IS NULL OR {_nt('"PartyName"')} IS NULL OR {_AMT} <= 0 THEN 'FAIL'
              WHEN {_pd('"PurchaseInvDate"')} IS NULL THEN 'WARNING' ELSE 'PASS' END AS "Validation_Status",
         CASE WHEN {_nt('"GSTNO"')} IS NULL THEN '⚠️ Missing' WHEN regexp_matches("GSTNO", '{_GST}') THEN '✅ Valid'
              ELSE '❌ Invalid' END AS "GST_Validation_Result"
  FROM ledger""")
register("proc_log", (), """
  SELECT event_id AS id, 'S' || CAST(user_id % 10 AS VARCHAR) AS session_id,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'invoice_insert' ELSE 'file_read' END AS operation,
         CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 90 THEN 'warning' ELSE 'success' END AS status,
         event_type AS message, props AS details, ts AS timestamp
  FROM events""")


register("run_log", (), """
  SELECT min(event_id) AS id, run_date - 3 AS start_date, run_date AS end_date, run_date, max(ts) AS run_timestamp,
         run_type, run_date - 3 AS cumulative_start, run_date AS cumulative_end, 1 AS total_days_validated,
         false AS archived, CAST(NULL AS DATE) AS archived_date, max(ts) AS created_at
  FROM (SELECT event_id, ts, CAST(ts AS DATE) AS run_date, event_type AS run_type FROM events)
  GROUP BY run_date, run_type""")
register("run_windows", ("run_log",), """
  SELECT id, start_date, end_date, run_date, run_type, cumulative_start, cumulative_end, total_days_validated,
         archived, archived_date, created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY start_date, end_date, run_date ORDER BY created_at DESC, id DESC) AS rn
    FROM run_log) WHERE rn = 1""")
_HD = _pd("invoice_date_raw")
_HA = "TRY_CAST(regexp_replace(amount_raw, '[^0-9.\\-]', '', 'g') AS DECIMAL(18,2))"
register("history", ("invoices",), f"""
  SELECT invoice_id AS id, invoice_number AS invoice_no, vendor_name, CAST({_HD} AS VARCHAR) AS invoice_date,
         gst_number AS gstin, '' AS pan, '' AS hsn_code, {_HA} AS taxable_value, {_HA} AS total_amount,
         sha256(concat_ws('|', coalesce(invoice_number, ''), coalesce(vendor_name, ''), coalesce(CAST({_HD} AS VARCHAR), ''),
                coalesce(gst_number, ''), '', '', coalesce(CAST({_HA} AS VARCHAR), '0'),
                coalesce(CAST({_HA} AS VARCHAR), '0'))) AS hash,
         CAST(DATE '2024-01-01' + CAST(order_key % 30 AS INTEGER) AS DATE) AS run_date, 'standard' AS run_type,
         CAST(DATE '2024-01-01' + CAST(order_key % 30 AS INTEGER) AS DATE) AS batch_start,
         CAST(DATE '2024-01-01' + CAST(order_key % 30 AS INTEGER) AS DATE) AS batch_end,
         CAST(DATE '2024-01-01' + CAST(order_key % 30 AS INTEGER) AS DATE) AS cumulative_start,
         CAST(DATE '2024-01-01' + CAST(order_key % 30 AS INTEGER) AS DATE) AS cumulative_end,
         false AS archived, CAST(NULL AS DATE) AS archived_date
  FROM invoices""")
register("doc_files", (), """
  SELECT lang AS batch, 'doc_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.pdf' AS name, n_chars AS size, doc_id
  FROM documents""")


def _line(label: str, v: str) -> str:
    return f"'{label}: ' || coalesce(CAST({v} AS VARCHAR), '')"


_AMTF = "format('{:,.2f}', CAST((net_c + tax_c) / 100 AS DECIMAL(18,2)))"
_WHOLEF = "format('{:,d}', CAST((net_c + tax_c) // 100 AS BIGINT))"
_NO, _IID = _line("Invoice No", "invoice_number"), _line("Invoice ID", "invoice_id")
_DT = _line("Date", "strftime(order_date, '%d/%m/%Y')")
_DUE_L = _line("Due Date", "strftime(CAST(order_date + 30 AS DATE), '%d/%m/%Y')")
_GST_L = _line("GSTIN", "gst_number")
_REST = ", ".join([_line("Currency", "'INR'"), _line("Location", "location"), _line("Payment Method", "'NEFT'"),
                   _line("Account Head", "'Purchases'"), _line("SCID", "'SC-' || CAST(order_key % 1000 AS VARCHAR)")])
_TOT, _GRAND = f"'Total: ₹ ' || {_AMTF}", f"'Grand Total: ₹ ' || {_AMTF}"
_TDS_L, _VAT_L = _line("TDS", _cents("net_c // 100")), _line("VAT", _cents("tax_c"))
register("first_inv", ("invoices",), """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY invoice_id) AS rn FROM invoices) WHERE rn = 1""")
register("inv_texts", ("first_inv",), f"""
  SELECT doc_id, lang, CASE WHEN order_key IS NULL THEN text ELSE concat_ws(chr(10),
    CASE doc_id % 4
      WHEN 0 THEN concat_ws(chr(10), {_NO}, {_IID}, {_DT}, {_DUE_L}, {_GST_L}, {_REST}, {_TOT}, {_TDS_L}, {_VAT_L}, {_GRAND})
      WHEN 1 THEN concat_ws(chr(10), {_NO}, {_IID}, {_DUE_L}, {_DT}, {_GST_L}, {_REST}, {_GRAND}, {_TDS_L}, {_VAT_L}, {_TOT})
      WHEN 2 THEN concat_ws(chr(10), {_NO}, {_IID}, {_DT}, {_GST_L}, 'Total: ' || {_WHOLEF})
      ELSE concat_ws(chr(10), {_NO}, {_TOT}) END, text) END AS text
  FROM documents LEFT JOIN first_inv ON doc_id // 2 = order_key AND doc_id % 10 <> 9""")
register("doc_names", ("first_inv",), """
  SELECT doc_id,
         CASE WHEN doc_id % 3 = 0 AND coalesce(invoice_number, '') <> '' THEN invoice_number || '_scan.pdf'
              WHEN doc_id % 3 = 1 THEN 'invoice_' || CAST(doc_id AS VARCHAR) || '.pdf'
              ELSE 'doc_' || CAST(doc_id AS VARCHAR) || '.pdf' END AS name,
         CASE WHEN doc_id % 7 = 0 THEN 500 ELSE n_chars + 1024 END AS size
  FROM documents LEFT JOIN first_inv ON doc_id // 2 = order_key""")
