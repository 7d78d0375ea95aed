"""Fixed values that must equal the reference's for the same results.

Fixed values (alias lists, header tokens, patterns, maps, limits), in the
reference's order.
"""

# --- fixed values: logical field -> header aliases (exact first, then case-insensitive) ---
ALIASES = {
    "invoice_id": ["Invoice Id", "InvID", "InvoiceID", "ID"],
    "invoice_number": ["Invoice#", "PurchaseInvNo", "InvoiceNumber", "InvNo", "BillNo"],
    "invoice_date": ["Inv Date", "PurchaseInvDate", "InvoiceDate", "InvDate", "BillDate"],
    "vendor_name": ["Vendor", "PartyName", "VendorName", "SupplierName"],
    "gstin": ["GSTNo", "GSTNO", "GSTIN", "GST No", "GST_No"],
    "amount": ["Invoice Amount", "Total", "Amount", "GrandTotal", "NetAmount"],
    "creator": ["Inv Created By", "Inv Created by", "InvCreatedBy", "CreatedBy", "UserName", "EntryBy", "PreparedBy"],
    "mop": ["MOP", "Method of Payment", "PaymentMethod", "PayMode", "Payment_Mode", "PaymentType"],
    "due_date": ["DueDate", "Due Date", "PaymentDue", "MaturityDate"],
    "remarks": ["Remarks", "Remark", "Notes", "Comments", "Narration"],
    "state": ["Location", "State", "PartyState", "Branch"],
    "currency": ["Inv Currency", "InvoiceCurrency", "Currency", "InvCurrency"],
    "scid": ["SCID#", "SCID", "SC Id", "SalesContractId", "SaleContractID"],
}
DEFAULT_CURRENCY_NORMALIZE = "INR"

# --- fixed values: columns filled from a second source ---
FILL_COLUMNS = ["Invoice_Creator_Name", "Method_of_Payment", "Due_Date", "Location",
                "Invoice_Currency", "SCID", "Remarks"]

# --- fixed values: header tokens of the first-match extractors ---
GST_TOKENS = ["gst", "gstin", "gst_no", "gstnumber", "tax_id", "tin"]
INVOICE_DATE_TOKENS = ["invoice_date", "inv_date", "bill_date", "date", "created_date"]
DUE_DATE_TOKENS = ["due", "due_date", "payment_due", "pay_date", "expiry"]
CURRENCY_TOKENS = ["currency", "curr", "ccy", "cur_code"]
LOCATION_TOKENS = ["location", "site", "branch", "office", "city", "state"]
MOP_TOKENS = ["payment", "pay_method", "mop", "method", "pay_mode"]
ACCOUNT_TOKENS = ["account", "acc_head", "gl_code", "cost_center", "dept"]
DEFAULT_CURRENCY_EXTRACT = "USD"

# --- fixed values: scored column mapping ---
MAP_EXACT = {
    "invoice_number": ["invoice_number", "invoice number", "invoice_no", "invoice no", "inv_no", "inv no",
                       "inv_num", "inv#", "invoiceid", "voucherno", "voucher_no", "doc_no", "document_no",
                       "purchaseinvno"],
    "vendor": ["vendor", "vendor_name", "vendor name", "supplier", "supplier_name", "supplier name",
               "partyname", "party", "payee", "company", "beneficiary"],
    "amount": ["amount", "invoice_amount", "invoice amount", "total", "total_amount", "grand_total",
               "net_amount", "gross_amount", "paytyamt", "taxablevalue"],
}
MAP_SYNONYMS = {
    "invoice_number": ["invoice", "inv", "voucher", "doc", "bill"],
    "vendor": ["vendor", "supplier", "party", "company", "payee", "beneficiary"],
    "amount": ["amount", "total", "grand", "value", "sum", "amt"],
}
MAP_BAD_WORDS = {
    "invoice_number": ["date", "time", "entry", "created", "updated", "month", "year"],
    "vendor": ["address", "gst", "pan", "state", "city", "country", "code", "id"],
    "amount": ["igst", "cgst", "sgst", "vat", "tax", "tds", "discount", "round", "roundoff", "cess",
               "rate", "qty", "quantity", "price_per", "unit"],
}

# points of a scored candidate: (points, test, argument); "name": the header holds one of the words
MAP_POINTS = {
    "invoice_number": [(3, "name", ["no", "num", "id", "#"]), (2, "name", ["invoice", "voucher", "doc"]),
                       (1, "numeric_below", 1.0), (1, "numeric_below", 0.5)],
    "vendor": [(2, "name", ["vendor", "supplier", "party", "company"]), (2, "numeric_below", 1.0), (1, "length_from", 6.0)],
    "amount": [(3, "name", ["grand"]), (2, "name", ["total"]), (1, "name", ["amount", "amt", "value"]), (3, "numeric_from", 0.6)],
}

# --- fixed values: patterns ---
GSTIN_RE = r"(?i)\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]\b"
EMAIL_RE = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
EMAIL_SCAN_RE = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
AMT = r"[₹$€£]?\s*([\d,]+\.\d{2}|\d+)"
DT = r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}\s+[A-Za-z]{3,}\s+\d{2,4})"
DOC_FIELD_PATTERNS = [
    ("Invoice_Number", r"Invoice\s*No\.?:?\s*([A-Za-z0-9\-/]+)", False),
    ("Invoice_Date", r"Date\s*:?\s*" + DT, False),
    ("Amount", r"Total\s*:?\s*" + AMT, True),
    ("GST_Number", r"GSTIN\s*:?\s*([0-9A-Z]{15})", False),
    ("Invoice_Currency", r"Currency\s*:?\s*([A-Z]{3})", False),
    ("TDS", r"TDS\s*:?\s*" + AMT, True),
    ("VAT", r"VAT\s*:?\s*" + AMT, True),
    ("Total_Invoice_Value", r"Grand Total\s*:?\s*" + AMT, True),
    ("Location", r"Location\s*:?\s*([A-Za-z, ]+)", False),
    ("Due_Date", r"Due Date\s*:?\s*" + DT, False),
    ("Invoice_ID", r"Invoice ID\s*:?\s*([A-Za-z0-9\-/]+)", False),
    ("MOP", r"Payment Method\s*:?\s*([A-Za-z ]+)", False),
    ("AH", r"Account Head\s*:?\s*([A-Za-z0-9 ]+)", False),
    ("SCID", r"SCID\s*:?\s*([A-Za-z0-9\-]+)", False),
]  # (field, pattern, commas removed)

# --- fixed values: date formats tried in order (Y-m-d, d/m/Y, m/d/Y, d-m-Y, Y/m/d) ---
DATE_FORMATS = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "yyyy/M/d"]

# --- fixed values: status map and rules ---
STATUS_MAP = {"VALID": "VALID", "INVALID": "INVALID", "FLAGGED": "FLAGGED", "NEW": "FLAGGED",
              "ISSUES FOUND": "FLAGGED", "UNKNOWN": "UNKNOWN", "ERROR": "INVALID"}
REQUIRED_COLUMNS = ["PurchaseInvNo", "PurchaseInvDate", "PartyName", "GSTNO", "Total"]
KEY_CANDIDATES_CHOOSE = ["InvID", "Invoice_No", "PurchaseInvNo", "VoucherNo", "Voucher_No"]
KEY_CANDIDATES_LIST = ["InvID", "Invoice_No", "PurchaseInvNo", "VoucherNo", "ID"]
KEY_RATIO = 0.8
MATCH_COLUMNS = ["PurchaseInvNo", "VoucherNo", "InvID"]
CREATOR_NULL_LIKE = ["n/a", "na", "null", "none", "unknown", "system"]
NULL_TOKENS = ["nan", "none", "null", "nat", ""]
AMOUNT_MIN, AMOUNT_MAX = 0, 1_000_000
DUE_ALERT_DAYS = 2
WINDOW_DAYS, RETAIN_DAYS, PURGE_DAYS = 3, 30, 90
COMPLETENESS_THRESHOLD = 0.95
ATTACHMENT_CAP_BYTES = 18 * 1024 * 1024
ARCHIVE_CAP_BYTES = 24 * 1024 * 1024
DOC_MAX_BYTES = 50 * 1024 * 1024
DOC_MIN_BYTES = 1024
ARCHIVE_MIN_BYTES = 100
EXPORT_MIN_BYTES = 50
DOC_MAX_CHARS = 100_000
FIELDS_ENOUGH = 5
REPORT_NAME_WORDS = ["validation", "invoice", "summary", "report"]
DELTA_KEYS = ["Invoice No", "Vendor Name", "Invoice Date"]
DELTA_COMPARE = ["GSTIN", "PAN", "HSN Code", "Taxable Value", "Total Amount"]
DISC_BAD_AMOUNT = "Invalid or missing amount"
DISC_NONPOSITIVE = "Zero or negative amount"
DISC_NO_VENDOR = "Missing vendor information"
