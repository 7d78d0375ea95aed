"""At-scale fixtures derived with Spark from the driver tables (FIXTURES.md §B).

Every fixture is a pure function of the input tables, so its size grows with
them.  Faults are injected by fixed modulus rules on the order key so that the
DuckDB oracle (``plans/oracle.py``) can derive the very same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_table, table

# Fixed values of the fixture (FIXTURES.md B1/B2): fault moduli on the order key k.
BLANK_NUMBER_MOD = 97
SHORT_NUMBER_MOD = 89
BLANK_VENDOR_MOD = 83
NULL_GST_MOD = 79
BAD_DATE_MOD = 73
NA_AMOUNT_MOD = 71
NEG_AMOUNT_MOD = 67
RUPEE_PREFIX_MOD = 4
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd"]  # by k % 5


def invoice_lines(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """Per (order, supplier): exact cents of net and tax over its lines; of the orders ``wanted`` (``order_key``) only."""
    li = table(spark, sf_dir, "lineitem")
    if wanted is not None:
        li = li.join(wanted, F.col("l_orderkey") == F.col("order_key"), "left_semi")
    # prices have 2 decimals, rates are whole percents: exact integer arithmetic, rounded half up
    base = "cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as int))"
    net = F.expr(f"({base} + 50) div 100")
    tax = F.expr(f"({base} * cast(round(l_tax * 100) as int) + 5000) div 10000")
    # dealt by order once, for the sums and for the join with the orders
    li = li.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("v"), net.alias("net_c"), tax.alias("tax_c")).repartition("k")
    return li.groupBy("k", "v").agg(F.sum("net_c").alias("net_c"), F.sum("tax_c").alias("tax_c"), F.count(F.lit(1)).alias("lines"))


def invoices(spark: SparkSession, sf_dir: str, customers: str | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """B1: one raw invoice export row per (l_orderkey, l_suppkey), all text as exported; ``customers`` (inner or left) adds
    the ``c_name`` of the order's customer, joined to the orders before their rows are many.  Only those of the orders
    ``wanted`` (``order_key``), if given."""
    g = invoice_lines(spark, sf_dir, wanted)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("order_date"), "o_custkey")
    if customers:
        orders = orders.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", customers)
    # nation has a fixed 25 rows at every scale factor: a safe broadcast.
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    supp = (table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("v"), "s_name", "s_nationkey")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey")))
    k, v = F.col("k"), F.col("v")
    cents = F.col("net_c") + F.col("tax_c")
    whole = F.expr("cast((net_c + tax_c) div 100 as string)")
    frac = F.lpad((cents % 100).cast("string"), 2, "0")
    fmt = F.col("order_date")
    date_txt = F.when(k % BAD_DATE_MOD == 0, F.lit("not-a-date"))
    for i, f in enumerate(DATE_FORMATS):
        date_txt = date_txt.when(k % 5 == i, F.date_format(fmt, f))
    amount_txt = (F.when(k % NA_AMOUNT_MOD == 0, F.lit("N/A"))
                   .otherwise(F.concat(F.when(k % RUPEE_PREFIX_MOD == 0, F.lit("₹ ")).otherwise(F.lit("")),
                                       F.when(k % NEG_AMOUNT_MOD == 0, F.concat(F.lit("-"), whole, F.lit(".00")))
                                        .otherwise(F.concat(whole, F.lit("."), frac)))))
    return (g.join(orders, "k").join(supp, "v")
             .select(
                 (k * 100000 + v).alias("invoice_id"),
                 F.when(k % BLANK_NUMBER_MOD == 0, F.lit(""))
                  .when(k % SHORT_NUMBER_MOD == 0, F.concat(F.lit("INV-"), k.cast("string")))
                  .otherwise(F.concat(F.lit("INV-"), k.cast("string"), F.lit("-"), v.cast("string")))
                  .alias("invoice_number"),
                 F.when(k % BLANK_VENDOR_MOD == 0, F.lit("")).otherwise(F.col("s_name")).alias("vendor_name"),
                 F.when(k % NULL_GST_MOD == 0, F.lit(None).cast("string"))
                  .otherwise(F.concat((F.col("n_nationkey") + 10).cast("string"), F.lit("ABCDE"),
                                      F.lpad((v % 10000).cast("string"), 4, "0"), F.lit("F1Z5")))
                  .alias("gst_number"),
                 "order_date",
                 date_txt.alias("invoice_date_raw"),
                 "net_c", "tax_c",
                 amount_txt.alias("amount_raw"),
                 "lines",
                 F.col("n_name").alias("location"),
                 "o_custkey",
                 k.alias("order_key"), v.alias("supp_key"), *(["c_name"] if customers else [])))


def snapshot_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """B2: (current, previous) snapshots of B1 keyed on invoice_id."""
    inv = stage_table(invoices(spark, sf_dir), "snapshots", "zstd")  # both sides are read several times
    k = F.col("order_key")
    current = (inv.where(k % 13 != 0)
                  .withColumn("net_c", F.when(k % 17 == 0, F.col("net_c") + 100).otherwise(F.col("net_c"))))
    previous = inv.where(k % 11 != 0)
    return current, previous


def _cents_text(c) -> "F.Column":
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.floor(c / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((c % 100).cast("string"), 2, "0"))


# Column names of the ledger export (FIXTURES A3), kept as spelled there.
LEDGER_COLUMNS = ["InvID", "VoucherNo", "Voucherdate", "PurchaseInvNo", "PurchaseInvDate", "PartyName",
                  "GSTNO", "State", "PurchaseLEDGER", "TaxableValue", "Total", "Currency",
                  "IGST/VATInputAmt", "CGSTInputAmt", "SGSTInputAmt", "VAT", "TDS", "Narration",
                  "Inv Created By", "Due Date", "Method_of_Payment", "SCID"]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3-style ledger export derived from B1: all text, as a purchase register exports it."""
    inv = invoices(spark, sf_dir, customers="left")
    k = F.col("order_key")
    tax = F.col("tax_c")
    creator = (F.when(k % 19 == 0, F.lit("")).when(k % 23 == 0, F.lit("system"))
                .when(k % 5 == 0, F.concat(F.col("c_name"), F.lit(" (AP)"))).otherwise(F.col("c_name")))
    return inv.select(
        F.col("invoice_id").cast("string").alias("InvID"),
        F.concat(F.lit("V"), F.col("invoice_id").cast("string")).alias("VoucherNo"),
        F.date_format(F.date_add("order_date", (k % 7).cast("int")), "yyyy-MM-dd").alias("Voucherdate"),
        F.col("invoice_number").alias("PurchaseInvNo"),
        F.col("invoice_date_raw").alias("PurchaseInvDate"),
        F.col("vendor_name").alias("PartyName"),
        F.col("gst_number").alias("GSTNO"),
        F.when(k % 31 == 0, F.lit("")).otherwise(F.col("location")).alias("State"),
        F.when(k % 3 == 0, F.lit("Purchase Goods")).when(k % 3 == 1, F.lit("Purchase Services"))
         .otherwise(F.lit("Import Purchase")).alias("PurchaseLEDGER"),
        _cents_text("net_c").alias("TaxableValue"),
        F.col("amount_raw").alias("Total"),
        F.when(k % 5 == 0, F.lit("USD")).when(k % 5 == 1, F.lit("")).otherwise(F.lit("INR")).alias("Currency"),
        F.when(k % 4 == 0, _cents_text(tax)).otherwise(F.lit("0")).alias("IGST/VATInputAmt"),
        F.when(k % 4 == 1, _cents_text(F.floor(tax / 2))).otherwise(F.lit("0")).alias("CGSTInputAmt"),
        F.when(k % 4 == 1, _cents_text(tax - F.floor(tax / 2))).otherwise(F.lit("0")).alias("SGSTInputAmt"),
        F.when(k % 4 == 2, F.when(k % 53 == 0, F.lit("18%")).otherwise(_cents_text(tax)))
         .otherwise(F.lit("")).alias("VAT"),
        F.when(k % 9 == 0, _cents_text(F.floor(F.col("net_c") / 100))).when(k % 9 == 1, F.lit("0"))
         .otherwise(F.lit("")).alias("TDS"),
        F.concat(F.lit("Order "), k.cast("string")).alias("Narration"),
        creator.alias("Inv Created By"),
        F.date_format(F.date_add("order_date", 30), "yyyy-MM-dd").alias("Due Date"),
        F.when(k % 3 == 0, F.lit("NEFT")).when(k % 3 == 1, F.lit("RTGS")).otherwise(F.lit("")).alias("Method_of_Payment"),
        F.when(k % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("SC-"), (k % 1000).cast("string"))).alias("SCID"),
    )


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main pipeline over B1: mapped columns, skipped blank numbers, parsed amounts,
    discrepancies, extracted fields and a stable row hash."""
    from ..operators.normalize import map_columns
    from ..operators.rules import to_validations
    inv = invoices(spark, sf_dir)
    return to_validations(inv, map_columns(inv), session_id="s1", source_file="invoices")


def delta_frame(df: DataFrame) -> DataFrame:
    """B1 rows in the column names of the composite-key delta export (FIXTURES A5)."""
    return df.select(
        F.col("invoice_number").alias("Invoice No"), F.col("vendor_name").alias("Vendor Name"),
        F.col("invoice_date_raw").alias("Invoice Date"), F.coalesce("gst_number", F.lit("")).alias("GSTIN"),
        F.coalesce(F.substring("gst_number", 3, 10), F.lit("")).alias("PAN"),
        F.col("lines").cast("string").alias("HSN Code"), _cents_text("net_c").alias("Taxable Value"),
        F.col("amount_raw").alias("Total Amount"), "invoice_id")


def run_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6: events as dated runs (run_date = date(ts), run_type = event_type)."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.to_date("ts").alias("run_date"), F.col("event_type").alias("run_type"), "user_id", "value")


B3_BLANKED = ["Inv Created By", "Due Date", "State", "Currency", "SCID", "Narration"]


def ledger_b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 main side: the ledger with the fill fields blanked where k % 7 = 0."""
    return ledger_b3_from(ledger(spark, sf_dir))


def ledger_b3_from(led: DataFrame) -> DataFrame:
    k7 = F.floor(F.col("InvID").cast("long") / 100000) % 7 == 0
    return led.withColumns({c: F.when(k7, F.lit("")).otherwise(F.col(f"`{c}`")) for c in B3_BLANKED})


def creator_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10-style creator map (``Invoice No``, ``Inv Created By``) from orders' customers."""
    inv = invoices(spark, sf_dir, customers="inner")
    return (inv.where(F.col("order_key") % 3 != 0)
            .select(F.col("invoice_number").alias("Invoice No"), F.col("c_name").alias("Inv Created By"),
                    "invoice_id"))


DASH_AS_OF = "2001-07-15"


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8-style dashboard rows derived from the ledger: typed values, row status
    PASS / WARNING / FAIL, GST check text, due alert against ``DASH_AS_OF``."""
    from ..functions import constants as K
    from ..functions import exprs as X
    led = ledger(spark, sf_dir)
    amt = X.parse_amount("Total")
    d = X.parse_date("PurchaseInvDate")
    due = X.parse_date(F.col("`Due Date`"))
    status = (F.when(amt.isNull() | X.is_blank("PartyName") | (amt <= 0), F.lit("FAIL"))
               .when(d.isNull(), F.lit("WARNING")).otherwise(F.lit("PASS")))
    gst = (F.when(X.is_blank("GSTNO"), F.lit("⚠️ Missing")).when(F.col("GSTNO").rlike(K.GSTIN_RE), F.lit("✅ Valid"))
            .otherwise(F.lit("❌ Invalid")))
    creator = F.when(X.is_blank(F.col("`Inv Created By`")), F.lit("Unknown")).otherwise(
        X.clean_creator(F.col("`Inv Created By`"), title=False))
    return led.select(
        F.col("InvID").alias("Invoice_ID"), F.col("PurchaseInvNo").alias("Invoice_Number"),
        F.col("PartyName").alias("Vendor_Name"), amt.alias("Amount"), d.alias("Invoice_Date"), due.alias("Due_Date"),
        X.due_alert(due, DASH_AS_OF).alias("Due_Date_Notification"),
        F.coalesce(X.null_tokens("Currency"), F.lit("INR")).alias("Invoice_Currency"),
        X.derive_location("State", "GSTNO").alias("Location"), creator.alias("Invoice_Creator_Name"),
        status.alias("Validation_Status"), gst.alias("GST_Validation_Result"))


def processing_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11-style processing log from events: session, operation, status, message."""
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("session_id"),
        F.when(et.isin("click", "purchase"), F.lit("invoice_insert")).otherwise(F.lit("file_read")).alias("operation"),
        F.when(et == "error", F.lit("failed")).when(F.col("value") > 90, F.lit("warning"))
         .otherwise(F.lit("success")).alias("status"),
        et.alias("message"), F.col("props").alias("details"), F.col("ts").alias("timestamp"))


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.to_date("ts").alias("run_date"), F.col("event_type").alias("run_type"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 run_log: one run per (date(events.ts), event_type)."""
    from ..operators.ledger import run_log_from
    return run_log_from(run_events(spark, sf_dir))


def run_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ledger import upsert_run_windows
    return upsert_run_windows(None, run_log(spark, sf_dir))


HISTORY_START = "2024-01-01"


def history_run_date() -> "F.Column":
    return F.date_add(F.lit(HISTORY_START).cast("date"), (F.col("order_key") % 30).cast("int"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 invoice_snapshots: B1 invoices spread over 30 run dates."""
    from ..operators.ledger import history_rows
    return history_rows(invoices(spark, sf_dir), history_run_date())


def files_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachment-like files: one per document, batched by language, sized by text length."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("batch"),
                    F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".pdf")).alias("name"),
                    F.col("n_chars").alias("size"), "doc_id")


def _fmt_date(c) -> "F.Column":
    return F.date_format(c, "dd/MM/yyyy")


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: documents with a labelled invoice header (invoice of order doc_id div 2; none
    when doc_id % 10 = 9).  Four header layouts by doc_id % 4; layout 1 puts Grand Total
    before Total and Due Date before Date (T19); layout 2 writes the total without cents."""
    from ..operators.common import first_per_key
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    wanted = docs.select(F.floor(F.col("doc_id") / 2).alias("order_key")).distinct()
    inv = first_per_key(invoices(spark, sf_dir, wanted=wanted), ["order_key"], ["invoice_id"])
    j = docs.join(inv, (F.floor(F.col("doc_id") / 2) == F.col("order_key")) & (F.col("doc_id") % 10 != 9), "left")
    cents = F.col("net_c") + F.col("tax_c")
    amt = F.format_number((cents / 100).cast("decimal(18,2)"), 2)
    whole = F.format_number(F.floor(cents / 100).cast("decimal(18,0)"), 0)
    line = lambda label, v: F.concat(F.lit(label + ": "), F.coalesce(v.cast("string"), F.lit("")))
    no = line("Invoice No", F.col("invoice_number"))
    iid = line("Invoice ID", F.col("invoice_id"))
    dt = line("Date", _fmt_date(F.col("order_date")))
    due = line("Due Date", _fmt_date(F.date_add("order_date", 30)))
    gst = line("GSTIN", F.col("gst_number"))
    rest = [line("Currency", F.lit("INR")), line("Location", F.col("location")), line("Payment Method", F.lit("NEFT")),
            line("Account Head", F.lit("Purchases")),
            line("SCID", F.concat(F.lit("SC-"), (F.col("order_key") % 1000).cast("string")))]
    total = F.concat(F.lit("Total: ₹ "), amt)
    grand = F.concat(F.lit("Grand Total: ₹ "), amt)
    tds = line("TDS", _cents_text(F.floor(F.col("net_c") / 100)))
    vat = line("VAT", _cents_text("tax_c"))
    lay = F.col("doc_id") % 4
    header = (F.when(lay == 0, F.concat_ws("\n", no, iid, dt, due, gst, *rest, total, tds, vat, grand))
               .when(lay == 1, F.concat_ws("\n", no, iid, due, dt, gst, *rest, grand, tds, vat, total))
               .when(lay == 2, F.concat_ws("\n", no, iid, dt, gst, F.concat(F.lit("Total: "), whole)))
               .otherwise(F.concat_ws("\n", no, total)))
    text = F.when(F.col("order_key").isNull(), F.col("text")).otherwise(F.concat_ws("\n", header, F.col("text")))
    return j.select("doc_id", "lang", text.alias("text"))


def doc_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachment names: the B4 invoice number in the name, a generic invoice-like name,
    or an unrelated name, by doc_id % 3; small files every 7th document."""
    from ..operators.common import first_per_key
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    inv = first_per_key(invoices(spark, sf_dir), ["order_key"], ["invoice_id"]).select("order_key", "invoice_number")
    j = docs.join(inv, F.floor(F.col("doc_id") / 2) == F.col("order_key"), "left")
    name = (F.when((F.col("doc_id") % 3 == 0) & (F.coalesce(F.col("invoice_number"), F.lit("")) != ""),
                   F.concat(F.col("invoice_number"), F.lit("_scan.pdf")))
             .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("invoice_"), F.col("doc_id").cast("string"), F.lit(".pdf")))
             .otherwise(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))))
    size = F.when(F.col("doc_id") % 7 == 0, F.lit(500)).otherwise(F.col("n_chars") + 1024)
    return j.select("doc_id", name.alias("name"), size.alias("size"))


def remove_tree(spark, path: str) -> None:
    """Delete a folder of a query's own scratch space, wherever it is stored."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def rename_files(spark, folder: str, name_of, modified: int | None = None) -> None:
    """Renames the part files in a folder of a query's own scratch space, and sets when they were modified (seconds)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.listStatus(path(folder)):
        old = status.getPath().getName()
        if old.startswith("part-"):
            new = path(f"{folder}/{name_of(old)}")
            store.rename(status.getPath(), new)
            if modified is not None:
                store.setTimes(new, modified * 1000, -1)
