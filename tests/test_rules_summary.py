"""Rules, mapping and summaries on the reference's sample rows (FIXTURES A1, A6)."""
from decimal import Decimal


from tallyspark.operators import normalize as N
from tallyspark.operators import rules as R
from tallyspark.operators import summary as S

from conftest import rows


def test_map_columns_minimal_export(spark):
    df = spark.createDataFrame([("INV-001", "A", "1000.5"), ("INV-002", "B", "2500.75"), ("INV-003", "C", "750.25")],
                               "Invoice_Number string, Vendor_Name string, Amount string")
    m = N.map_columns(N.clean_headers(df))
    assert m == {"invoice_number": "invoice_number", "vendor": "vendor_name", "amount": "amount"}


def test_map_columns_scored(spark):
    df = spark.createDataFrame([("V1", "Acme Traders", "10.0", "1.8"), ("V2", "Beta Supplies", "20.0", "3.6")],
                               "voucher_ref string, party_label string, grand_amt string, igst_value string")
    m = N.map_columns(df)
    assert m["invoice_number"] == "voucher_ref" and m["vendor"] == "party_label" and m["amount"] == "grand_amt"


def test_clean_headers(spark):
    df = spark.createDataFrame([(" a ", None, "nan", "x"), (None, None, None, None)],
                               "`Inv No` string, `Empty Col` string, `Vendor-Name` string, `inv no` string")
    out = N.clean_headers(df)
    assert out.columns == ["inv_no", "vendor_name"]
    assert rows(out) == [("a", None)]


def test_rules_and_report(spark):
    df = spark.createDataFrame([
        ("INV1", "2024-01-05", "A", "27ABCDE1234F1Z5", "100"), ("INV1", "2024-01-06", "B", "g", "-5"),
        ("", "bad", "", None, "x"), ("INV3", None, "C", "g", "7")],
        "PurchaseInvNo string, PurchaseInvDate string, PartyName string, GSTNO string, Total string")
    r = R.apply_rules(df)
    rep = dict(rows(R.rule_report(r)))
    assert rep["duplicate invoice number"] == 2 and rep["negative amount"] == 1
    assert rep["invalid amount value"] == 1 and rep["invalid date"] == 1
    assert rep["missing value in 'PurchaseInvNo'"] == 1 and rep["missing value in 'PurchaseInvDate'"] == 1
    assert R.rows_with_issues(r).count() == 4                                          # T16: one row each
    q = R.profile_quality(N.clean_headers(df), "purchaseinvno", "total").first()
    assert q["empty_invoice_numbers"] == 1 and q["duplicate_invoice_numbers"] == 1     # T11
    assert q["invalid_amounts"] == 1                                                   # T15: NULL counts


def test_reporter_rows(spark):
    df = spark.createDataFrame([("INV001", 10000, "VALID"), ("INV002", 15000, "FLAGGED"), ("INV003", 8000, "INVALID")],
                               "Invoice_No string, Amount long, Status string")
    st = {r["status"]: (r["count"], r["success_rate"]) for r in S.status_summary(df).collect()}
    assert st["VALID"] == (1, Decimal("33.33")) and st["FLAGGED"][0] == 1 and st["INVALID"][0] == 1
    a = S.amount_stats(df, "Amount").first()
    assert a["total_amount"] == 33000 and a["median_amount"] == 10000.0


def test_median_is_exact_and_mode_ties(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (10, "b")], "x int, v string")
    assert S.amount_stats(df, "x").first()["median_amount"] == 2.5
    assert S.vendor_stats(df, "v").first()["top_vendor"] == "a"


def test_kpi_blank_creator_not_identified(spark):
    df = spark.createDataFrame([("PASS", "INR", "Pune, MH", "YES", ""), ("FAIL", "INR", "Pune", "NO", "Ann"),
                                ("WARNING x", "USD", "Delhi", "OVERDUE", "Unknown")],
                               "Validation_Status string, Invoice_Currency string, Location string, "
                               "Due_Date_Notification string, Invoice_Creator_Name string")
    k = S.kpi_overview(df).first()
    assert (k["passed"], k["failed"], k["warnings"]) == (1, 1, 1)
    assert k["known_creators"] == 1 and k["urgent_payments"] == 2                      # T24
    assert k["locations"] == 2 and k["primary_location"] == "Pune" and k["primary_currency"] == "INR"


def test_normalize_aliases(spark):
    df = spark.createDataFrame([("7", "INV-9", "05/01/2024", "Acme", None, "", "2024-01-11")],
                               "InvID string, PurchaseInvNo string, `Inv Date` string, PartyName string, "
                               "GSTNO string, State string, DueDate string")
    r = N.normalize_aliases(df, "2024-01-10").first()
    assert r["Invoice_ID"] == "7" and r["Invoice_Number"] == "INV-9" and str(r["Invoice_Date"]) == "2024-01-05"
    assert r["Location"] == "" and r["Invoice_Currency"] == "INR" and r["Due_Date_Notification"] == "YES"


def test_rules_of_one_row_are_dealt_as_bits(spark):
    from tallyspark.operators import reconcile as RC, rules as R
    from tallyspark.session import settings
    data = [("A", "2024-01-02", "V", "G", "1.5", 1), ("A", None, "", "G", "x", 2), ("", "soon", "V", None, "-1", 3), ("B", "2024-01-02", "V", "G", "2", 4)]
    df = spark.createDataFrame(data, "PurchaseInvNo string, PurchaseInvDate string, PartyName string, GSTNO string, Total string, _o long")
    out = R.apply_rules(df)
    assert out.columns == df.columns + ["issues"]
    assert {r["_o"]: r["issues"] for r in out.collect()} == {
        1: ["duplicate invoice number"], 4: [],
        2: ["missing value in 'PurchaseInvDate'", "missing value in 'PartyName'", "duplicate invoice number", "invalid amount value"],
        3: ["missing value in 'PurchaseInvNo'", "missing value in 'GSTNO'", "negative amount", "invalid date"]}
    detail = RC.validation_detail(R.mark_rows(out), "PurchaseInvNo", "_o")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = RC.validation_detail(R.mark_rows(R.apply_rules(df)), "PurchaseInvNo", "_o")._jdf.queryExecution().executedPlan().toString()
    # blank numbers are left out before, and the rows with their counts are not dealt a second time
    assert "Union" not in plan and plan.count("Exchange hashpartitioning(") == 2
    assert {r["_inv"]: r["Validation_Status"] for r in detail.collect()} == {"A": "FLAGGED", "B": "VALID"}
