"""Expression library on hand-written trap rows."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.functions import exprs as X


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_parse_date_formats_and_order(spark):
    assert one(spark, X.parse_date("x"), "2024-01-05") == dt.date(2024, 1, 5)
    assert one(spark, X.parse_date("x"), "05/01/2024") == dt.date(2024, 1, 5)     # T3: d/m before m/d
    assert one(spark, X.parse_date("x"), "5/1/2024") == dt.date(2024, 1, 5)       # one-digit d/M
    assert one(spark, X.parse_date("x"), "12/31/2024") == dt.date(2024, 12, 31)   # falls to m/d
    assert one(spark, X.parse_date("x"), "05-01-2024") == dt.date(2024, 1, 5)
    assert one(spark, X.parse_date("x"), "2024/01/05") == dt.date(2024, 1, 5)
    assert one(spark, X.parse_date("x"), "31/02/2024") is None
    assert one(spark, X.parse_date("x"), "not-a-date") is None
    assert one(spark, X.parse_date("x"), " NaT ") is None


def test_parse_amount_traps(spark):
    assert one(spark, X.parse_amount("x"), "(100)") == Decimal("100.00")          # T4 kept
    assert one(spark, X.parse_amount("x"), "Rs. (1,250.00)") is None              # '.1250.00'
    assert one(spark, X.parse_amount("x"), "1.250,00") == Decimal("1.25")
    assert one(spark, X.parse_amount("x"), "₹ 1,234.50") == Decimal("1234.50")
    assert one(spark, X.parse_amount("x"), "N/A") is None
    assert one(spark, X.parse_number_or_zero("x"), "18%") == Decimal("0.00")      # T31


def test_location_and_null_tokens(spark):
    df = spark.createDataFrame([(None, None), ("", "27ABCDE1234F1Z5"), ("nan", None), ("Pune", "x")], "s string, g string")
    got = [r[0] for r in df.select(X.derive_location("s", "g")).collect()]
    assert got == ["", "27", "", "Pune"]                                           # T5 fixed


def test_creator_and_status(spark):
    assert one(spark, X.clean_creator("x"), "o'neil jean-luc (HR)") == "O'neil Jean-luc"  # T9 initcap
    assert one(spark, X.clean_creator("x"), "system") == "System Generated"
    assert one(spark, X.clean_creator("x"), None) == "System Generated"
    assert one(spark, X.standardize_status(status="x"), "✅ VALID") == "VALID"     # T22
    assert one(spark, X.standardize_status(status="x"), "issues found") == "FLAGGED"
    assert one(spark, X.standardize_status(status="x"), "error") == "INVALID"
    assert one(spark, X.standardize_status(status="x"), "weird") == "UNKNOWN"
    assert one(spark, X.standardize_status(issues="x"), None) == "VALID"
    assert one(spark, X.standardize_status(issues="x"), "bad") == "FLAGGED"


def test_due_alert_and_tax(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 12),), (dt.date(2024, 1, 13),), (None,)], "d date")
    assert [r[0] for r in df.select(X.due_alert("d", "2024-01-10")).collect()] == ["OVERDUE", "YES", "NO", ""]
    t = spark.createDataFrame([(0, 0, 5, 0), (1, 1, 0, 0), (0, 0, 0, 3), (0, 0, 0, 0)], "c int, s int, i int, v int")
    assert [r[0] for r in t.select(X.tax_type("c", "s", "i", "v")).collect()] == ["IGST", "GST", "VAT", ""]
    tds = spark.createDataFrame([("12.5",), ("0",), ("pending",), (None,)], "x string")
    assert [r[0] for r in tds.select(X.tds_status("x")).collect()] == ["Deducted", "Not Deducted", "pending", "Not Deducted"]


def test_gst_and_hash(spark):
    assert one(spark, X.extract_gst("x"), "vendor 27abcde1234f1z5 ltd") == "27ABCDE1234F1Z5"
    assert one(spark, X.extract_gst("x"), "no gst here") == ""
    a = one(spark, X.row_hash("x"), "a")
    assert a == one(spark, X.row_hash("x"), "a") and len(a) == 64                 # T13: stable
    assert one(spark, X.pct(F.lit(1), F.lit(3)), None) == Decimal("33.33")


def test_discrepancies(spark):
    df = spark.createDataFrame([(None, "A"), (Decimal("-1"), ""), (Decimal("5"), "unknown"), (Decimal("5"), "B")],
                               "a decimal(18,2), v string")
    got = [r[0] for r in df.select(X.discrepancies("a", "v")).collect()]
    assert got == ["Invalid or missing amount", "Zero or negative amount; Missing vendor information",
                   "Missing vendor information", None]


def test_header_tokens():
    assert not X.header_matches("updated_at", ["date"])                             # T2 fixed
    assert X.header_matches("invoice_date", ["date"])
    assert not X.header_matches("rating", ["tin"])
    assert X.header_matches("due_date", ["due_date"])


def test_json_records_of_any_shape(spark):
    import datetime as dt
    import json
    from decimal import Decimal

    from tallyspark.functions.json_safe import to_json_records
    schema = ("`a.b` double, f float, d date, t timestamp, n decimal(20,4), raw binary, m map<double,array<double>>, "
              "s struct<x:struct<y:array<date>>,z:map<string,double>>, e array<string>, b boolean")
    nan, inf = float("nan"), float("inf")
    row = (nan, -inf, dt.date(2024, 1, 5), dt.datetime(2024, 1, 5, 1, 2, 3, 40), Decimal("12345678901234.5000"), b"ab", {1.5: [1.0, nan, None], inf: None},
           (([dt.date(2024, 1, 6), None],), {"k": inf}), [], True)
    got = [json.loads(r[0], parse_float=str) for r in to_json_records(spark.createDataFrame([row, (None,) * 10], schema)).collect()]
    assert got[0] == {"a.b": None, "f": None, "d": "2024-01-05", "t": "2024-01-05 01:02:03.00004", "n": "12345678901234.5000", "raw": "YWI=",
                      "m": {"1.5": ["1.0", None, None], "Infinity": None},
                      "s": {"x": {"y": ["2024-01-06", None]}, "z": {"k": None}}, "e": [], "b": True}
    assert got[1] == dict.fromkeys(got[0])
