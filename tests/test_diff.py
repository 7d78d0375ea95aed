"""Change tracking on the golden snapshot pair and invariants (FIXTURES A4/A5, T6/T8/T10/T12)."""
from tallyspark.operators import diff as D

from conftest import rows

CUR = [("INV001", "ABC Corp", 10000, "VALID"), ("INV002", "XYZ Ltd", 15000, "FLAGGED"),
       ("INV003", "DEF Inc", 8000, "VALID"), ("INV004", "GHI Co", 12000, "VALID")]
PREV = [("INV001", "ABC Corp", 10000, "VALID"), ("INV002", "XYZ Limited", 15000, "VALID"),
        ("INV005", "OLD Vendor", 5000, "VALID")]
S = "InvID string, Vendor string, Amount long, Status string"


def test_golden_snapshot_pair(spark):
    d = D.snapshot_diff(spark.createDataFrame(CUR, S), spark.createDataFrame(PREV, S), "InvID")
    assert rows(d, "InvID", "change_type", "changed_columns") == [
        ("INV001", "unchanged", ""), ("INV002", "modified", "Vendor, Status"), ("INV003", "added", ""),
        ("INV004", "added", ""), ("INV005", "deleted", "")]
    stats = dict(rows(D.change_stats(d)))
    assert stats == {"added": 2, "modified": 1, "deleted": 1, "unchanged": 1}


def test_self_diff_and_empty_current(spark):
    c = spark.createDataFrame(CUR, S)
    assert {r[0] for r in D.change_stats(D.snapshot_diff(c, c, "InvID")).collect()} == {"unchanged"}
    empty = spark.createDataFrame([], S)
    d = D.snapshot_diff(empty, spark.createDataFrame(PREV, S), "InvID")
    assert dict(rows(D.change_stats(d))) == {"deleted": 3}                            # T6 fixed


def test_canonical_numbers_blank_and_duplicate_keys(spark):
    s = "InvID string, Amount string"
    cur = spark.createDataFrame([("A", "10000"), ("", "5"), ("B", "1"), ("B", "2")], s)
    prev = spark.createDataFrame([("A", "10000.0"), ("", "5"), ("B", "1")], s)
    d = D.snapshot_diff(cur, prev, "InvID")
    got = rows(d, "InvID", "Amount", "change_type")
    assert ("A", "10000", "unchanged") in got                                           # T12 fixed
    assert ("", "5", "unkeyed") in got                                                  # T8
    # first current row of B equals previous -> every current row of B is unchanged
    assert [g for g in got if g[0] == "B"] == [("B", "1", "unchanged"), ("B", "2", "unchanged")]


def test_delta_with_reason(spark):
    cols = ["Invoice No", "Vendor Name", "Invoice Date", "GSTIN", "PAN", "HSN Code", "Taxable Value", "Total Amount"]
    s = ", ".join(f"`{c}` string" for c in cols)
    prev = spark.createDataFrame([("1", "A", "d", "g", "p", "h", "10", "12"), ("2", "B", "d", "g", "p", "h", "1", "1"),
                                  ("3", "C", "d", "g", "p", "h", "1", "1")], s)
    cur = spark.createDataFrame([("1", "A", "d", "g", "p", "h", "11", "13"), ("2", "B", "d", "g", "p", "h", "1", "1"),
                                 ("4", "D", "d", "g", "p", "h", "1", "1"), ("4", "D", "d", "x", "p", "h", "1", "1")], s)
    got = rows(D.delta_with_reason(cur, prev), "Invoice No", "Status", "Reason", "dup_rows")
    assert got == [("1", "Modified", "Taxable Value changed, Total Amount changed", 1),
                   ("3", "Deleted", "Missing in current file", 1),
                   ("4", "New Upload", "Not found in previous file", 2)]                 # T10: first kept


def test_detect_and_choose_key(spark):
    df = spark.createDataFrame([(str(i), "X" if i < 5 else str(i)) for i in range(10)], "InvID string, VoucherNo string")
    assert D.choose_key(df, df) == "InvID"
    r = {x["column_name"]: x["choose_ok"] for x in D.detect_keys(df, ["InvID", "VoucherNo"]).collect()}
    assert r == {"InvID": True, "VoucherNo": False}


def test_previous_snapshot_is_strictly_earlier(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 5, 9, 20)], "run_date date")
    assert rows(D.previous_snapshot(df, "2024-01-09")) == [(dt.date(2024, 1, 5),)]       # T7 fixed
    assert rows(D.latest_partition(df, "2024-01-09")) == [(dt.date(2024, 1, 9),)]


def test_whole_numbers_of_both_sides_are_compared_as_they_are(spark, capsys):
    from tallyspark.operators.diff import snapshot_diff
    cur = spark.createDataFrame([(1, 5, -7), (2, 9, 10), (2, 10, 9), (3, None, 0)], "k long, a long, b int")
    prev = spark.createDataFrame([(1, 5, -7), (2, 10, 9), (3, 0, 0), (4, 1, 1)], "k long, a int, b long")
    d = snapshot_diff(cur, prev, key="k")
    assert sorted({(r.k, r.change_type, r.changed_columns) for r in d.collect()}) == [
        (1, "unchanged", ""), (2, "unchanged", ""), (3, "modified", "a"), (4, "deleted", "")]
    d.explain()
    assert "decimal(38,18)" not in capsys.readouterr().out
    typed = snapshot_diff(cur, prev.selectExpr("k", "string(a) AS a", "b"), key="k", amounts=["a"])  # text in the place of numbers
    assert {r.k for r in typed.where("change_type = 'unchanged'").collect()} == {1, 2}


def test_snapshots_are_dealt_by_key_once(spark):
    from tallyspark.session import settings
    cur, prev = spark.createDataFrame(CUR, S), spark.createDataFrame(PREV, S)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        d = D.snapshot_diff(cur, prev, "InvID")
        plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "SortAggregate" not in plan
    assert d.columns == ["InvID", "Vendor", "Amount", "Status", "change_type", "changed_columns"]


def test_packed_texts_keep_equality_and_order(spark):
    from itertools import product
    texts = ["", "\0", "\1", "\2", "a", "\0\1", "a\0", "a\1", "ab", "\u00e9"]
    lists = list(product(texts, repeat=2))
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(lists)], "i int, a string, b string")
    got = {r["i"]: r for r in df.select("i", D.packed([df.a, df.b]).alias("p")).select("*", D.unpacked("p").alias("u")).collect()}
    assert sorted(range(len(lists)), key=lambda i: got[i]["p"].encode()) == sorted(range(len(lists)), key=lambda i: [t.encode() for t in lists[i]])
    assert len({r["p"] for r in got.values()}) == len(lists) and all(len(r["u"]) == 3 for r in got.values())


def test_diff_orders_rows_of_a_key_by_their_content(spark):
    s = "k long, o int, a string, b string"
    cur = spark.createDataFrame([(1, 2, "x", "y"), (1, 1, "b\0", "c"), (1, 1, "b", "\0c"), (2, None, "n", None), (2, 1, "m", "")], s)
    prev = spark.createDataFrame([(1, 5, "b", "\0c"), (2, 7, "n", ""), (3, 1, "z", "z"), (3, 2, "z", "w")], s)
    d = D.snapshot_diff(cur, prev, "k", order="o", compare=["a", "b"])
    assert rows(d, "k", "change_type", "changed_columns") == [(1, "unchanged", "")] * 3 + [(2, "unchanged", "")] * 2 + [(3, "deleted", "")] * 2
