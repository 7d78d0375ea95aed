"""Documents: field extraction traps, containment match vs brute force, text_to_table."""

from tallyspark.operators import documents as DOC

from conftest import rows


def brute_force(texts, ledger_rows, cols):
    """The reference's loop: columns in order, rows in order, exact then partial, first hit."""
    out = {}
    for doc_id, text in texts:
        if not text:
            out[doc_id] = DOC.NO_DATA
            continue
        t = text.upper().replace(" ", "").replace("-", "").replace("_", "")
        res = DOC.NOT_MATCHED
        for c in range(len(cols)):
            for row in ledger_rows:
                v = (row[c] or "").strip()
                if not v or v.lower() in ("nan", "none", "null", "nat"):
                    continue
                k = v.upper().replace(" ", "").replace("-", "").replace("_", "")
                if not k:
                    continue                                   # T17: '---' matches nothing
                if k in t:
                    res = DOC.VALID
                elif len(k) >= 4 and k[:int(len(k) * 0.8)] in t:
                    res = DOC.PARTIAL
                else:
                    continue
                break
            if res != DOC.NOT_MATCHED:
                break
        out[doc_id] = res
    return out


def test_match_against_brute_force(spark):
    ledger = [("INV-12", "V-100", "1"), ("INV1", "V-200", "2"), ("---", "V-300", "3"), ("ABCDEFGHIJ", None, "4"),
              ("INV-77", "V-9", "5")]
    texts = [(1, "see inv 12 today"), (2, "ref INV1 only"), (3, "partial ABCDEFGH here"), (4, "nothing"),
             (5, ""), (6, "voucher v200 and inv-77"), (7, "x INV12 y")]
    led = spark.createDataFrame(ledger, "PurchaseInvNo string, VoucherNo string, InvID string")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = dict(rows(DOC.match_text_to_ledger(docs, led), "doc_id", "Validation_Result"))
    assert got == brute_force(texts, ledger, ["PurchaseInvNo", "VoucherNo", "InvID"])
    assert got[3] == DOC.PARTIAL and got[5] == DOC.NO_DATA and got[4] == DOC.NOT_MATCHED
    plan = DOC.match_text_to_ledger(docs, led)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_probes_that_no_text_can_hold_are_left_out(spark):
    from tallyspark.operators import text_match as T
    probes = spark.createDataFrame([(f"PROBE{i:06d}", i) for i in range(500)] + [("Q", 500), ("\u20b9\u20b9", 501), ("ABCDEFGH", 502)], "probe string, value long")
    texts = spark.createDataFrame([(1, "xxPROBE00"), (2, "say PROBE000499"), (3, "Q"), (4, ""), (5, "ABCDEFG")], "id long, text string")
    met = {r["value"] for r in T.met_probes(texts, T.with_anchors(probes)).collect()}
    assert met == {*range(500), 500}   # all of them begin with PROBE000, which one text holds
    met = {r["value"] for r in T.met_probes(texts.where("id <> 2"), T.with_anchors(probes)).collect()}
    assert met == {500}


def test_probes_are_summed_up_without_sorting_them(spark, monkeypatch):
    plans, store = {}, DOC.stage_table
    monkeypatch.setattr(DOC, "stage_table", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), store(df, name))[1])
    led = spark.createDataFrame([("INV-12", "V-1", "7"), ("INV-12", "V-2", None), ("INV-123456", "V-3", "9"), ("INV-123455", "V-4", "9"), ("X1", "V-12", "3")],
                                "PurchaseInvNo string, VoucherNo string, InvID string")
    docs = spark.createDataFrame([(1, "inv12 and v12"), (2, "INV 12345 6"), (3, "v 12"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in DOC.match_text_to_ledger(docs, led).collect()}
    assert "SortAggregate" not in plans["best-keys"] and "HashAggregate" in plans["best-keys"]
    # the row without a number is the first; of two rows with one number the least key that the text may hold
    assert got[1] == (DOC.VALID, 0, None, "INV12") and got[2] == (DOC.VALID, 0, None, "INV12")
    assert got[3] == (DOC.VALID, 1, 3, "V12") and got[4] == (DOC.NO_DATA, None, None, None)
    few = DOC.match_text_to_ledger(docs.where("doc_id = 2"), led.where("InvID = '9'")).first()
    assert tuple(few)[1:] == (DOC.PARTIAL, 0, 9, "INV123455")


def test_texts_need_the_lines_of_their_orders_only(spark):
    from conftest import SF_SMALL
    from tallyspark.plans import fixtures as FX
    plan = FX.invoice_texts(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = next(i for i, x in enumerate(plan) if "RepartitionByExpression" in x)
    assert "LeftSemi" in "".join(plan[dealt:dealt + 3])


def test_only_matched_rows_of_the_ledger_are_dealt(spark):
    led = spark.createDataFrame([(str(i), f"P{i}") for i in range(50)], "InvID string, PartyName string")
    res = spark.createDataFrame([(1, "x VALID", 7), (2, "Not Matched", None)], "doc_id long, Validation_Result string, matched_row long")
    out = DOC.attach_matched_rows(res, led, fields=["PartyName"])
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.PartyName) for r in out.collect()) == [(1, "P7"), (2, None)]


def test_fixtures_shuffle_the_lines_once(spark):
    from conftest import SF_SMALL
    from tallyspark.plans import fixtures as FX
    from tallyspark.session import settings
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = FX.ledger(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert not [x for x in dealt if "l_suppkey" in x.split("),")[0] and "l_orderkey" in x.split("),")[0]] and len(dealt) <= 7
    both = FX.snapshot_pair(spark, SF_SMALL)
    assert not any("lineitem" in f for df in both for f in df.inputFiles())


def test_extract_fields_traps(spark):
    text = "Invoice No: INV-7\nGrand Total: ₹ 1,250.00\nTotal: 1,250\nDue Date: 05/02/2024\nDate: 01/01/2024"
    r = DOC.extract_document_fields(spark.createDataFrame([(text,)], "text string")).first()
    assert r["Invoice_Number"] == "INV-7"
    assert r["Amount"] == "1250.00"                 # T19: 'Total' hits 'Grand Total' first
    assert r["Total_Invoice_Value"] == "1250.00"
    assert r["Invoice_Date"] == "05/02/2024"        # 'Date' hits 'Due Date' first
    t2 = DOC.extract_document_fields(spark.createDataFrame([("Total: 1,250",)], "text string")).first()
    assert t2["Amount"] == "1"                      # comma form without cents -> leading digits


def test_text_to_table(spark):
    text = "Report\nItem,Qty,Price\n1,2,3\nA;B;C\nname  value\nX,Y,Z,W"
    t = DOC.text_to_table(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = [(r["row_no"], r["cells"]) for r in t.collect()]
    assert t.first()["header"] == ["Item", "Qty", "Price"] or t.first()["header"] == ["X", "Y", "Z", "W"]
    hdr = t.first()["header"]
    assert hdr == ["X", "Y", "Z", "W"] and got == [(0, ["X", "Y", "Z", "W"])]
    t2 = DOC.text_to_table(spark.createDataFrame([(1, "1,2\nA,B\nC,D")], "doc_id long, text string"))
    assert t2.first()["header"] == ["col_0", "col_1"] and t2.count() == 3


def test_first_row_fields_dict_rule(spark):
    t = spark.createDataFrame([(1, 0, ["a b", "c", "a b"], ["1", "", "3"])],
                              "doc_id long, row_no int, header array<string>, cells array<string>")
    assert DOC.first_row_fields(t).first()["fields"] == {"a_b": "3"}


def test_emails(spark):
    df = spark.createDataFrame([(1, "mail ann@x.org; bad@ and bob.k@mail.co.uk")], "doc_id long, text string")
    assert [r["email"] for r in DOC.scan_emails(df).orderBy("pos").collect()] == ["ann@x.org", "bob.k@mail.co.uk"]
    s = DOC.split_emails(spark.createDataFrame([("a@b.io, bad ; c@d.com",)], "r string"), "r", [])
    assert [(r["email"], r["valid"]) for r in s.collect()] == [("a@b.io", True), ("bad", False), ("c@d.com", True)]


def _least_probe(texts, probes):
    out = {}
    for i, t in texts:
        hits = [v for p, v in probes if p in (t or "")]
        if hits:
            out[i] = min(hits)
    return out


def test_automata_against_brute_force(spark):
    """Probes of one character and of hundreds, in small automata and in salted groups."""
    import random

    from pyspark.sql import functions as F
    from tallyspark.operators.text_match import best_probe
    from tallyspark.session import stage_table
    rng = random.Random(1)
    letters = "AB01é😀\n"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(i, word(rng.choice([0, 1, 5, 40, 400]))) for i in range(150)] + [(900, None), (901, "Z" + word(3000))]
    names = {word(rng.choice([1, 2, 3, 4, 6, 9, 12])) for _ in range(60)} | {t[3:300] for _, t in texts[:100] if t and len(t) > 300} | {"Z"}
    probes = [(p, rng.randint(0, 10_000)) for p in sorted(names) if p]
    rows = spark.createDataFrame(probes, "probe string, n int").select("probe", F.struct("n", "probe").alias("value"))
    stored = stage_table(rows, "test-probes")
    for per_automaton, chars in ((50_000, 8 << 20), (3, 500)):
        found = best_probe(spark.createDataFrame(texts, "id long, text string"), stored, per_automaton, chars)
        assert {r["id"]: r["value"]["n"] for r in found.collect()} == _least_probe(texts, probes)


def test_match_with_one_character_keys(spark):
    ledger = [("7", "V", "1"), ("INV-2024-000123", "X", "2"), ("Q" * 200, "é", "3"), ("INV-2024-000124", "", "4")]
    texts = [(1, "INV 2024 0001 99"), (2, "no such key"), (3, "q" * 170), (4, "7"), (5, "inv_2024-000124 "), (6, "É"), (7, "--- ___")]
    led = spark.createDataFrame(ledger, "PurchaseInvNo string, VoucherNo string, InvID string")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = dict(rows(DOC.match_text_to_ledger(docs, led), "doc_id", "Validation_Result"))
    want = brute_force(texts, ledger, ["PurchaseInvNo", "VoucherNo", "InvID"])
    want[7] = DOC.NO_DATA  # nothing is left of it
    assert got == want
