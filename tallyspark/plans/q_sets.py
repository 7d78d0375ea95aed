"""Registered queries: set operations, per-group top-k and the date window filter
(SURVEY §2.H, §2.G top_k_files, §2.D filter_date_window)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import common as C
from ..session import table
from . import fixtures as FX
from .registry import query, s_null_tokens, s_parse_date


@query("union_frames", """SELECT "InvID", "PurchaseInvNo", "Total" FROM ledger WHERE CAST("InvID" AS BIGINT) % 2 = 0
UNION ALL BY NAME
SELECT "InvID", "PartyName", "Currency" FROM ledger WHERE CAST("InvID" AS BIGINT) % 2 = 1""", ("ledger",))
def union_frames(spark, sf):
    led = FX.ledger(spark, sf)
    even = led.where(F.col("InvID").cast("long") % 2 == 0).select("InvID", "PurchaseInvNo", "Total")
    odd = led.where(F.col("InvID").cast("long") % 2 == 1).select("InvID", "PartyName", "Currency")
    return even.unionByName(odd, allowMissingColumns=True)


_COMMON = ["invoice_id", "invoice_number", "vendor_name", "gst_number", "amount_raw"]


@query("common_columns", " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, (SELECT count({c}) FROM snap_cur) AS current_values, "
    f"(SELECT count({c}) FROM snap_prev) AS previous_values" for i, c in enumerate(_COMMON)), ("snap_cur", "snap_prev"))
def common_columns(spark, sf):
    """Columns of both frames in the order of the first, with how many values each side has."""
    cur, prev = FX.snapshot_pair(spark, sf)
    cur, prev = cur.select(*_COMMON, "lines"), prev.select("location", *reversed(_COMMON))
    names = C.common_columns(cur, prev)
    both = cur.select(*names, F.lit(1).alias("_c")).unionByName(prev.select(*names, F.lit(0).alias("_c")))
    counts = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.count_if(F.col(c).isNotNull() & (F.col("_c") == 1)).alias(
        "current_values"), F.count_if(F.col(c).isNotNull() & (F.col("_c") == 0)).alias("previous_values")) for i, c in enumerate(names)]
    return both.agg(*[s.alias(f"s{i}") for i, s in enumerate(counts)]).select(
        F.explode(F.array(*[f"s{i}" for i in range(len(names))])).alias("s")).select("s.*")


@query("ordered_dedupe", f"""SELECT creator, min(pos) AS first_pos FROM (
  SELECT {s_null_tokens('"Inv Created By"')} AS creator, CAST("InvID" AS BIGINT) AS pos FROM ledger)
WHERE creator IS NOT NULL GROUP BY creator""", ("ledger",))
def ordered_dedupe(spark, sf):
    led = FX.ledger(spark, sf).select(X.null_tokens(F.col("`Inv Created By`")).alias("creator"),
                                      F.col("InvID").cast("long").alias("pos"))
    return C.ordered_distinct(led, "creator", "pos")


_EXT = "CASE doc_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'pdf' ELSE 'txt' END"


@query("top_k_files", f"""SELECT ext, name, rank FROM (
  SELECT ext, name, row_number() OVER (PARTITION BY ext ORDER BY name) AS rank FROM (
    SELECT {_EXT} AS ext, 'file_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.' || {_EXT} AS name FROM documents))
WHERE rank <= CASE WHEN ext IN ('csv', 'xlsx') THEN 4 ELSE 3 END""")
def top_k_files(spark, sf):
    d = table(spark, sf, "documents")
    ext = (F.when(F.col("doc_id") % 4 == 0, "csv").when(F.col("doc_id") % 4 == 1, "xlsx")
            .when(F.col("doc_id") % 4 == 2, "pdf").otherwise("txt"))
    files = d.select(ext.alias("ext"), F.concat(F.lit("file_"), F.lpad(F.col("doc_id").cast("string"), 6, "0"),
                                                F.lit("."), ext).alias("name"))
    # data files keep 4, documents 3: one top-4 pass, then the per-kind bound
    top = C.top_k_per_group(files, "ext", ["name"], 4)
    return top.where(F.col("rank") <= F.when(F.col("ext").isin("csv", "xlsx"), 4).otherwise(3)).select("ext", "name", "rank")


@query("filter_date_window", f"""SELECT "InvID", "PurchaseInvDate" FROM ledger
WHERE {s_parse_date('"PurchaseInvDate"')} BETWEEN DATE '2001-07-31' - 3 AND DATE '2001-07-31'""", ("ledger",))
def filter_date_window(spark, sf):
    # half of the dates have a time of day behind them
    timed = F.when(F.col("InvID").cast("long") % 2 == 0, F.concat("PurchaseInvDate", F.lit("T23:59:59Z"))).otherwise(F.col("PurchaseInvDate"))
    led = FX.ledger(spark, sf).withColumn("_made", timed)
    d = X.parse_date("_made")
    return led.where(d.between(F.date_sub(X.as_of_lit("2001-07-31"), 3), X.as_of_lit("2001-07-31"))).select(
        "InvID", "PurchaseInvDate")
