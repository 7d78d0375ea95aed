"""Summaries, KPIs and dashboard aggregates.

All are single ``agg`` / ``groupBy`` passes with partial aggregation; top-k
lists rank the *aggregated* counts, never raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .common import running_total, top_k_per_group
from .normalize import col


def invoice_summary(df: DataFrame, date_col: str, amount_col: str) -> DataFrame:
    """Rows, columns, earliest/latest parsable date, sum/avg/min/max of valid amounts."""
    d = X.parse_date_any(col(date_col))
    a = X.to_decimal(col(amount_col))
    return df.agg(
        F.count(F.lit(1)).alias("total_invoices"), F.lit(len(df.columns)).alias("columns_count"),
        F.min(d).alias("earliest"), F.max(d).alias("latest"),
        F.sum(a).alias("total_amount"), F.round(F.avg(a), 2).alias("average_amount"),
        F.min(a).alias("min_amount"), F.max(a).alias("max_amount"))


def with_totals(counts: DataFrame, **totals: Column) -> DataFrame:
    """Attach one-row totals (aggregates over ``counts``) to every row: a broadcast join on
    a constant key against a table of exactly one row (bounded by construction)."""
    t = counts.agg(*[v.alias(k) for k, v in totals.items()]).withColumn("_one", F.lit(1))
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(t), "_one").drop("_one")


def status_summary(df: DataFrame, status: str = "Status") -> DataFrame:
    """Count and percentage per status, plus the success rate (share of VALID)."""
    counts = df.groupBy(col(status).alias("status")).agg(F.count(F.lit(1)).alias("count"))
    j = with_totals(counts, _total=F.sum("count"),
                    _valid=F.sum(F.when(F.col("status") == "VALID", F.col("count")).otherwise(0)))
    return j.select("status", "count", X.pct("count", "_total").alias("percent"),
                    X.pct("_valid", "_total").alias("success_rate"))


def exact_median(df: DataFrame, a: Column, name: str) -> DataFrame:
    """One row: the exact median, from counts per value and their running total over value ranges, so no
    task holds all distinct values (as ``median()`` does)."""
    counts = df.where(a.isNotNull()).groupBy(a.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_g", F.lit(0))
    upto = with_totals(running_total(counts, "_g", "_v", "_n", "_upto"), _all=F.sum("_n"))
    at = lambda place: F.min(F.when(F.col("_upto") >= place, F.col("_v"))).cast("double")
    return upto.agg(((at(F.floor((F.col("_all") + 1) / 2)) + at(F.floor(F.col("_all") / 2) + 1)) / 2).alias(name))


def amount_stats(df: DataFrame, amount: Column | str) -> DataFrame:
    """Sum, mean, exact median, max, min."""
    a = F.col(amount) if isinstance(amount, str) else amount
    sums = df.agg(F.sum(a).alias("total_amount"), F.round(F.avg(a), 2).alias("average_amount"),
                  F.max(a).alias("max_amount"), F.min(a).alias("min_amount"))
    return side_by_side(sums, exact_median(df, a, "median_amount"))


def most_frequent(df: DataFrame, c: Column, name: str) -> DataFrame:
    """One row: the most frequent non-null value (tie -> smallest).  Counts come from a
    partial ``groupBy`` and the winner from a distributed top-1, so no single task ever
    holds the value -> count map of a high-cardinality column (``mode()`` would)."""
    g = df.where(c.isNotNull()).groupBy(c.alias(name)).agg(F.count(F.lit(1)).alias("_n"))
    return g.orderBy(F.desc("_n"), F.asc(name)).limit(1).select(name)


def value_counts(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """``dimension, value, n`` of several columns in one pass: a row gives one value per dimension, and
    partial aggregation counts them."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("value")) for d, c in dimensions.items()])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """Combine one-row frames with disjoint columns into one row (union + max, no cross join)."""
    u = one_row_frames[0]
    for f in one_row_frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    cols = [c for f in one_row_frames for c in f.columns]
    return u.agg(*[F.max(c).alias(c) for c in cols])


def vendor_stats(df: DataFrame, vendor: str) -> DataFrame:
    """Distinct vendors and the most frequent one (tie -> smallest name)."""
    return side_by_side(df.agg(F.count_distinct(col(vendor)).alias("unique_vendors")),
                        most_frequent(df, col(vendor), "top_vendor"))


def trend_by_run(df: DataFrame, run_date: str, status: str) -> DataFrame:
    """Per dated report: month, total, valid, invalid and success rate."""
    g = df.groupBy(col(run_date).alias("report_date")).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(col(status) == "VALID").alias("valid_records"),
        F.count_if(col(status) == "INVALID").alias("invalid_records"))
    return g.select("report_date", F.date_format("report_date", "yyyy-MM").alias("month"), "total_records",
                    "valid_records", "invalid_records", X.pct("valid_records", "total_records").alias("success_rate"))


def status_buckets(df: DataFrame, status: str = "Validation_Status") -> DataFrame:
    s = col(status).cast("string")
    return df.agg(F.count_if(s.contains("PASS")).alias("passed"), F.count_if(s.contains("FAIL")).alias("failed"),
                  F.count_if(s.contains("WARNING")).alias("warnings"))


def kpi_overview(df: DataFrame) -> DataFrame:
    """Totals, pass/warn/fail with rates, currencies, locations, urgent payments and
    creator coverage (blank creators are not identified, T24), in one pass."""
    s = col("Validation_Status").cast("string")
    loc = X.location_head(col("Location"))
    creator = X.strip(F.coalesce(col("Invoice_Creator_Name").cast("string"), F.lit("")))
    a = df.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.count_if(s.contains("PASS")).alias("passed"), F.count_if(s.contains("WARNING")).alias("warnings"),
        F.count_if(s.contains("FAIL")).alias("failed"),
        F.count_if(col("Due_Date_Notification").isin("YES", "OVERDUE")).alias("urgent_payments"),
        F.count_if((creator != "Unknown") & (creator != "")).alias("known_creators"))
    # distinct values and the most frequent one (tie -> smallest) of both columns, from one count
    counts = value_counts(df, {"currency": col("Invoice_Currency"), "location": loc}).where(F.col("value").isNotNull())
    is_d = lambda d: F.col("dimension") == d
    first = lambda d: F.min(F.when(is_d(d), F.struct((-F.col("n")).alias("n"), "value")))["value"]
    a = side_by_side(a, counts.agg(F.count_if(is_d("currency")).alias("currencies"), F.count_if(is_d("location")).alias("locations"),
                                   first("currency").alias("primary_currency"), first("location").alias("primary_location")))
    return a.select("*", X.pct("passed", "total_invoices").alias("pass_rate"),
                    X.pct("warnings", "total_invoices").alias("warning_rate"),
                    X.pct("failed", "total_invoices").alias("fail_rate"),
                    X.pct("known_creators", "total_invoices").alias("creator_coverage"))


def top_k_values(df: DataFrame) -> DataFrame:
    """The dashboard's breakdowns: status, currency, alert, GST class (all values);
    top 10 locations; top 8 creators (ties by value).  One pass for either kind."""
    whole = value_counts(df, {"status": col("Validation_Status"), "currency": col("Invoice_Currency"),
                              "due_alert": col("Due_Date_Notification"), "gst_class": X.gst_result_class("GST_Validation_Result")})
    counts = value_counts(df, {"location": X.location_head(col("Location")), "creator": col("Invoice_Creator_Name")})
    best = top_k_per_group(counts, "dimension", [F.desc("n"), F.asc_nulls_first("value")], 10)
    best = best.where((F.col("dimension") == "location") | (F.col("rank") <= 8))
    return whole.unionByName(best.drop("rank"))


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sorted distinct non-null values per filter column (long format)."""
    out = None
    for c in columns:
        d = df.select(F.lit(c).alias("column_name"), col(c).cast("string").alias("value")).where(
            F.col("value").isNotNull()).distinct()
        out = d if out is None else out.unionByName(d)
    return out.orderBy("column_name", "value")


def explore(df: DataFrame, columns: list[str] | None = None, **equals) -> DataFrame:
    """Conjunction of optional equality filters; ``'All'`` or ``None`` means no filter."""
    cond = F.lit(True)
    for c, v in equals.items():
        if v is not None and v != "All":
            cond = cond & (col(c) == F.lit(v))
    out = df.where(cond)
    return out.select(*[col(c) for c in columns]) if columns else out


def urgent_payments(df: DataFrame, k: int = 10, order: list[str] = ("Due_Date", "Invoice_ID")) -> DataFrame:
    """Invoices due within the horizon or overdue; the first ``k`` by due date (top-k feature)."""
    return (df.where(col("Due_Date_Notification").isin("YES", "OVERDUE"))
            .orderBy(*[col(c) for c in order]).limit(k))


def session_counters(log: DataFrame) -> DataFrame:
    """Per session: files ok/failed, invoices processed, errors, warnings (from the log)."""
    op, st = col("operation"), col("status")
    return log.groupBy("session_id").agg(
        F.count_if((op == "file_read") & (st == "success")).alias("files_ok"),
        F.count_if((op == "file_read") & (st == "failed")).alias("files_failed"),
        F.count_if((op == "invoice_insert") & (st != "failed")).alias("invoices_processed"),
        F.count_if(st == "failed").alias("errors"), F.count_if(st == "warning").alias("warnings"))


def pass_rate_impact(df: DataFrame, status: str, amount: str) -> DataFrame:
    """Count and real money per class, and pass rate = passed / (passed + failed + warn)."""
    s = col(status)
    cls = F.when(s.contains("PASS"), "passed").when(s.contains("FAIL"), "failed").when(s.contains("WARNING"), "warning")
    g = df.where(cls.isNotNull()).groupBy(cls.alias("class")).agg(
        F.count(F.lit(1)).alias("invoices"), F.sum(col(amount)).alias("amount"))
    j = with_totals(g, _total=F.sum("invoices"),
                    _passed=F.sum(F.when(F.col("class") == "passed", F.col("invoices")).otherwise(0)))
    return j.select("class", "invoices", "amount", X.pct("_passed", "_total").alias("pass_rate"))


def outcome_rollup(log: DataFrame, batch: str, ok: str) -> DataFrame:
    """Total / successful / failed per batch; failed invoices stay rows (``failed_rows``)."""
    return log.groupBy(batch).agg(F.count(F.lit(1)).alias("total"), F.count_if(col(ok)).alias("successful"),
                                  F.count_if(~col(ok)).alias("failed"))


def failed_rows(log: DataFrame, ok: str) -> DataFrame:
    return log.where(~col(ok))
