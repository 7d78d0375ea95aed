"""Data-quality rules in a single pass.

Every rule is a ``Column`` over one row, except the duplicate rule, which needs
a count per invoice number: that comes from a partial ``groupBy`` joined back
with blank numbers split off (they can never be duplicates), so a hot number
does not put a whole group into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import exprs as X
from .common import counts_per_key, left_join_keyed
from .normalize import col

ISSUE_MISSING = "missing value in '{}'"
ISSUE_DUPLICATE = "duplicate invoice number"
ISSUE_BAD_AMOUNT = "invalid amount value"
ISSUE_NEGATIVE = "negative amount"
ISSUE_BAD_DATE = "invalid date"


def required_columns(df: DataFrame, required: list[str] = K.REQUIRED_COLUMNS) -> DataFrame:
    """One row per required column: whether the frame has it, and in how many rows it is filled."""
    filled = [(F.count_if(~X.is_blank(col(c))) if c in df.columns else F.count_if(F.lit(False))).alias(f"n{i}") for i, c in enumerate(required)]
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(c in df.columns).alias("present"), F.col(f"n{i}").alias("filled_rows"))
            for i, c in enumerate(required)]
    return df.agg(*filled).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def is_numeric_text(x) -> F.Column:
    return X.to_double(x).isNotNull()


def with_duplicate_counts(df: DataFrame, number: str, name: str = "_dup_n") -> DataFrame:
    counts = counts_per_key(df, [number], name)
    return left_join_keyed(df, counts, [number])


def row_checks(fields: list[str], date: str, amount: str) -> tuple[list[F.Column], list[F.Column]]:
    """The rules that need one row only, in report order: missing values, and values that do not parse."""
    missing = [F.when(X.is_blank(col(f)), F.lit(ISSUE_MISSING.format(f))) for f in fields]
    values = []
    if amount in fields:
        num = X.to_double(col(amount))
        values += [F.when(col(amount).isNotNull() & num.isNull(), F.lit(ISSUE_BAD_AMOUNT)), F.when(num < 0, F.lit(ISSUE_NEGATIVE))]
    if date in fields:
        values.append(F.when(col(date).isNotNull() & X.parse_date_any(col(date)).isNull(), F.lit(ISSUE_BAD_DATE)))
    return missing, values


def apply_rules(df: DataFrame, number: str = "PurchaseInvNo", date: str = "PurchaseInvDate",
                vendor: str = "PartyName", gst: str = "GSTNO", amount: str = "Total") -> DataFrame:
    """Adds ``issues: array<string>`` (empty when the row passes every rule)."""
    fields = [f for f in (number, date, vendor, gst, amount) if f in df.columns]
    missing, values = row_checks(fields, date, amount)
    # the rules of one row are judged before the rows are dealt by number, as a bit each
    fails = [F.shiftleft(c.isNotNull().cast("int"), i) for i, c in enumerate(missing + values)]
    d = df.withColumn("_fails", reduce(Column.bitwiseOR, fails, F.lit(0)))
    d = with_duplicate_counts(d, number) if number in df.columns else d.withColumn("_dup_n", F.lit(None))
    texts = [ISSUE_MISSING.format(f) for f in fields] + ([ISSUE_BAD_AMOUNT, ISSUE_NEGATIVE] if amount in fields else []) + ([ISSUE_BAD_DATE] if date in fields else [])
    judged = [F.when(F.col("_fails").bitwiseAND(1 << i) != 0, F.lit(t)) for i, t in enumerate(texts)]
    repeated = [F.when(F.col("_dup_n") > 1, F.lit(ISSUE_DUPLICATE))] if number in df.columns else []
    checks = judged[:len(missing)] + repeated + judged[len(missing):]
    return d.withColumn("issues", F.array_compact(F.array(*checks))).drop("_dup_n", "_fails")


def missing_values(df: DataFrame, fields: list[str] = K.REQUIRED_COLUMNS) -> DataFrame:
    """Null/blank count per required field, one pass (long format)."""
    fields = [f for f in fields if f in df.columns]
    wide = df.agg(*[F.count_if(X.is_blank(col(f))).alias(f"m{i}") for i, f in enumerate(fields)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"m{i}").alias("missing_rows"))
        for i, f in enumerate(fields)])).alias("m")).select("m.*")


def duplicates(df: DataFrame, number: str = "PurchaseInvNo") -> DataFrame:
    """All rows of a repeated non-blank number (``keep=False``), with the group size."""
    counts = counts_per_key(df, [number], "dup_count").where(F.col("dup_count") > 1)
    return df.join(counts, number)


def bad_amounts(df: DataFrame, amount: str = "Total") -> DataFrame:
    a = col(amount)
    num = X.to_double(a)
    problem = F.when(a.isNotNull() & num.isNull(), F.lit(ISSUE_BAD_AMOUNT)).when(num < 0, F.lit(ISSUE_NEGATIVE))
    return df.withColumn("problem", problem).where(F.col("problem").isNotNull())


def bad_dates(df: DataFrame, date: str = "PurchaseInvDate") -> DataFrame:
    return df.where(col(date).isNotNull() & X.parse_date_any(col(date)).isNull())


def rule_report(df_with_issues: DataFrame) -> DataFrame:
    """Issue texts with affected row counts (one row per issue)."""
    return (df_with_issues.select(F.explode("issues").alias("issue"))
            .groupBy("issue").agg(F.count(F.lit(1)).alias("rows")))


def rows_with_issues(df_with_issues: DataFrame) -> DataFrame:
    """One row per offending input row with its issue list (T16 fixed)."""
    return df_with_issues.where(F.size("issues") > 0)


def issue_money_by_vendor(df_with_issues: DataFrame, vendor: str, amount: str) -> DataFrame:
    """Which rule fails how often and for how much money, per vendor."""
    return (df_with_issues.select(F.coalesce(X.null_tokens(col(vendor)), F.lit("")).alias("vendor"),
                                  X.parse_amount(col(amount)).alias("_amt"),
                                  F.explode("issues").alias("issue"))
            .groupBy("vendor", "issue")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("_amt").alias("amount")))


def mark_rows(df_with_issues: DataFrame) -> DataFrame:
    """Validation_Status / Issues_Found / Correct / Flagged from the rule result."""
    ok = F.size("issues") == 0
    return df_with_issues.select(
        "*",
        F.when(ok, F.lit("VALID")).otherwise(F.lit("FLAGGED")).alias("Validation_Status"),
        F.concat_ws("; ", "issues").alias("Issues_Found"),
        F.when(ok, F.lit("✅")).otherwise(F.lit("")).alias("Correct"),
        F.when(ok, F.lit("")).otherwise(F.lit("🚩")).alias("Flagged"),
    )


def profile_quality(df: DataFrame, number: str, amount: str) -> DataFrame:
    """One row: empty numbers, repeats beyond the first (NULL counts as one value, T11),
    invalid amounts (NULL included, T15) and negatives, rows and columns."""
    n = col(number)
    num = X.to_double(col(amount))
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(df.columns)).alias("total_columns"),
        F.count_if(n.isNull()).alias("empty_invoice_numbers"),
        (F.count(F.lit(1)) - F.count_distinct(n) - F.when(F.count_if(n.isNull()) > 0, 1).otherwise(0))
        .alias("duplicate_invoice_numbers"),
        F.count_if(num.isNull()).alias("invalid_amounts"),
        F.count_if(num < 0).alias("negative_amounts"),
    )


def to_validations(df: DataFrame, mapping: dict[str, str], session_id: str, source_file: str | F.Column,
                   as_of=None) -> DataFrame:
    """Main pipeline rows: blank numbers skipped, amount parsed, discrepancies, stable hash."""
    from .normalize import extract_fields
    src_cols = list(df.columns)
    e = extract_fields(df, mapping)
    inv = X.strip(col(mapping["invoice_number"]).cast("string")) if "invoice_number" in mapping else None
    vendor = (X.strip(col(mapping["vendor"]).cast("string")) if "vendor" in mapping
              else F.lit("Unknown Vendor"))
    amount = X.parse_amount(col(mapping["amount"])) if "amount" in mapping else F.lit(None).cast("decimal(18,2)")
    if inv is None:
        inv = F.concat(F.lit("AUTO_"), X.row_hash(*[col(c) for c in src_cols]).substr(1, 16))
    src = F.lit(source_file) if isinstance(source_file, str) else source_file
    out = e.select(
        inv.alias("invoice_number"),
        vendor.alias("vendor_name"),
        amount.alias("amount"),
        F.lit("processed").alias("status"),
        X.discrepancies(amount, vendor if "vendor" in mapping else F.lit("x")).alias("discrepancies"),
        src.alias("file_path"),
        X.row_hash(*[col(c) for c in src_cols]).alias("hash_value"),
        F.lit(f"production_{session_id}").alias("processed_by"),
        F.col("gst_no"), F.col("inv_date"), F.col("due_date_parsed").alias("due_date"),
        F.col("currency_out").alias("inv_currency"), F.col("location_out").alias("location"),
        F.col("mop_out").alias("mop"), F.col("account_head_out").alias("account_head"),
    )
    return out.where(~F.lower(F.coalesce(F.col("invoice_number"), F.lit(""))).isin("", "nan"))
