"""Run ledger and invoice history.

The reference keeps three SQL tables and mutates them with UPDATE / DELETE /
INSERT OR REPLACE.  Here every maintenance step is a DataFrame -> DataFrame
transform (a projection or a filter); ``persist`` writes a whole Parquet table
partitioned by ``run_date``, ``replace_dates`` only the dates of a batch, and
``rewrite`` applies a transform to the partitions it touches, in place: the new
rows are staged, then overwrite those partitions, and emptied ones are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import exprs as X
from ..session import stage_table

RUN_WINDOW_KEY = ["start_date", "end_date", "run_date"]


def active(df: DataFrame) -> DataFrame:
    """``archived = 0 OR archived IS NULL``."""
    return df.where(~F.coalesce(F.col("archived"), F.lit(False)))


def run_log_from(runs: DataFrame, window_days: int = K.WINDOW_DAYS) -> DataFrame:
    """One run_log row per (run_date, run_type) with its window and defaults
    (cumulative = window, total_days_validated = 1, not archived)."""
    g = runs.groupBy("run_date", "run_type").agg(F.min("event_id").alias("id"), F.max("ts").alias("run_timestamp"))
    return g.select(
        "id", F.date_sub("run_date", window_days).alias("start_date"), F.col("run_date").alias("end_date"),
        "run_date", "run_timestamp", "run_type",
        F.date_sub("run_date", window_days).alias("cumulative_start"), F.col("run_date").alias("cumulative_end"),
        F.lit(1).alias("total_days_validated"), F.lit(False).alias("archived"),
        F.lit(None).cast("date").alias("archived_date"), F.col("run_timestamp").alias("created_at"))


def upsert_run_windows(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """``INSERT OR REPLACE`` on (start_date, end_date, run_date): the newest row wins.
    ``row_number() = 1`` gets a partial WindowGroupLimit, so a hot key stays cheap."""
    cols = ["id", *RUN_WINDOW_KEY, "run_type", "cumulative_start", "cumulative_end", "total_days_validated",
            "archived", "archived_date", "created_at"]
    u = new.select(*cols) if existing is None else existing.select(*cols).unionByName(new.select(*cols))
    w = W.partitionBy(*RUN_WINDOW_KEY).orderBy(F.desc("created_at"), F.desc("id"))
    return u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def history_rows(invoices: DataFrame, run_date: F.Column, run_type: str = "standard") -> DataFrame:
    """invoice_snapshots rows for a batch of normalised invoices (hash over the
    normalised fields, T14 fixed; batch and cumulative bounds default to the run date)."""
    inv_date = X.parse_date("invoice_date_raw")
    amount = X.parse_amount("amount_raw")
    h = X.invoice_hash("invoice_number", "vendor_name", inv_date.cast("string"), "gst_number", F.lit(""), F.lit(""),
                       amount, amount)
    return invoices.select(
        F.col("invoice_id").alias("id"), F.col("invoice_number").alias("invoice_no"), "vendor_name",
        inv_date.cast("string").alias("invoice_date"), F.col("gst_number").alias("gstin"), F.lit("").alias("pan"),
        F.lit("").alias("hsn_code"), amount.alias("taxable_value"), amount.alias("total_amount"), h.alias("hash"),
        run_date.alias("run_date"), F.lit(run_type).alias("run_type"), run_date.alias("batch_start"),
        run_date.alias("batch_end"), run_date.alias("cumulative_start"), run_date.alias("cumulative_end"),
        F.lit(False).alias("archived"), F.lit(None).cast("date").alias("archived_date"))


def append_history(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Append a batch; re-running a run date replaces that date's rows (idempotent)."""
    if existing is None:
        return new
    dates = new.select("run_date").distinct()
    return existing.join(dates, "run_date", "left_anti").unionByName(new)


def archive_before(df: DataFrame, cutoff, as_of, date_col: str) -> DataFrame:
    """``UPDATE … SET archived = 1, archived_date = as_of WHERE date_col < cutoff AND active``."""
    hit = (F.col(date_col) < X.as_of_lit(cutoff)) & ~F.coalesce(F.col("archived"), F.lit(False))
    return df.withColumns({"archived_date": F.when(hit, X.as_of_lit(as_of)).otherwise(F.col("archived_date")),
                           "archived": F.col("archived") | hit})


def purge_archived(df: DataFrame, as_of, days: int = K.PURGE_DAYS) -> DataFrame:
    """``DELETE WHERE archived = 1 AND archived_date < as_of - days``."""
    gone = F.coalesce(F.col("archived"), F.lit(False)) & (F.col("archived_date") < F.date_sub(X.as_of_lit(as_of), days))
    return df.where(~F.coalesce(gone, F.lit(False)))


def retain_snapshots(df: DataFrame, as_of, days: int = K.RETAIN_DAYS, by: str = "run_date") -> DataFrame:
    """Keep snapshots with ``run_date >= as_of - days`` (date arithmetic, T29)."""
    return df.where(F.col(by) >= F.date_sub(X.as_of_lit(as_of), days))


def snapshots_in_range(history: DataFrame, start, end) -> DataFrame:
    """Active history rows with run_date in [start, end], ordered, each wrapping its
    invoice fields in a one-element array of structs."""
    h = active(history).where(F.col("run_date").between(X.as_of_lit(start), X.as_of_lit(end)))
    return h.select("run_date", F.array(F.struct("invoice_no", "vendor_name", "invoice_date", "gstin", "pan",
                                                 "hsn_code", "taxable_value", "total_amount", "hash"))
                    .alias("invoice_data"), "run_type", "id").orderBy("run_date", "id")


def invoices_between(history: DataFrame, start: str, end: str) -> DataFrame:
    """``invoice_date BETWEEN ? AND ?`` on ISO text, active rows only."""
    return active(history).where(F.col("invoice_date").between(F.lit(start), F.lit(end)))


def run_bounds(windows: DataFrame, run_log: DataFrame) -> DataFrame:
    """Last run (MAX(run_date) of active windows, else MAX(end_date) of the legacy log)
    and first validation date (MIN(start_date), same fallback), with the source (T25)."""
    w = active(windows).agg(F.max("run_date").alias("w_last"), F.min("start_date").alias("w_first"))
    lg = active(run_log).agg(F.max("end_date").alias("l_last"), F.min("start_date").alias("l_first"))
    # two one-row aggregates side by side: union, then one more aggregate (no cross join)
    j = w.unionByName(lg, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("w_last", "w_first", "l_last", "l_first")])
    return j.select(F.coalesce("w_last", "l_last").alias("last_run_date"),
                    F.when(F.col("w_last").isNotNull(), F.lit("run_windows")).otherwise(F.lit("run_log"))
                     .alias("last_run_source"),
                    F.coalesce("w_first", "l_first").alias("first_validation_date"))


def ordered_runs(windows: DataFrame, run_log: DataFrame, active_only: bool = True) -> DataFrame:
    """Run windows ordered by start date; the legacy log (run_date = start_date) when the
    windows table has no rows."""
    w = active(windows) if active_only else windows
    lg = active(run_log) if active_only else run_log
    if w.limit(1).count() == 0:
        return lg.select("start_date", "end_date", F.col("start_date").alias("run_date"),
                         F.coalesce("run_type", F.lit("standard")).alias("run_type")).orderBy("start_date")
    return w.select("start_date", "end_date", "run_date", "run_type").orderBy("start_date", "run_date", "run_type")


def session_rows(df: DataFrame, session: str, by: str = "processed_by") -> DataFrame:
    """The rows that a session has processed (its name within ``by``)."""
    return df.where(F.col(by).contains(session))


def table_counts(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = c if out is None else out.unionByName(c)
    return out


def evolve_schema(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """``ALTER TABLE ADD COLUMN`` with defaults: add absent columns, fill NULLs of
    present ones with the default; keeps the declared column order first."""
    out = df
    for name, (dtype, default) in columns.items():
        d = F.lit(default).cast(dtype)
        out = out.withColumn(name, F.coalesce(F.col(name).cast(dtype), d) if name in df.columns else d)
    rest = [c for c in df.columns if c not in columns]
    return out.select(*columns.keys(), *rest)


def persist(df: DataFrame, path: str, partition_by: str | None = "run_date") -> DataFrame:
    """Write a whole table as Parquet (partitions that ``df`` does not have go) and return it read back.  A task sorts
    some of a partition's rows only, whatever the table's size."""
    w = (df.hint("rebalance", partition_by) if partition_by else df).write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def replace_dates(new: DataFrame, path: str, partition_by: str = "run_date") -> DataFrame:
    """Write only the dates that ``new`` has into a stored table, in the place of what they held."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)
    return new.sparkSession.read.parquet(path)


def rewrite(spark, path: str, change, touched, partition_by: str = "run_date") -> DataFrame:
    """Apply ``change`` (DataFrame -> DataFrame) to the partitions of a stored table that ``touched`` (a
    condition on the partition column) selects, and return the table read back.

    Only those partitions are read and written; one that ends up empty is removed.  The new rows are
    staged first, so the table is never read while it is overwritten."""
    table = spark.read.parquet(path)
    before = table.where(touched)
    after = stage_table(change(before), "rewrite")
    emptied = before.select(partition_by).distinct().join(after.select(partition_by).distinct(), partition_by, "left_anti")
    gone = [r[0] for r in emptied.collect()]  # partitions, not rows
    if not after.isEmpty():
        replace_dates(after.select(*table.columns), path, partition_by)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for value in gone:
        folder = hadoop(f"{path}/{partition_by}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.read.schema(table.schema).parquet(path)
