"""Registered queries: run ledger, table maintenance and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import sinks as SK
from ..operators.versions import VersionedTable
from ..session import scratch_path
from . import fixtures as FX
from .registry import query

CUTOFF, ARCHIVE_AS_OF, PURGE_AS_OF = "2024-01-10", "2024-01-31", "2024-05-01"
RUNS = ("run_windows", "history")


_KEPT = "id, start_date, end_date, run_date, run_type, cumulative_start, cumulative_end, total_days_validated, archived, archived_date, created_at"
#: A later batch: some runs made again (they win), some late reports of older runs (they lose), some new days.
_BATCH = {"id + 10000000": ("run_date", "run_type || '_again'", "created_at + INTERVAL '1' HOUR", "day(run_date) % 2 = 0"),
          "id + 20000000": ("run_date", "run_type || '_late'", "created_at - INTERVAL '1' DAY", "day(run_date) % 3 = 0"),
          "id + 30000000": ("run_date + INTERVAL '40' DAY", "run_type", "created_at + INTERVAL '40' DAY", "day(run_date) % 5 = 0")}
_BATCH_SQL = " UNION ALL ".join(
    f"""SELECT {i} AS id, start_date, end_date, CAST({d} AS DATE) AS run_date, {t} AS run_type, cumulative_start, cumulative_end,
    total_days_validated, archived, archived_date, {c} AS created_at FROM run_windows WHERE {w}""" for i, (d, t, c, w) in _BATCH.items())
_UPSERT_SQL = f"""SELECT {_KEPT} FROM (SELECT *, row_number() OVER (PARTITION BY start_date, end_date, run_date ORDER BY created_at DESC, id DESC) AS rn
  FROM (SELECT {_KEPT} FROM run_windows UNION ALL {_BATCH_SQL})) WHERE rn = 1"""


def _later_batch(windows):
    parts = [windows.where(w).selectExpr(f"{i} AS id", "start_date", "end_date", f"CAST({d} AS DATE) AS run_date", f"{t} AS run_type", "cumulative_start",
                                         "cumulative_end", "total_days_validated", "archived", "archived_date", f"{c} AS created_at")
             for i, (d, t, c, w) in _BATCH.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("upsert_run_window", _UPSERT_SQL, ("run_windows",))
def upsert_run_window(spark, sf):
    windows = FX.run_windows(spark, sf)
    return L.upsert_run_windows(windows, _later_batch(windows))


@query("upsert_run_table", _UPSERT_SQL, ("run_windows",))
def upsert_run_table(spark, sf):
    """The same batch merged into a stored table: only the run dates that it has are written."""
    stored = VersionedTable(spark, scratch_path(spark, "run-windows"), "run_date")
    stored.replace(FX.run_windows(spark, sf))
    stored.merge(_later_batch(stored.read()), L.upsert_run_windows)
    return stored.read()


@query("append_history", "SELECT * FROM history", ("history",))
def append_history(spark, sf):
    inv = FX.invoices(spark, sf)
    d = FX.history_run_date()
    first = L.history_rows(inv.where(F.col("order_key") % 30 < 20), d)
    second = L.history_rows(inv.where(F.col("order_key") % 30 >= 15), d)
    path = scratch_path(spark, "history")
    L.persist(first, path)
    # the second batch re-runs dates 15..19: those partitions are replaced, the others not touched
    return L.replace_dates(second, path).select(*first.columns)


def _archived(spark, sf):
    log, win, hist = FX.run_log(spark, sf), FX.run_windows(spark, sf), FX.history(spark, sf)
    return (L.archive_before(log, CUTOFF, ARCHIVE_AS_OF, "start_date"),
            L.archive_before(win, CUTOFF, ARCHIVE_AS_OF, "start_date"),
            L.archive_before(hist, CUTOFF, ARCHIVE_AS_OF, "run_date"))


_ARCH = f"""SELECT 'run_log' AS table_name, count_if(start_date < DATE '{CUTOFF}') AS archived_rows FROM run_log
UNION ALL SELECT 'run_windows', count_if(start_date < DATE '{CUTOFF}') FROM run_windows
UNION ALL SELECT 'invoice_snapshots', count_if(run_date < DATE '{CUTOFF}') FROM history"""


@query("archive_before", _ARCH, ("run_log", "run_windows", "history"))
def archive_before(spark, sf):
    log, win, hist = _archived(spark, sf)
    counts = [t.agg(F.count_if(F.col("archived_date") == F.lit(ARCHIVE_AS_OF).cast("date")).alias("archived_rows"))
              .select(F.lit(n).alias("table_name"), "archived_rows")
              for n, t in (("run_log", log), ("run_windows", win), ("invoice_snapshots", hist))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("purge_archived", f"""SELECT 'run_log' AS table_name, count_if(start_date >= DATE '{CUTOFF}') AS remaining_rows,
  count_if(start_date < DATE '{CUTOFF}') AS deleted_rows FROM run_log
UNION ALL SELECT 'run_windows', count_if(start_date >= DATE '{CUTOFF}'), count_if(start_date < DATE '{CUTOFF}') FROM run_windows
UNION ALL SELECT 'invoice_snapshots', count_if(run_date >= DATE '{CUTOFF}'), count_if(run_date < DATE '{CUTOFF}') FROM history
UNION ALL SELECT 'total', NULL, (SELECT count_if(start_date < DATE '{CUTOFF}') FROM run_log)
  + (SELECT count_if(start_date < DATE '{CUTOFF}') FROM run_windows)
  + (SELECT count_if(run_date < DATE '{CUTOFF}') FROM history)""", ("run_log", "run_windows", "history"))
def purge_archived(spark, sf):
    parts = []
    tables = (("run_log", FX.run_log(spark, sf), "start_date"), ("run_windows", FX.run_windows(spark, sf), "start_date"),
              ("invoice_snapshots", FX.history(spark, sf), "run_date"))
    for name, rows, by in tables:
        stored = VersionedTable(spark, scratch_path(spark, name), by)
        before = stored.replace(rows.hint("rebalance", by))  # bounded tasks, whatever the table's size
        old = F.col(by) < F.lit(CUTOFF).cast("date")
        stored.change(lambda df: L.archive_before(df, CUTOFF, ARCHIVE_AS_OF, by), old)
        after = stored.change(lambda df: L.purge_archived(df, PURGE_AS_OF), old)
        parts.append(stored.read(after).agg(F.count(F.lit(1)).alias("remaining_rows")).select(
            F.lit(name).alias("table_name"), "remaining_rows", (F.lit(stored.version(before).rows) - F.col("remaining_rows")).alias("deleted_rows")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    total = out.agg(F.sum("deleted_rows").cast("long").alias("deleted_rows")).select(
        F.lit("total").alias("table_name"), F.lit(None).cast("long").alias("remaining_rows"), "deleted_rows")
    return out.unionByName(total)  # T26 fixed: the total sums all three tables


@query("active_only", f"SELECT id, run_date FROM history WHERE run_date >= DATE '{CUTOFF}'", ("history",))
def active_only(spark, sf):
    path = scratch_path(spark, "history")
    L.persist(FX.history(spark, sf), path)
    due = F.col("run_date") < F.lit(CUTOFF).cast("date")
    return L.active(L.rewrite(spark, path, lambda df: L.archive_before(df, CUTOFF, ARCHIVE_AS_OF, "run_date"), due)).select("id", "run_date")


@query("retain_snapshots", "SELECT id, run_date FROM history WHERE run_date >= DATE '2024-02-15' - 30", ("history",))
def retain_snapshots(spark, sf):
    path = scratch_path(spark, "snapshots")
    L.persist(FX.history(spark, sf), path)
    old = F.col("run_date") < F.date_sub(F.lit("2024-02-15").cast("date"), 30)
    return L.rewrite(spark, path, lambda df: L.retain_snapshots(df, "2024-02-15"), old).select("id", "run_date")


@query("filter_run_range", """SELECT run_date, to_json([struct_pack(invoice_no := invoice_no, vendor_name := vendor_name,
  invoice_date := invoice_date, gstin := gstin, pan := pan, hsn_code := hsn_code, taxable_value := taxable_value,
  total_amount := total_amount, hash := hash)]) AS invoice_data, run_type, id FROM history
WHERE run_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-07' ORDER BY run_date, id""", ("history",))
def filter_run_range(spark, sf):
    # nested array<struct> kept in the library; JSON text here so both engines print it alike
    r = L.snapshots_in_range(FX.history(spark, sf), "2024-01-05", "2024-01-07")
    return r.withColumn("invoice_data", F.to_json("invoice_data", {"ignoreNullFields": "false"}))


@query("filter_invoice_date", """SELECT id, invoice_no, invoice_date FROM history
WHERE invoice_date BETWEEN '1998-01-01' AND '1998-12-31'""", ("history",))
def filter_invoice_date(spark, sf):
    return L.invoices_between(FX.history(spark, sf), "1998-01-01", "1998-12-31").select("id", "invoice_no", "invoice_date")


@query("run_bounds", """SELECT (SELECT max(run_date) FROM run_windows) AS last_run_date, 'run_windows' AS last_run_source,
  (SELECT min(start_date) FROM run_windows) AS first_validation_date""", ("run_windows",))
def run_bounds(spark, sf):
    return L.run_bounds(FX.run_windows(spark, sf), FX.run_log(spark, sf))


@query("run_bounds_fallback", f"""SELECT (SELECT max(end_date) FROM run_log WHERE start_date >= DATE '{CUTOFF}') AS last_run_date,
  'run_log' AS last_run_source,
  (SELECT min(start_date) FROM run_log WHERE start_date >= DATE '{CUTOFF}') AS first_validation_date""", ("run_log",))
def run_bounds_fallback(spark, sf):
    log, win, _ = _archived(spark, sf)
    # every window archived -> the legacy log answers (T25: the source column says so)
    all_archived = win.withColumn("archived", F.lit(True))
    return L.run_bounds(all_archived, log)


@query("ordered_runs", "SELECT start_date, end_date, run_date, run_type FROM run_windows ORDER BY start_date",
       ("run_windows",))
def ordered_runs(spark, sf):
    return L.ordered_runs(FX.run_windows(spark, sf), FX.run_log(spark, sf))


@query("table_counts", """SELECT 'run_log' AS table_name, count(*) AS rows FROM run_log
UNION ALL SELECT 'run_windows', count(*) FROM run_windows UNION ALL SELECT 'invoice_snapshots', count(*) FROM history""",
       ("run_log", "run_windows", "history"))
def table_counts(spark, sf):
    return L.table_counts(run_log=FX.run_log(spark, sf), run_windows=FX.run_windows(spark, sf),
                          invoice_snapshots=FX.history(spark, sf))


@query("evolve_schema", """SELECT id, coalesce(archived, false) AS archived, archived_date, '' AS notes,
  run_date, run_type FROM run_log""", ("run_log",))
def evolve_schema(spark, sf):
    log = FX.run_log(spark, sf).select("id", "run_date", "run_type", "archived")
    return L.evolve_schema(log, {"id": ("long", None), "archived": ("boolean", False),
                                 "archived_date": ("date", None), "notes": ("string", "")})


_SNAP_DAYS = ("2024-01-28", "2024-01-29", "2024-01-30")
_SNAP_SQL = f"""(SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id, CAST(ts AS DATE) AS run_date FROM events
  WHERE CAST(ts AS DATE) IN ({', '.join(f"DATE '{d}'" for d in _SNAP_DAYS)}) AND (CAST(ts AS DATE) <> DATE '{_SNAP_DAYS[1]}' OR event_id % 2 = 0))"""


def _snapshots(spark, sf):
    """Three days; the second is saved whole, and again with half of its rows."""
    from ..session import table
    user = F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user_id")
    e = table(spark, sf, "events").select("event_id", "event_type", user, F.to_date("ts").alias("day"))
    path = scratch_path(spark, "snapshots")
    for day, kept in (*((d, F.lit(True)) for d in _SNAP_DAYS), (_SNAP_DAYS[1], F.col("event_id") % 2 == 0)):
        rows = e.where((F.col("day") == F.lit(day).cast("date")) & kept).drop("day")
        stored, keys = SK.save_snapshot(rows, path, day, ["event_id", "user_id"])
    return stored, keys


@query("save_snapshot", f"SELECT event_id, run_date, event_type, user_id FROM {_SNAP_SQL}")
def save_snapshot(spark, sf):
    return _snapshots(spark, sf)[0].select("event_id", "run_date", "event_type", "user_id")


@query("snapshot_metadata", f"""SELECT run_date, count(*) AS rows, 'event_id, event_type, user_id' AS columns, count(event_id) AS event_ids, count(user_id) AS user_ids,
  concat_ws(', ', CASE WHEN count(DISTINCT event_id) > count(*) * 0.8 THEN 'event_id' END, CASE WHEN count(DISTINCT user_id) > count(*) * 0.8 THEN 'user_id' END) AS detected_keys
FROM {_SNAP_SQL} GROUP BY GROUPING SETS ((run_date), ())""")
def snapshot_metadata(spark, sf):
    keys = _snapshots(spark, sf)[1]
    return keys.select("run_date", "rows", F.array_join(F.array_sort("columns"), ", ").alias("columns"), F.col("non_null")["event_id"].alias("event_ids"),
                       F.col("non_null")["user_id"].alias("user_ids"), F.array_join("detected_keys", ", ").alias("detected_keys"))


@query("publish_latest", "SELECT * FROM dashboard", ("dashboard",))
def publish_latest(spark, sf):
    path = scratch_path(spark, "published")
    board = FX.dashboard(spark, sf)
    SK.publish_latest(board.where("Validation_Status = 'PASS'"), path)  # yesterday's, to be replaced
    return SK.publish_latest(board, path)[0]


@query("write_validation_report", """SELECT 'validation' AS report, *, coalesce(CAST(inv_date AS TIMESTAMP), TIMESTAMP '1990-01-01') AS created_at FROM validations
UNION ALL SELECT 'discrepancy', *, coalesce(CAST(inv_date AS TIMESTAMP), TIMESTAMP '1990-01-01') FROM validations WHERE discrepancies IS NOT NULL
ORDER BY 1, created_at DESC""", ("validations",))
def write_validation_report(spark, sf):
    made = F.coalesce(F.col("inv_date").cast("timestamp"), F.lit("1990-01-01 00:00:00").cast("timestamp"))
    # both reports are put in order together
    every, some, _ = SK.write_validation_report(FX.validations(spark, sf).withColumn("created_at", made), scratch_path(spark, "reports"), ordered=False)
    return every.withColumn("report", F.lit("validation")).unionByName(some.withColumn("report", F.lit("discrepancy"))).orderBy("report", F.desc("created_at"))


@query("append_validations", """SELECT invoice_number, status, inv_currency, 'System' AS inv_created_by,
  CAST(0.0 AS DOUBLE) AS vendor_advance, 's1' AS session_id FROM validations""", ("validations",))
def append_validations(spark, sf):
    v = FX.validations(spark, sf)
    out = SK.append_validations(v, scratch_path(spark, "validations"), "s1", "2024-01-31 00:00:00")
    return out.select("invoice_number", "status", "inv_currency", "inv_created_by", "vendor_advance", "session_id")


@query("append_processing_log", """SELECT session_id, operation, status, message, details, timestamp FROM proc_log""",
       ("proc_log",))
def append_processing_log(spark, sf):
    return SK.append_processing_log(FX.processing_log(spark, sf), scratch_path(spark, "processing_log"))


@query("scan_table", "SELECT * FROM proc_log ORDER BY timestamp DESC", ("proc_log",))
def scan_table(spark, sf):
    path = scratch_path(spark, "processing_logs")
    FX.processing_log(spark, sf).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).orderBy(F.desc("timestamp"))


@query("session_rows", """SELECT invoice_number, CASE WHEN substr(hash_value, 1, 1) < '4' THEN 'upload_s1' ELSE 'production_s1' END AS processed_by
FROM validations WHERE substr(hash_value, 1, 1) < '8'""", ("validations",))
def session_rows(spark, sf):
    """The rows of one of two sessions, which has two sources."""
    digit = F.substring("hash_value", 1, 1)
    source = F.when(digit < "4", "upload_s1").when(digit < "8", "production_s1").otherwise("production_s2")
    return L.session_rows(FX.validations(spark, sf).withColumn("processed_by", source), "s1").select("invoice_number", "processed_by")


_FILES = "(SELECT nullif(batch, 'de') AS batch, name, size FROM doc_files)"  # some files have no batch


def _files(spark, sf):
    return FX.files_from_documents(spark, sf).drop("doc_id").withColumn("batch", F.nullif(F.col("batch"), F.lit("de")))


_RUN = "sum(size) OVER (PARTITION BY batch ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("running_size", f"SELECT batch, name, size, {_RUN} AS running FROM {_FILES}", ("doc_files",))
def running_size(spark, sf):
    from ..operators.common import running_total
    return running_total(_files(spark, sf), "batch", "name", "size")


@query("bundle_under_cap", f"SELECT batch, name, size FROM (SELECT *, {_RUN} AS r FROM {_FILES}) WHERE r <= 200000",
       ("doc_files",))
def bundle_under_cap(spark, sf):
    return SK.bundle_stop(_files(spark, sf), "batch", "name", "size", 200000)


@query("bundle_skip_variant")
def bundle_skip_variant(spark, sf):
    # the greedy skip rule is sequential per mail: a mail carries a bounded candidate list
    files = FX.files_from_documents(spark, sf).withColumn("batch", F.floor(F.col("doc_id") / 50)).drop("doc_id")
    return SK.bundle_skip(files, "batch", "name", "size", 60000)
