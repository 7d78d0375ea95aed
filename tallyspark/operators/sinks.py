"""Sinks: Parquet tables in the shared scratch/warehouse folder.

Writes go through Spark's job commit protocol; partitioned tables are
rewritten with dynamic partition overwrite so only touched partitions change.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import constants as K
from .versions import VersionedTable


STATUSES = ("VALID", "INVALID", "FLAGGED", "UNKNOWN")


def write_status_sheets(report: DataFrame, path: str, status: str = "Status", amount: str | None = "Amount",
                        vendor: str | None = None) -> dict[str, DataFrame]:
    """The report's sheets, written in one pass: ``ALL`` is a stored table with a partition per status, ``VALID``,
    ``INVALID``, ``FLAGGED`` and ``UNKNOWN`` are those partitions, and ``SUMMARY`` (``metric, value``) comes from sums
    observed while the rows were written.  The median and the vendors, which are no sums, are read
    from the stored table's columns.  Any other status is ``UNKNOWN``."""
    from .summary import exact_median, most_frequent
    named = F.upper(F.coalesce(F.col(status), F.lit("UNKNOWN")))
    named = F.when(named.isin(*STATUSES), named).otherwise("UNKNOWN")
    a = F.col(amount) if amount else F.lit(None).cast("decimal(18,2)")
    seen = Observation()
    counts = [F.count_if(named == s).alias(s) for s in STATUSES]
    rows = report.observe(seen, F.count(F.lit(1)).alias("rows"), *counts, F.sum(a).alias("total"), F.count(a).alias("amounts"),
                          F.max(a).alias("most"), F.min(a).alias("least"))
    stored = VersionedTable(report.sparkSession, path, "status")
    stored.replace(rows.withColumn("status", named))
    everything, n = stored.read(), seen.get
    sheets = {"ALL": everything, **{s: everything.where(F.col("status") == s) for s in STATUSES}}
    share = lambda k: f"{n[k]} ({_percent(n[k], n['rows'])})"
    lines = [("Total Records", str(n["rows"])), ("Valid Records", share("VALID")), ("Invalid Records", share("INVALID")),
             ("Flagged Records", share("FLAGGED")), ("Unknown Status", share("UNKNOWN")), ("Success Rate", _percent(n["VALID"], n["rows"]))]
    if amount:
        median = exact_median(everything, F.col(amount), "m").first()
        average = n["total"] / n["amounts"] if n["amounts"] else None
        lines += [("Total Amount", n["total"] or 0), ("Average Amount", average), ("Median Amount", median and median["m"]),
                  ("Max Amount", n["most"]), ("Min Amount", n["least"])]
        lines[-5:] = [(k, "N/A" if v is None else f"₹{Decimal(str(v)).quantize(Decimal('0.01'), ROUND_HALF_UP):,}") for k, v in lines[-5:]]
    if vendor:
        top = most_frequent(everything, F.col(vendor), "v").first()
        lines += [("Unique Vendors", str(everything.agg(F.count_distinct(vendor)).first()[0])), ("Top Vendor", top["v"] if top else "N/A")]
    sheets["SUMMARY"] = report.sparkSession.createDataFrame(lines, "metric string, value string")
    return sheets


def _percent(part: int, whole: int) -> str:
    """A share with one decimal, halves up."""
    return f"{Decimal(part * 100 / Decimal(whole)).quantize(Decimal('0.1'), ROUND_HALF_UP)}%" if whole else "0%"


def write_validation_report(rows: DataFrame, path: str, newest: str = "created_at", ordered: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """The validation report (all rows) and the discrepancy report (those with discrepancies), newest first, and the
    number of rows of both: one write of the rows, each file newest first and divided by whether they have
    discrepancies, which is counted on the way.  The second report reads its part only.  Reading puts the files' rows in
    one order, the only time that the rows are dealt; not ``ordered``: the caller does (of both reports at once, say)."""
    seen = Observation()
    has = F.col("discrepancies").isNotNull()
    stored = VersionedTable(rows.sparkSession, path, "has_discrepancy")
    sorted_rows = rows.withColumn("has_discrepancy", has).sortWithinPartitions("has_discrepancy", F.desc(newest))
    stored.replace(sorted_rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(has).alias("discrepancies")))
    reports = [stored.read(), stored.read().where("has_discrepancy")]
    every, some = (r.orderBy(F.desc(newest)) if ordered else r for r in reports)
    return every.drop("has_discrepancy"), some.drop("has_discrepancy"), seen.get


VALIDATION_DEFAULTS = {  # fixed values: column defaults of the validations table
    "status": "pending", "inv_currency": "USD", "inv_created_by": "System", "vendor_advance": 0.0,
}


def append_validations(rows: DataFrame, path: str, session_id: str, created_at) -> DataFrame:
    """Append rows with the table defaults; the row key is the content hash."""
    out = rows
    for c, v in VALIDATION_DEFAULTS.items():
        lit = F.lit(v).cast("double") if isinstance(v, float) else F.lit(v)
        out = out.withColumn(c, F.coalesce(F.col(c), lit) if c in rows.columns else lit)
    out = out.withColumn("session_id", F.lit(session_id)).withColumn("created_at", F.lit(created_at).cast("timestamp"))
    out.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def append_processing_log(log: DataFrame, path: str) -> DataFrame:
    log.select("session_id", "operation", "status", "message", "details", "timestamp").write.mode("append").parquet(path)
    return log.sparkSession.read.parquet(path)


SNAPSHOT_META = "run_date date, rows long, columns array<string>, keys map<string,struct<non_null:long,sketch:binary>>"


def save_snapshot(df: DataFrame, path: str, run_date, key_candidates: list[str]) -> tuple[DataFrame, DataFrame]:
    """Stores a day's snapshot in the place of what the day held, and a metadata row for it, in one pass over the rows:
    their number, and per candidate key the non-null values and a mergeable sketch of the distinct ones, are
    observed while they are written.  Returns the stored snapshots and :func:`snapshot_keys` of their metadata."""
    spark, day = df.sparkSession, F.lit(str(run_date)).cast("date")
    present = [c for c in key_candidates if c in df.columns]
    seen = Observation()
    sketches = [m for i, c in enumerate(present) for m in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), F.lit(14)).alias(f"s{i}"))]
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"), *sketches).withColumn("run_date", day)
    data, meta = VersionedTable(spark, f"{path}/data", "run_date"), VersionedTable(spark, f"{path}/metadata", "run_date")

    def put(table: VersionedTable, new: DataFrame) -> None:
        table.change(lambda old: new, F.col("run_date") == day) if table.versions() else table.replace(new)

    put(data, rows)
    n = seen.get
    keys = {c: (n[f"n{i}"], bytes(n[f"s{i}"]) if n[f"s{i}"] is not None else None) for i, c in enumerate(present)}
    row = spark.createDataFrame([(str(run_date), n["rows"], df.columns, keys)], SNAPSHOT_META.replace("run_date date", "run_date string"))
    put(meta, row.withColumn("run_date", F.col("run_date").cast("date")))
    return data.read(), snapshot_keys(meta.read())


def snapshot_keys(meta: DataFrame, threshold: float = K.KEY_RATIO) -> DataFrame:
    """Per day and, with ``run_date`` null, over all days: ``rows, columns, non_null`` (by candidate) and
    ``detected_keys``, whose distinct values are more than ``threshold`` of the rows.  Days are merged by
    their sketches; the snapshots are not read again."""
    parts = meta.select("run_date", "rows", "columns", F.explode("keys").alias("name", "k")).select("run_date", "rows", "columns", "name", "k.*")
    days = meta.agg(F.sum("rows").alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("columns")))).alias("columns"))
    merged = parts.groupBy("name").agg(F.sum("non_null").alias("non_null"), F.hll_union_agg("sketch").alias("sketch"))
    merged = merged.join(F.broadcast(days)).select(F.lit(None).cast("date").alias("run_date"), "rows", "columns", "name", "non_null", "sketch")
    found = F.hll_sketch_estimate("sketch") > F.col("rows") * threshold
    return parts.unionByName(merged).groupBy("run_date", "rows", "columns").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "non_null")))).alias("non_null"),
        F.sort_array(F.collect_list(F.when(found, F.col("name")))).alias("detected_keys"))


def publish_latest(df: DataFrame, path: str, placeholder: dict | None = None) -> tuple[DataFrame, int]:
    """Publish today's result for the dashboard as the next version of a stored table, and give it read back, with the
    version's number; an empty input publishes one placeholder row.  The written copy is counted against
    its source first, and readers see the old version until the new one is whole (:mod:`.versions`)."""
    if placeholder is not None and df.isEmpty():
        df = df.sparkSession.createDataFrame([placeholder], df.schema)
    published = VersionedTable(df.sparkSession, path)
    number = published.replace(df)
    return published.read(number), number


def bundle_stop(files: DataFrame, batch: str, name: str, size: str, cap: int) -> DataFrame:
    """Invoice documents: take files in name order until the first overflow (prefix rule)."""
    from .common import running_total
    return running_total(files, batch, name, size, "_cum").where(F.col("_cum") <= cap).drop("_cum")


def bundle_skip(files: DataFrame, batch: str, name: str, size: str, cap: int) -> DataFrame:
    """Reports: skip a file that would overflow and continue with the next (greedy,
    sequential per batch -> ``applyInPandas``).  Files larger than the cap are dropped
    before the shuffle; a batch is one mail's candidate list."""
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(name, kind="stable")
        total, keep = 0, []
        for s in pdf[size].tolist():
            ok = total + s <= cap
            keep.append(ok)
            total += s if ok else 0
        return pdf[keep]

    return files.where(F.col(size) <= cap).groupBy(batch).applyInPandas(pack, schema=files.schema)
