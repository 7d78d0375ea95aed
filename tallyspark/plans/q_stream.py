"""Registered queries: streaming jobs over file batches derived from the driver tables
(FIXTURES B7: events split by time into two arrivals; the ledger split by order date)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path, table
from ..streaming import jobs as J
from . import fixtures as FX
from .q_core import _ISSUE_LIST
from .registry import query

SPLIT_TS = "2024-01-16 00:00:00"


@query("stream_ingest", f"""SELECT "InvID", array_to_string(issues, '; ') AS issues FROM (
  SELECT l."InvID", {_ISSUE_LIST.replace("CASE WHEN d.n > 1 THEN 'duplicate invoice number' END,", "")} AS issues
  FROM ledger l)""", ("ledger",))
def stream_ingest(spark, sf):
    led = FX.ledger(spark, sf).withColumn("_day", F.to_date("Voucherdate"))
    src, sink, ck = scratch_path(spark, "drops"), scratch_path(spark, "ingested"), scratch_path(spark, "ck")
    first = led.where(F.col("_day") < F.lit("1998-01-01").cast("date")).drop("_day")
    rest = led.where(~(F.col("_day") < F.lit("1998-01-01").cast("date"))).drop("_day")
    first.write.parquet(f"{src}/1")
    J.ingest(spark, f"{src}/*", first.schema, sink, ck)          # first arrival
    rest.write.parquet(f"{src}/2")
    J.ingest(spark, f"{src}/*", first.schema, sink, ck)          # resumes from the checkpoint
    out = spark.read.parquet(sink)
    return out.select("InvID", F.array_join("issues", "; ").alias("issues"))


def _event_drops(spark, sf):
    ev = table(spark, sf, "events")
    src = scratch_path(spark, "events")
    early = F.col("ts") < F.lit(SPLIT_TS).cast("timestamp_ntz")
    return ev, early, src


def _heartbeat(ev, src):
    """A late row that moves the watermark past the last day."""
    end = ev.agg(F.max("ts").alias("_end"))
    beat = ev.join(F.broadcast(end), F.col("ts") == F.col("_end")).limit(1).withColumn("ts", F.expr("ts + INTERVAL 3 DAYS")).drop("_end")
    beat.select(*ev.columns).write.parquet(f"{src}/9")


@query("stream_dedupe", """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
  k AS (SELECT user_id, event_type, rn, ts, event_id FROM e WHERE rn = 1
        UNION ALL SELECT user_id, event_type, rn, ts, event_id FROM (
          SELECT e.user_id, e.event_type, e.rn, e.ts, e.event_id, row_number() OVER (PARTITION BY e.user_id, e.event_type ORDER BY e.rn) AS f
          FROM k JOIN e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.rn > k.rn AND e.ts > k.ts + INTERVAL 1 HOUR) WHERE f = 1)
SELECT event_id, ts, user_id, event_type FROM k""")
def stream_dedupe(spark, sf):
    ev, early, src = _event_drops(spark, sf)
    sink, ck = scratch_path(spark, "dedup"), scratch_path(spark, "ck")
    run = lambda: J.dedupe(spark, f"{src}/*", ev.schema, sink, ck, ["user_id", "event_type"], order="event_id")
    ev.where(early).write.parquet(f"{src}/1")
    run()
    ev.where(~early).write.parquet(f"{src}/2")
    run()
    _heartbeat(ev, src)
    run()
    return spark.read.parquet(sink).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type")


@query("stream_daily_status", """SELECT CAST(ts AS DATE) AS day, CASE event_type WHEN 'error' THEN 'INVALID'
  WHEN 'signup' THEN 'FLAGGED' ELSE 'VALID' END AS status, count(*) AS rows FROM events GROUP BY 1, 2""")
def stream_daily_status(spark, sf):
    ev, early, src = _event_drops(spark, sf)
    sink, ck = scratch_path(spark, "daily"), scratch_path(spark, "ck")
    status = (F.when(F.col("event_type") == "error", F.lit("INVALID"))
               .when(F.col("event_type") == "signup", F.lit("FLAGGED")).otherwise(F.lit("VALID")))
    ev.where(early).write.parquet(f"{src}/1")
    J.daily_status(spark, f"{src}/*", ev.schema, sink, ck, status)
    ev.where(~early).write.parquet(f"{src}/2")
    J.daily_status(spark, f"{src}/*", ev.schema, sink, ck, status)
    _heartbeat(ev, src)  # closes the last day's windows
    J.daily_status(spark, f"{src}/*", ev.schema, sink, ck, status)
    return spark.read.parquet(sink).select(F.to_date("window_start").alias("day"), "status", "rows")
