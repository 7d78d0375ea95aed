"""Structured Streaming jobs.

Every job reads a file source, keeps its state and progress in a checkpoint
under the shared scratch folder (``spark.checkpoint.dir``) and uses the
``availableNow`` trigger, so one run drains what has arrived and a later run
resumes from the checkpoint with its state and watermark intact.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def row_rules(df: DataFrame, number: str = "PurchaseInvNo", date: str = "PurchaseInvDate",
              vendor: str = "PartyName", gst: str = "GSTNO", amount: str = "Total") -> DataFrame:
    """The single-row rules of ``operators.rules.apply_rules``.  The duplicate-number rule
    needs the whole table, so a stream applies it in the batch report, not per arrival."""
    from ..operators.rules import row_checks
    missing, values = row_checks([number, date, vendor, gst, amount], date, amount)
    return df.withColumn("issues", F.array_compact(F.array(*missing, *values)))


def _drain(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def ingest(spark: SparkSession, source: str, schema, sink: str, checkpoint: str) -> None:
    """Invoice drops validated on arrival: file source -> row rules -> Parquet sink.
    ``foreachBatch`` writes each micro-batch to its own ``batch_id`` partition with
    overwrite, so a replayed batch after a failure replaces itself (idempotent)."""
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        (row_rules(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .parquet(f"{sink}/batch_id={batch_id}"))

    _drain(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start())


def dedupe(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, keys: list[str],
           delay: str = "1 hour", lateness: str | None = None, order: str | None = None) -> None:
    """Duplicate uploads are dropped: of rows with equal ``keys`` the earliest stays, and the first one that is more than
    ``delay`` later than the last one that stayed.

    Rows wait in the state of a window of their own time until the watermark has passed it, of a key's rows with equal times
    the one with the least ``order``.  What is released is judged a batch at a time in the order of time, after the last row
    of its key that stayed.  So the result does not depend on how rows are dealt to arrivals, as long as none is
    later than ``lateness`` (by default ``delay``); rows that are, are dropped by the watermark, and so are rows without a time.
    The last rows that stayed are kept in the checkpoint, batch by batch, and go when they can matter no more; a replayed
    batch replaces itself.  A task holds an Arrow batch of a key's rows, however many it has."""
    span = spark.sql(f"SELECT CAST(INTERVAL {delay} AS INTERVAL SECOND) AS d").first()["d"]
    micros = span.days * 86_400_000_000 + span.seconds * 1_000_000 + span.microseconds

    def stay(batches):
        last = 0
        for rows in batches:  # by key, each in the order of time
            keep = []
            for first, at in zip(rows["first"].to_pylist(), rows["at"].to_pylist()):
                keep.append(first or at > last + micros)
                if keep[-1]:
                    last = at
            yield rows.filter(pa.array(keep, pa.bool_()))

    s = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness or delay)
    whole = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}  # to the microsecond
    rank = F.col(order).cast("string") if order else F.lit("")
    rows = s.select("ts", *keys, F.struct(F.lpad(rank, 24, "0").alias("rank"), F.to_json(F.struct("*"), whole).alias("row")).alias("ranked"))
    released = rows.groupBy(*keys, F.window("ts", "1 microsecond").alias("time")).agg(F.min("ranked").alias("ranked"))
    released = released.select(*keys, F.unix_micros("time.start").alias("at"), "ranked.row")

    def judge(batch: DataFrame, batch_id: int) -> None:
        lasts = f"{checkpoint}/lasts"
        before = [batch.sparkSession.read.parquet(f"{lasts}/batch_id={batch_id - 1}")] if batch_id else []
        for last in before:
            batch = batch.unionByName(last.withColumn("row", F.lit(None).cast("string")))
        by_time = F.row_number().over(Window.partitionBy(*keys).orderBy("at"))
        kept = batch.withColumn("first", by_time == 1)
        kept = kept.mapInArrow(stay, kept.schema).where("row IS NOT NULL").select(F.from_json("row", s.schema, whole).alias("r"))
        kept.select("r.*").write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        kept = batch.sparkSession.read.schema(s.schema).parquet(f"{sink}/batch_id={batch_id}").select(*keys, F.unix_micros("ts").alias("at"))
        last = reduce(DataFrame.unionByName, before, kept)
        latest = last.agg(F.max("at")).first()[0]
        last.where(F.col("at") + micros >= F.lit(latest)).write.mode("overwrite").parquet(f"{lasts}/batch_id={batch_id}")

    _drain(released.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def daily_status(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, status: F.Column,
                 delay: str = "1 hour") -> None:
    """Tumbling one-day counts per status; a window is written once the watermark passes
    its end (append mode), rows later than the watermark are dropped."""
    s = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    agg = (s.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), status.alias("status"))
           .agg(F.count(F.lit(1)).alias("rows")))
    out = agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status", "rows")
    _drain(out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
           .outputMode("append").trigger(availableNow=True).start())
