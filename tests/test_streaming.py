"""Streaming: file arrivals in separate runs, checkpointed state, watermark movement."""
import datetime as dt

from pyspark.sql import functions as F

from tallyspark.session import scratch_path
from tallyspark.streaming import jobs as J

S = "event_id long, ts timestamp_ntz, user_id long, event_type string"
T0 = dt.datetime(2024, 1, 1, 10)
M = lambda m: T0 + dt.timedelta(minutes=m)
DROPS = [[(1, M(0), 1, "a"), (2, M(10), 1, "a"), (3, M(20), 2, "a")],
         [(4, M(30), 1, "a"),                  # duplicate of 1 while its state is held -> dropped
          (6, M(180), 9, "b")],                # moves the watermark to T0 + 2 h
         [(5, M(2 * 24 * 60), 1, "a")]]        # state of (1, a) expired -> kept


def test_dedupe_across_arrivals(spark):
    src, sink, ck = scratch_path(spark, "s"), scratch_path(spark, "o"), scratch_path(spark, "c")
    schema = spark.createDataFrame(DROPS[0], S).schema
    for i, drop in enumerate(DROPS):
        spark.createDataFrame(drop, S).write.parquet(f"{src}/{i}")
        J.dedupe(spark, f"{src}/*", schema, sink, ck, ["user_id", "event_type"], order="event_id")   # one run per arrival
    kept = sorted(r[0] for r in spark.read.parquet(sink).select("event_id").collect())
    assert kept == [1, 3, 6]  # 5 waits for the watermark to pass it


def test_dedupe_does_not_depend_on_the_arrivals(spark):
    """The same rows in time order, dealt at random, and all at once; equal times too."""
    import random
    rng = random.Random(5)
    events = [(i, M(rng.choice([0, 1, 59, 60, 61, 120, 121, 300]) + rng.randint(0, 3)), rng.randint(0, 2), "ab"[i % 2]) for i in range(60)]
    end = [(999, M(5000), 77, "end")]
    want, last = [], {}
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        k = e[2:]
        if k not in last or e[1] > last[k] + dt.timedelta(hours=1):
            last[k] = e[1]
            want.append(e[0])
    shuffled = rng.sample(events, len(events))
    for drops in ([events], [shuffled[:20], shuffled[20:45], shuffled[45:]], [sorted(events, key=lambda e: e[1])[:30], sorted(events, key=lambda e: e[1])[30:]]):
        src, sink, ck = scratch_path(spark, "s"), scratch_path(spark, "o"), scratch_path(spark, "c")
        for i, drop in enumerate([*drops, end]):
            spark.createDataFrame(drop, S).write.parquet(f"{src}/{i}")
            J.dedupe(spark, f"{src}/*", spark.createDataFrame(end, S).schema, sink, ck, ["user_id", "event_type"], lateness="1 day", order="event_id")
        assert sorted(r[0] for r in spark.read.parquet(sink).select("event_id").collect()) == sorted(want)


def test_dedupe_judges_batches_of_rows_not_keys(spark, monkeypatch):
    """After a released row its duplicates still go, late rows and rows without a time too; no key is a Python call of its own."""
    states, drain = [], J._drain
    monkeypatch.setattr(J, "_drain", lambda q: (drain(q), states.extend(x["operatorName"] for p in q.recentProgress for x in p["stateOperators"])))
    first = [(i, M(0), i, None) for i in range(300)] + [(1000 + i, M(10), i, None) for i in range(300)]
    drops = [[*first, (2000, M(70), 900, "b")],                      # the watermark: M(10)
             [(3000 + i, M(59), i, None) for i in range(300)]        # within an hour of a row that was released
             + [(4000 + i, M(61), i, None) for i in range(100)]      # later than that
             + [(5000, M(5), 901, "late"), (5001, None, 902, "no time"), (2001, M(71), 900, "b")],
             [(6000, M(5000), 903, "end")]]
    src, sink, ck = scratch_path(spark, "s"), scratch_path(spark, "o"), scratch_path(spark, "c")
    for i, drop in enumerate(drops):
        spark.createDataFrame(drop, S).write.parquet(f"{src}/{i}")
        J.dedupe(spark, f"{src}/*", spark.createDataFrame(drop, S).schema, sink, ck, ["user_id", "event_type"], order="event_id")
    kept = sorted(r[0] for r in spark.read.parquet(sink).select("event_id").collect())
    assert kept == [*range(300), 2000, *range(4000, 4100)]
    assert set(states) == {"stateStoreSave"}


def test_daily_windows_close_behind_watermark(spark):
    src, sink, ck = scratch_path(spark, "s"), scratch_path(spark, "o"), scratch_path(spark, "c")
    schema = spark.createDataFrame(DROPS[0], S).schema
    for i, drop in enumerate(DROPS):
        spark.createDataFrame(drop, S).write.parquet(f"{src}/{i}")
    J.daily_status(spark, f"{src}/*", schema, sink, ck, F.col("event_type"))
    out = sorted((r["status"], r["rows"]) for r in spark.read.parquet(sink).collect())
    assert out == [("a", 4), ("b", 1)]                 # day 1 closed; day 3 still open


def test_row_rules_match_batch_rules(spark):
    from tallyspark.operators import rules as R
    df = spark.createDataFrame([("I1", "2024-01-05", "A", "g", "-5"), ("", "x", "B", None, "n/a")],
                               "PurchaseInvNo string, PurchaseInvDate string, PartyName string, GSTNO string, Total string")
    a = sorted(map(tuple, (r["issues"] for r in J.row_rules(df).collect())))
    b = sorted(map(tuple, (r["issues"] for r in R.apply_rules(df).collect())))
    assert a == b
