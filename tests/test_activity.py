"""Keyed state with a lifetime: the stream's closed spans are the table's."""

import datetime as dt

from pyspark.sql import functions as F

from mnemodex.streaming import activity

EVENTS = "event_id long, ts timestamp, user_id long, event_type string"


def started(spark, tmp_path, batches, life, late):
    """The rows of a stream that gets ``batches`` one by one, and the query's last state."""
    activity.state_store(spark)
    source, rows = str(tmp_path / "in"), []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(EVENTS).parquet(source)
    q = None
    for batch in batches:
        batch.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").coalesce(1).write.mode("append").parquet(source)
        collect = lambda df, n: rows.extend(df.collect())
        q = activity.follow(stream, life, late).writeStream.foreachBatch(collect).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    return rows, q.recentProgress[-1]


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def test_late_and_repeated_events(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame([(i, at(h), u, t) for i, h, u, t in rows], EVENTS)
    batches = [
        make((1, 0, 1, "a"), (2, 30, 1, "b"), (3, 1, 2, "c"), (2, 30, 1, "b")),  # 1 and 2 are two spans of user 1
        make((4, 9, 1, "late"), (5, 18, 1, "bridge"), (3, 1, 2, "c"), (None, 2, 2, "x"), (9, 2, None, "x")),  # now 1, 4, 5 are a span; 18 and 30 are 12 apart: broken
        make((6, 100, 3, "z")),
        make((7, 5, 2, "too late"), (8, 101, 3, "y")),
    ]
    rows, progress = started(spark, tmp_path, batches, 12 * 3600, "36 hours")
    closed = sorted((r.user_id, r.first, r.last, r.event_id, r.event_type) for r in rows if not r.open)
    assert closed == [(1, at(0), at(18), 5, "bridge"), (1, at(30), at(30), 2, "b"), (2, at(1), at(1), 3, "c")]
    opened = [(r.user_id, r.event_id) for r in rows if r.open]
    assert opened[-2:] == [(3, 6), (3, 8)] and len(opened) == 6  # what doesn't change a span is no row
    assert activity.spans(spark.createDataFrame([], EVENTS), 60).count() == 0


def test_the_stream_has_the_spans_of_the_table(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    slices = [df.filter(F.dayofmonth("ts").between(a, b)) for a, b in ((1, 10), (11, 22), (23, 31))]
    rows, _ = started(spark, tmp_path, slices, 12 * 3600, "1 day")
    end = df.agg(F.max("ts")).first()[0] - dt.timedelta(days=1)
    want = sorted(tuple(r) for r in activity.spans(df, 12 * 3600).collect() if r["last"] + dt.timedelta(hours=12) <= end.replace(microsecond=end.microsecond // 1000 * 1000))
    assert sorted((r.user_id, r.first, r.last, r.event_id, r.event_type) for r in rows if not r.open) == want and want
