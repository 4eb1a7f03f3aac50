"""Streaming complete days: memory sink, watermark-driven append."""

import datetime as dt
import os

from wattle.streaming.daily import stream_complete_days


def test_stream_complete_days(spark, scratch):
    rows = []
    t0 = dt.datetime(2024, 1, 1)
    for d in range(3):
        for h in range(24):
            if d == 1 and h == 5:
                continue                      # day 2 incomplete
            rows.append((1, t0 + dt.timedelta(days=d, hours=h), 1.0 + h))
    rows.append((1, t0 + dt.timedelta(days=6), 1.0))   # pushes the watermark past day 3
    src = os.path.join(scratch, "in")
    spark.createDataFrame(rows, "meter_id bigint, read_ts timestamp, reading double").write.parquet(src)
    stream = spark.readStream.schema("meter_id bigint, read_ts timestamp, reading double").parquet(src)
    q = (stream_complete_days(stream, "1 hour").writeStream.outputMode("append").format("memory")
         .queryName("days_out").option("checkpointLocation", os.path.join(scratch, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.day, r.x[0], r.x[23]) for r in spark.sql("select * from days_out").collect())
    assert got == [(dt.date(2024, 1, 1), 1.0, 24.0), (dt.date(2024, 1, 3), 1.0, 24.0)]
