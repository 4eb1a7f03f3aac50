"""Complete days from a stream of hourly readings.

The same rule as ``operators.prepare.complete_days`` (24 rows, 24 distinct hours,
positive sum) applied to an unbounded reading stream: an event-time watermark bounds the
state, and in append mode each meter-day is emitted once, after the watermark has passed
the end of that day. Late readings beyond the watermark are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prepare import FULL_DAY_MASK, HOURS


def stream_complete_days(readings: DataFrame, watermark: str = "1 day", strict: bool = True) -> DataFrame:
    """``readings``: streaming ``meter_id, read_ts TIMESTAMP, reading`` ->
    ``meter_id, day DATE, x ARRAY<DOUBLE>`` (append mode)."""
    r = readings.withWatermark("read_ts", watermark).withColumn("_h", F.hour("read_ts"))
    g = r.groupBy("meter_id", F.window("read_ts", "1 day").alias("_w")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bit_or(F.expr("shiftleft(1, _h)")).alias("_mask"),
        F.sum("reading").alias("_total"),
        F.array(*[F.max(F.when(F.col("_h") == h, F.col("reading"))) for h in range(HOURS)]).alias("x"),
    )
    keep = (F.col("_n") == HOURS) & (F.col("_total") > 0.0) & ~F.isnan("_total")
    if strict:
        keep = keep & (F.col("_mask") == FULL_DAY_MASK)
    return g.where(keep).select("meter_id", F.to_date(F.col("_w.start")).alias("day"), "x")
