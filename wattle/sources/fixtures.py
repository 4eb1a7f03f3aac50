"""Meter data derived from the ``events`` table.

Every user is a meter and every event is consumption in the hour it falls in; an hour
without events consumed 0. A meter reports all 24 hours of every day on which it had at
least one event. Nothing is filtered out: the number of meters grows with the table.

* ``meter_days``       one row per (meter, day): the 24 hourly sums
* ``meter_lines``      the same hours as raw tab-separated text lines, with faults
                       injected (missing, duplicated and malformed lines) for the ingest rules
* ``weather_readings`` one row per (meter, date, hour) with reading and a temperature
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prepare import HOURS
from ..session import tasks_for

# Fault injection for the raw text fixture. A line key
# k = (meter_id * 1000 + day_of_year) * 24 + hour selects the fault by divisibility,
# checked in this order.
FAULT_DROP_LINE = 1009     # the hour's line is missing (day becomes incomplete)
FAULT_DUPLICATE = 1013     # the hour's line appears twice (25 rows)
FAULT_EMPTY = 997          # reading is empty
FAULT_NOT_A_NUMBER = 991   # reading '1a5': matches the numeric pattern, does not parse
FAULT_LEADING_DOT = 983    # reading '.5': fails the pattern
FAULT_EXPONENT = 977       # reading '1e1': matches the pattern and parses to 10
FAULT_UTC_OFFSET = 971     # timestamp carries a '-06' offset suffix (wall clock is kept)

DAYS_PER_TASK = 10_000     # meter-days dealt to one task: 240,000 hours


def meter_days(events: DataFrame) -> DataFrame:
    """``meter_id BIGINT, day DATE, v ARRAY<DOUBLE>`` (24 hourly sums rounded to cents)."""
    e = events.select(
        F.col("user_id").cast("long").alias("meter_id"),
        F.to_date("ts").alias("day"),
        F.hour("ts").alias("hour"),
        "value",
    )
    slots = ", ".join(f"round(coalesce(sum(CASE WHEN hour = {h} THEN value END), 0.0D), 2)" for h in range(HOURS))
    # Events are folded map-side (24 sums per meter-day cross the network, however busy the
    # day). The result is small in bytes but expands 24x downstream (lines, parsing, weather
    # rows), so it is then dealt out explicitly: adaptive coalescing would leave it in a few
    # tasks, and an explicit count is never coalesced. The count follows the number of
    # meter-days, estimated in one pass, so that a task's hours do not grow with the table. The
    # keys are named in another order than the aggregate's: in the same order and with the same
    # count, Spark takes the exchange for a repeated one, drops it and coalesces after all.
    n = e.agg(F.approx_count_distinct(F.xxhash64("meter_id", "day"))).first()[0]
    days = e.groupBy("meter_id", "day").agg(F.expr(f"array({slots})").alias("v"))
    return days.repartition(tasks_for(events.sparkSession, n, DAYS_PER_TASK), "day", "meter_id")


def full_days(events: DataFrame) -> DataFrame:
    """``meter_id, day, x``: the days as a meter reports them without faults, as
    ``prepare.complete_days`` keeps them (a positive total)."""
    total = F.aggregate("v", F.lit(0.0), lambda a, v: a + v)
    return meter_days(events).where(total > 0.0).select("meter_id", "day", F.col("v").alias("x"))


def _hours(events: DataFrame) -> DataFrame:
    return meter_days(events).select(
        "meter_id", "day", F.posexplode("v").alias("hour", "reading")
    )


def _line_key() -> F.Column:
    return (F.col("meter_id") * 1000 + F.dayofyear("day")) * 24 + F.col("hour")


def meter_lines(events: DataFrame) -> DataFrame:
    """``line STRING``: ``meter<TAB>yyyy-MM-dd HH:00:00<TAB>reading`` with injected faults."""
    k = _line_key()
    copies = (
        F.when(k % FAULT_DROP_LINE == 0, 0).when(k % FAULT_DUPLICATE == 0, 2).otherwise(1)
    )
    reading = (
        F.when(k % FAULT_EMPTY == 0, F.lit(""))
        .when(k % FAULT_NOT_A_NUMBER == 0, F.lit("1a5"))
        .when(k % FAULT_LEADING_DOT == 0, F.lit(".5"))
        .when(k % FAULT_EXPONENT == 0, F.lit("1e1"))
        .otherwise(F.col("reading").cast("decimal(12,2)").cast("string"))
    )
    ts = F.concat(
        F.date_format("day", "yyyy-MM-dd"), F.lit(" "),
        F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00:00"),
        F.when(k % FAULT_UTC_OFFSET == 0, F.lit("-06")).otherwise(F.lit("")),
    )
    line = F.concat_ws("\t", F.col("meter_id").cast("string"), ts, reading)
    # The text is built before the copies are exploded, so a parse filter downstream stays
    # above the generator and never re-derives the text per predicate.
    return _hours(events).select(F.explode(F.array_repeat(line, copies)).alias("line"))


def temperature_formula(meter_id, day, hour) -> F.Column:
    """Fixed value: a deterministic temperature (-2..33 C) visiting all three regimes."""
    return ((meter_id * 7 + F.dayofyear(day) * 13 + hour * 5) % 36 - 2).cast("double")


def weather_readings(events: DataFrame) -> DataFrame:
    """``meter_id BIGINT, read_date DATE, hour INT, reading DOUBLE, temperature DOUBLE``."""
    h = _hours(events)
    return h.select(
        "meter_id",
        F.col("day").alias("read_date"),
        F.col("hour").cast("int").alias("hour"),
        "reading",
        temperature_formula(F.col("meter_id"), F.col("day"), F.col("hour")).alias("temperature"),
    )


def load_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
