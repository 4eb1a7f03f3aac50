"""Synthetic hourly load and temperature series from fitted activity profiles.

For series s = 0..N-1 (``spark.range``, split into ``parallelism`` partitions):

* a seed profile is drawn uniformly with replacement from the profiles,
* temperature[i] = seed_temperature[i mod L] + N(0, 2.0) for hours i = 0..24*days-1,
* thermal load: piecewise linear in temperature from the series' minimum temperature X0,
  offset Y0 = |N(0,1)| / 1.5, breakpoints X1 = 10 + U{0..5} and X2 = X1 + 4 + U{0..8},
  clamped to [0, 0.2],
* activity[h] = max(0, profile_mean[h] + N(0, 0.1)),
* load = activity + thermal, then peaks are amplified: with the day mean m, an hour
  above m becomes m + (load - m) * peaky_ratio.

Every draw is an md5 of (seed, series, hour): results do not depend on partitioning and a
retried task reproduces its rows exactly. The range source is range-partitioned on the
series id and ``explode`` keeps that, so the per-series minimum and the per-day mean are
windows without any shuffle. Joins with the profile and temperature tables broadcast only
below a size bound computed from their row counts; above it they shuffle.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import digest, gaussian, randint

# Slopes of the three thermal-load sections, one row per profile family.
# They are rounded through 32-bit floats; the generator uses the first row.
THERMAL_SLOPES = [
    (-0.0059, 0.0155, 0.2233),
    (-0.0136, -0.0049, 0.0315),
    (-0.0079, 0.0112, 0.1365),
    (-0.0146, 0.0034, 0.0774),
]
TEMPERATURE_SD = 2.0
ACTIVITY_SD = 0.1
THERMAL_MAX = 0.2
Y0_SCALE = 1.5
X1_BASE, X1_SPAN = 10, 6
X2_GAP, X2_SPAN = 4, 9

NUMBERING_BUCKETS = 1021
BROADCAST_BYTES = 64 << 20
PROFILE_ROW_BYTES = 8 * (24 + 4)
TEMPERATURE_ROW_BYTES = 32


def as_float32(v: float) -> float:
    return struct.unpack("f", struct.pack("f", v))[0]


def slopes(row: int = 0) -> tuple[float, float, float]:
    return tuple(as_float32(v) for v in THERMAL_SLOPES[row])


def dense_index(df: DataFrame, key: str, buckets: int = NUMBERING_BUCKETS) -> DataFrame:
    """Adds ``idx`` = 0..n-1, a bijection onto the rows ordered by (bucket, key).

    Distributed: rows are ranked inside ``buckets`` md5 buckets of the key (one shuffle;
    md5 spreads any id pattern evenly) and offset by the running count of the buckets
    before them (at most ``buckets`` rows, broadcast).
    """
    b = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"),
               F.lit(buckets))
    with_b = df.withColumn("_b", b)
    counts = with_b.groupBy("_b").agg(F.count(F.lit(1)).alias("_cnt"))
    # at most `buckets` rows: the running sum is a single small task
    offsets = counts.select(
        "_b",
        F.coalesce(F.sum("_cnt").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
    )
    ranked = with_b.withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    return ranked.join(F.broadcast(offsets), "_b").withColumn(
        "idx", (F.col("_off") + F.col("_rn") - 1).cast("long")
    ).drop("_b", "_rn", "_off")


def _maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def series_parameters(spark, n_series: int, n_profiles: int, parallelism: int, seed: int = 7) -> DataFrame:
    """``series_id, idx, y0, x1, x2`` per series (range-partitioned on series_id)."""
    s = spark.range(0, n_series, 1, parallelism).withColumnRenamed("id", "series_id")
    d1 = digest(seed, "series", F.col("series_id"))
    d2 = digest(seed, "thermal", F.col("series_id"))
    x1 = F.lit(X1_BASE) + randint(d1, 3, X1_SPAN)
    return s.select(
        "series_id",
        randint(d1, 0, n_profiles).alias("idx"),
        (F.abs(gaussian(d1, 1)) / F.lit(Y0_SCALE)).alias("y0"),
        x1.cast("double").alias("x1"),
        (x1 + F.lit(X2_GAP) + randint(d2, 0, X2_SPAN)).cast("double").alias("x2"),
    )


def thermal_load(t, x0, y0, x1, x2, slope_row: int = 0):
    s0, s1, s2 = (F.lit(v) for v in slopes(slope_row))
    base1 = s0 * (x1 - x0) + y0
    y = (F.when(t < x1, s0 * (t - x0) + y0)
         .when(t < x2, s1 * (t - x1) + base1)
         .otherwise(s2 * (t - x2) + s1 * (x2 - x1) + base1))
    return F.least(F.greatest(y, F.lit(0.0)), F.lit(THERMAL_MAX))


def synthesize(profiles: DataFrame, temperatures: DataFrame, n_series: int, n_days: int,
               start_date: str, peaky_ratio: float, parallelism: int = 8, seed: int = 7,
               detail: bool = False, noise: str = "constant", slope_row: int = 0) -> DataFrame:
    """``series_id, seed_meter_id, read_ts, load, temperature`` (24 * n_days rows per series).

    ``profiles``: ``meter_id, mean ARRAY<DOUBLE>(24)`` (+ ``sd`` for ``noise="profile"``; see
    ``profile.profile_arrays``). ``temperatures``: ``pos (0..L-1), temperature`` — the
    temperature seed, cycled. ``noise="constant"`` draws activity with sd 0.1 (the original
    behaviour); ``"profile"`` uses the profile's own standard deviation for the hour.
    ``slope_row`` picks the row of ``THERMAL_SLOPES``.
    """
    if noise not in ("constant", "profile"):
        raise ValueError("noise must be 'constant' or 'profile'")
    spark = profiles.sparkSession
    n_profiles = profiles.count()
    n_temps = temperatures.count()
    if n_profiles == 0 or n_temps == 0:
        raise ValueError("need at least one profile and one seed temperature")
    hours = 24 * n_days

    prof_cols = ["meter_id", "mean"] + (["sd"] if noise == "profile" else [])
    numbered = dense_index(profiles.select(*prof_cols), "meter_id")
    params = series_parameters(spark, n_series, n_profiles, parallelism, seed)
    series = params.join(_maybe_broadcast(numbered, n_profiles, PROFILE_ROW_BYTES), "idx")
    if n_profiles * PROFILE_ROW_BYTES > BROADCAST_BYTES:
        # shuffled join: put the series back on their own partitioning before expanding
        series = series.repartition(parallelism, "series_id")

    i = F.col("i")
    rows = series.select(
        "series_id", F.col("meter_id").alias("seed_meter_id"), "mean", *(["sd"] if noise == "profile" else []),
        "y0", "x1", "x2",
        F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("i"),
    ).withColumn("pos", F.pmod(i, F.lit(n_temps)))
    temps = temperatures.select(F.col("pos").cast("long").alias("pos"), F.col("temperature").alias("_seed_t"))
    rows = rows.join(_maybe_broadcast(temps, n_temps, TEMPERATURE_ROW_BYTES), "pos")

    dh = digest(seed, "hour", F.col("series_id"), i)
    sd = F.element_at("sd", F.pmod(i, F.lit(24)) + 1) if noise == "profile" else F.lit(ACTIVITY_SD)
    rows = rows.withColumns({
        "_d": (i / 24).cast("int"),
        "temperature": F.col("_seed_t") + F.lit(TEMPERATURE_SD) * gaussian(dh, 0),
        "_act": F.greatest(F.element_at("mean", F.pmod(i, F.lit(24)) + 1) + sd * gaussian(dh, 2), F.lit(0.0)),
    })
    rows = rows.withColumn("x0", F.min("temperature").over(Window.partitionBy("series_id")))
    rows = rows.withColumn("thermal", thermal_load(F.col("temperature"), F.col("x0"), F.col("y0"),
                                                   F.col("x1"), F.col("x2"), slope_row))
    rows = rows.withColumn("_load", F.col("_act") + F.col("thermal"))
    rows = rows.withColumn("_avg", F.avg("_load").over(Window.partitionBy("series_id", "_d")))
    diff = F.col("_load") - F.col("_avg")
    load = F.when(diff > 0.0, F.col("_avg") + diff * F.lit(float(peaky_ratio))).otherwise(F.col("_load"))
    ts = F.to_timestamp_ntz(F.lit(start_date)) + F.make_dt_interval(F.lit(0), i)
    cols = [F.col("series_id"), F.col("seed_meter_id"), ts.alias("read_ts"), load.alias("load"),
            F.col("temperature")]
    if detail:
        cols += [F.col("i"), F.col("_d").alias("day_index"), F.col("_act").alias("activity"), "thermal",
                 "x0", "y0", "x1", "x2"]
    return rows.select(*cols)


def temperature_seed(weather: DataFrame) -> DataFrame:
    """``pos, temperature``: the hourly mean temperature over all meters, in time order.

    Grouped by (date, hour), so the table has at most 24 rows per calendar day and its
    numbering window is a small single task.
    """
    hourly = weather.groupBy("read_date", "hour").agg(F.avg("temperature").alias("temperature"))
    w = Window.orderBy("read_date", "hour")
    return hourly.select((F.row_number().over(w) - 1).cast("long").alias("pos"), "temperature")


def format_lines(synthetic: DataFrame) -> DataFrame:
    """Text export ``series|yyyy-MM-dd H:00:00|load|temperature`` (hour not zero-padded,
    six decimals)."""
    return synthetic.select(
        F.format_string("%d|%s|%f|%f", F.col("series_id"),
                        F.date_format("read_ts", "yyyy-MM-dd H:00:00"),
                        F.col("load"), F.col("temperature")).alias("value")
    )
