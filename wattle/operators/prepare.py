"""Raw readings -> complete days -> daily points -> seed centroids.

Plan shape (at any scale):

  text scan -> parse/filter (narrow)
  -> groupBy(meter, day) with 24 conditional slots       shuffle 1, map-side combined
  -> lag/lead over days of a meter (window sizes > 24)   shuffle 2, one row per meter-day
  -> seeds: md5-ordered top-k (TakeOrderedAndProject, k <= 100 rows reach the driver side)

A meter's window holds one row per calendar day it reported, so a "hot" meter with
duplicated raw rows cannot blow up the window: duplicates are folded away (and the day
rejected) by the partial aggregate in shuffle 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import parse_reading
from ..functions.shapes import crop, normalize

HOURS = 24
FULL_DAY_MASK = (1 << HOURS) - 1


def ingest_lines(lines: DataFrame, col: str = "line", sep: str = "\t") -> DataFrame:
    """Parse raw reading lines ``meter<sep>yyyy-MM-dd HH:mm:ss[...]<sep>reading[<sep>...]``.

    Keeps rows with more than two fields whose reading is non-empty, matches the numeric
    rule and parses; extra fields are ignored. The day and hour are read from the text as
    wall-clock values (an offset suffix after the seconds is ignored). Rows whose meter,
    date or hour do not parse, or whose hour is outside 0..23, are dropped.

    Returns ``meter_id BIGINT, day DATE, hour INT, reading DOUBLE``.
    """
    f = F.split(F.col(col), sep)
    ts = F.try_element_at(f, F.lit(2))
    date_part = F.try_element_at(F.split(ts, " "), F.lit(1))
    time_part = F.try_element_at(F.split(ts, " "), F.lit(2))
    hour = F.try_element_at(F.split(time_part, ":"), F.lit(1)).try_cast("int")
    out = lines.select(
        F.try_element_at(f, F.lit(1)).try_cast("long").alias("meter_id"),
        F.try_to_date(date_part, "yyyy-MM-dd").alias("day"),
        hour.alias("hour"),
        F.when(F.size(f) > 2, parse_reading(F.try_element_at(f, F.lit(3)))).alias("reading"),
    )
    return out.where(
        F.col("meter_id").isNotNull()
        & F.col("day").isNotNull()
        & F.col("hour").between(0, HOURS - 1)
        & F.col("reading").isNotNull()
    )


def _finite_positive(c: Column) -> Column:
    return (c > 0.0) & ~F.isnan(c) & (c < float("inf"))


def complete_days(readings: DataFrame, strict: bool = True) -> DataFrame:
    """One 24-slot day per (meter, day) that is complete.

    Complete = exactly 24 rows and a positive (finite) daily sum; ``strict`` (default) also
    requires the 24 rows to cover 24 distinct hours, so a duplicate plus a missing hour is
    rejected instead of producing a null slot. Every statistic is a partial aggregate
    (count, bit_or, sum, max per slot), so a hot meter-day is combined map-side.

    ``readings``: ``meter_id, day, hour, reading`` -> ``meter_id, day, x ARRAY<DOUBLE>``.
    """
    g = readings.groupBy("meter_id", "day").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bit_or(F.expr("shiftleft(1, hour)")).alias("_mask"),
        F.sum("reading").alias("_total"),
        F.expr("array(" + ", ".join(f"max(CASE WHEN hour = {h} THEN reading END)" for h in range(HOURS))
               + ")").alias("x"),
    )
    keep = (F.col("_n") == HOURS) & _finite_positive(F.col("_total"))
    if strict:
        keep = keep & (F.col("_mask") == FULL_DAY_MASK)
    return g.where(keep).select("meter_id", "day", "x")


def check_window(window_size: int) -> int:
    """Margin hours on each side: half of what exceeds 24, rounded down."""
    n = (window_size - HOURS) // 2
    if not 0 <= n <= HOURS:
        raise ValueError(f"a window holds 24 hours and at most a day on each side, got {window_size}")
    return n


def daily_points(days: DataFrame, window_size: int = HOURS) -> DataFrame:
    """Daily points with ``n = (window_size - 24) / 2`` margin hours on each side.

    The margins come from the previous and next *valid* day of the same meter (gaps in the
    calendar are ignored); a meter's first and last valid day have no point. With
    ``window_size = 24`` the days are returned as they are.

    ``days``: ``meter_id, day, x`` -> ``meter_id, day, x ARRAY<DOUBLE>`` of ``24 + 2n``.
    """
    n = check_window(window_size)
    if n == 0:
        return days.select("meter_id", "day", "x")
    w = Window.partitionBy("meter_id").orderBy("day")
    prev, nxt = F.lag("x").over(w), F.lead("x").over(w)
    return (
        days.select("meter_id", "day", "x", prev.alias("_prev"), nxt.alias("_next"))
        .where(F.col("_prev").isNotNull() & F.col("_next").isNotNull())
        .select(
            "meter_id",
            "day",
            F.concat(
                F.slice("_prev", HOURS - n + 1, n), F.col("x"), F.slice("_next", 1, n)
            ).alias("x"),
        )
    )


def is_finite(x: Column | str = "x") -> Column:
    """Whether a point has values and every one is a finite number."""
    x = F.col(x) if isinstance(x, str) else x
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(x) > 0) & ok, F.lit(False))


def point_key(meter_id: Column | str = "meter_id", day: Column | str = "day") -> Column:
    """Text id of a point for hashing/export: ``meter|yyyy-MM-dd``."""
    m = F.col(meter_id) if isinstance(meter_id, str) else meter_id
    d = F.col(day) if isinstance(day, str) else day
    return F.concat_ws("|", m.cast("string"), F.date_format(d, "yyyy-MM-dd"))


def seed_centroids(points: DataFrame, k: int = 100, salt: str = "seed") -> DataFrame:
    """``k`` seed centroids sampled without replacement from the points.

    Each seed is the point's centre 24 hours normalised to sum 1. The sample is the k
    points with the smallest md5 of (salt, point key): reproducible, uniform, and planned
    as a top-k (each partition keeps k rows), never a global sort. Fewer points than k ->
    all of them. Returns ``cid INT (1..k), n BIGINT (=1), c ARRAY<DOUBLE>``.
    """
    key = F.md5(F.concat_ws("|", F.lit(salt), point_key()))
    top = (
        points.where(is_finite()).select(key.alias("_key"), "meter_id", "day", normalize(crop("x", HOURS)).alias("c"))
        .orderBy("_key", "meter_id", "day")
        .limit(k)
    )
    # At most k (<= a few hundred) rows remain, so the global numbering window is cheap.
    w = Window.orderBy("_key", "meter_id", "day")
    return top.select(
        F.row_number().over(w).cast("int").alias("cid"), F.lit(1).cast("long").alias("n"), "c"
    )


def meter_slice(readings: DataFrame, meter_id, start, end, ts_col: str = "read_ts") -> DataFrame:
    """Readings of one meter between two timestamps (inclusive): pushed down to the scan."""
    return readings.where((F.col("meter_id") == meter_id) & F.col(ts_col).between(start, end))
