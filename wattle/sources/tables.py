"""Meter-days as tables that later jobs read without a shuffle, or without most of their files.

* by month or day: a folder for each; a date range reads the folders it touches, and since the files
  are ranges of (month, meter, day), a meter reads the row groups it lies in.
* by meter: a bucketed catalog table; what groups or windows by meter afterwards (extended
  windows, entropies, profiles) plans no exchange.

Both are written by one shuffle whose ranges, or buckets, split the rows by more than one meter or
month. A bucket holds the rows of its meters: at most one row for each calendar day and meter, so no
meter outweighs the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PERIOD = "period"
UNITS = {"month": "yyyyMM", "day": "yyyyMMdd"}


def period_of(day: Column | str, unit: str = "month") -> Column:
    """The partition of a day as a number, ``yyyyMM`` or ``yyyyMMdd`` (null: the null partition)."""
    return F.date_format(F.col(day) if isinstance(day, str) else day, UNITS[unit]).cast("int")


def write_periods(rows: DataFrame, path: str, tasks: int, unit: str = "month", day: str = "day", key: str = "meter_id",
                  mode: str = "errorifexists") -> None:
    """Write ``rows`` by month (or by ``unit`` day, for tables with very many meters). The ranges of
    (period, key, day) are sampled from the rows, so a month, or a key, with a third of all rows
    becomes as many files as it needs. ``tasks``: about the output's size over the size wanted
    for a file."""
    ranged = rows.withColumn(PERIOD, period_of(day, unit)).repartitionByRange(tasks, PERIOD, key, day)
    ranged.sortWithinPartitions(PERIOD, key, day).write.mode(mode).partitionBy(PERIOD).parquet(path)


def read_periods(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, unit: str = "month",
                 day: str = "day") -> DataFrame:
    """The rows from ``first`` to ``last`` (``yyyy-MM-dd``, inclusive; None: open), without the
    period column. The periods follow from the dates, so folders outside are not read."""
    df = spark.read.parquet(path)
    for bound, keep in ((first, lambda c, b: c >= b), (last, lambda c, b: c <= b)):
        if bound is not None:
            date = F.lit(bound).cast("date")
            df = df.where(keep(F.col(PERIOD), period_of(date, unit)) & keep(F.col(day), date))
    return df.drop(PERIOD)


def write_bucketed(rows: DataFrame, table: str, buckets: int, path: str | None = None, key: str = "meter_id",
                   order: tuple = ("meter_id", "day"), mode: str = "errorifexists") -> DataFrame:
    """Write ``rows`` as a catalog table of ``buckets`` buckets by ``key`` (one file each, sorted by
    ``order``) and return the table. ``path``: a folder of its own instead of the warehouse."""
    writer = rows.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(*order)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return rows.sparkSession.table(table)
