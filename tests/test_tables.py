"""Tables by month prune their files, tables by meter need no exchange; both keep every row."""

import datetime as dt
import glob
import re

from pyspark.sql import functions as F

from wattle.operators import ksc, prepare as pr, profile as pf
from wattle.plans import catalog as C
from wattle.sources import fixtures as fx, tables as tb

from conftest import SF001
from test_plans import exchanges, plan


def rows(df):
    return sorted(map(str, df.collect()))


def entropies(df):
    return rows(df.withColumn("entropy", F.round("entropy", 9)))


def test_a_date_range_reads_its_months(spark, scratch):
    days = fx.full_days(C.events(spark, SF001)).withColumn("day", F.date_add("day", (F.col("meter_id") % 4 * 31).cast("int"))).cache()
    tb.write_periods(days, f"{scratch}/m", 4)
    tb.write_periods(days, f"{scratch}/d", 4, "day")
    months = sorted(p.rsplit("=", 1)[1] for p in glob.glob(f"{scratch}/m/period=*"))
    first, last = days.agg(F.min("day"), F.max("day")).first()
    assert len(months) > 1 and rows(tb.read_periods(spark, f"{scratch}/m")) == rows(days)
    for a, b in ((first, first), (first, last), (last, None), (None, first), (first + dt.timedelta(9), first + dt.timedelta(12))):
        got = tb.read_periods(spark, f"{scratch}/m", a and str(a), b and str(b))
        want = days.where(F.col("day").between(a or first, b or last))
        assert rows(got) == rows(want) == rows(tb.read_periods(spark, f"{scratch}/d", a and str(a), b and str(b), "day"))
    one = tb.read_periods(spark, f"{scratch}/m", str(first), str(first))
    p = plan(one.select("meter_id"))
    assert re.search(r"PartitionFilters: \[[^\]]*period#\d+ >= 20\d{4}", p)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(day", p) and "x:array" not in p
    read = {r[0] for r in one.select(F.input_file_name()).distinct().collect()}
    assert read and all(f"period={first:%Y%m}" in f for f in read)


def test_a_hot_month_is_split_and_null_days_stay(spark, scratch):
    df = spark.range(4000).select(F.lit(1).cast("long").alias("meter_id"), F.expr("date_add(date'2024-03-01', cast(id % 31 AS INT))").alias("day"), "id")
    df = df.union(spark.createDataFrame([(2, None, -1)], "meter_id long, day date, id long"))
    tb.write_periods(df, f"{scratch}/m", 8)
    assert len(glob.glob(f"{scratch}/m/period=202403/*.parquet")) > 4
    assert rows(tb.read_periods(spark, f"{scratch}/m")) == rows(df)
    tb.write_periods(df.limit(0), f"{scratch}/empty", 8)


def test_buckets_need_no_exchange(spark, scratch):
    days = fx.full_days(C.events(spark, SF001)).cache()
    t = tb.write_bucketed(days, "t_days", 4, f"{scratch}/days")
    pts = pr.daily_points(t, 26)
    assert exchanges(plan(pts)) == 0 and rows(pts) == rows(pr.daily_points(days, 26))
    assert len(glob.glob(f"{scratch}/days/*.parquet")) <= 4          # one file a bucket

    tags = days.select("meter_id", "day", (F.dayofmonth("day") % 3).alias("cid"))
    t = tb.write_bucketed(tags, "t_tags", 4, f"{scratch}/tags")
    e = ksc.meter_entropy(t)
    assert exchanges(plan(e)) == 0 and entropies(e) == entropies(ksc.meter_entropy(tags))

    prof = days.select("meter_id", F.posexplode("x").alias("hour", "mean")).groupBy("meter_id", "hour").agg(F.max("mean").alias("mean"), F.lit(0.5).alias("sd"))
    t = tb.write_bucketed(prof, "t_prof", 4, f"{scratch}/prof", order=("meter_id", "hour"))
    a = pf.profile_arrays(t)
    assert exchanges(plan(a)) == 0 and rows(a) == rows(pf.profile_arrays(prof))
    for name in ("t_days", "t_tags", "t_prof"):
        spark.sql(f"DROP TABLE {name}")
