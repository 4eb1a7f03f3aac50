"""Hot keys: a meter holding a third of all rows, a cluster holding most points."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattle.operators import ksc, prepare as pr, profile as pf

D0 = dt.date(2024, 1, 1)


def test_hot_meter_day_is_folded_and_rejected(spark):
    # meters 1..40: 5 clean days each; meter 0: one day whose 24 hours are repeated so that
    # it holds a third of all rows (duplicates -> not a complete day)
    normal = (spark.range(1, 41).select(F.col("id").alias("meter_id"),
                                        F.explode(F.sequence(F.lit(0), F.lit(5 * 24 - 1))).alias("k"))
              .select("meter_id", F.date_add(F.lit(D0), (F.col("k") / 24).cast("int")).alias("day"),
                      (F.col("k") % 24).cast("int").alias("hour"), ((F.col("k") % 24) + 1.0).alias("reading")))
    n_normal = normal.count()
    hot = spark.range(0, n_normal // 2).select(F.lit(0).cast("long").alias("meter_id"), F.lit(D0).alias("day"),
                                               (F.col("id") % 24).cast("int").alias("hour"), F.lit(1.0).alias("reading"))
    readings = normal.unionByName(hot)
    days = pr.complete_days(readings)
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "partial_bit_or" in plan     # combined before the shuffle
    got = days.groupBy("meter_id").count().collect()
    assert {r.meter_id for r in got} == set(range(1, 41)) and all(r["count"] == 5 for r in got)


def test_hot_cluster_update_is_combined(spark):
    rows = [(i, [1.0] * 12 + [0.0] * 12 if i % 10 else [0.0] * 12 + [1.0] * 12) for i in range(3000)]
    pts = spark.createDataFrame(rows, "meter_id bigint, x array<double>").repartition(6)
    model = {1: (1, [1.0 / 12] * 12 + [0.0] * 12), 2: (1, [0.0] * 12 + [1.0 / 12] * 12)}
    up = {r.cid: r.n for r in ksc.update(ksc.assign(pts, model, 0)).collect()}
    assert up == {1: 2700, 2: 300}


def hot_meter_hour(spark, copies):
    """A third of all rows in one (meter, hour): on as many dates, or copies of a few rows."""
    normal = spark.range(0, 300 * 60).select((F.col("id") % 300).alias("meter_id"), F.date_add(F.lit(D0), (F.col("id") / 300).cast("int")).alias("read_date"),
                                             F.lit(3).alias("hour"), (F.col("id") % 97 + 0.5).alias("reading"), (F.col("id") % 37 - 2.0).alias("temperature"))
    day = F.col("id") % 3 if copies else F.col("id")
    hot = spark.range(0, 9000).select(F.lit(999).cast("long").alias("meter_id"), F.date_add(F.lit(D0), day.cast("int")).alias("read_date"),
                                      F.lit(3).alias("hour"), (day * 7 % 31 + 0.5).alias("reading"), (day * 5 % 37 - 2.0).alias("temperature"))
    return normal.unionByName(hot)


def rows_by_task(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_hot_meter_hour_is_spread_over_tasks(spark, monkeypatch):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    monkeypatch.setattr(pf, "COPY_CHUNK", 50)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # as if the tables were large
        for copies in (False, True):
            d = hot_meter_hour(spark, copies)
            for out in (pf.with_lags(d), pf.activity(d)):
                n = rows_by_task(out)
                assert sum(n) == 27_000 and n[-1] <= 3 * n[len(n) // 2], (copies, n)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_hot_meter_hour_has_the_same_answers(spark):
    d = hot_meter_hour(spark, False)
    lone = d.where("meter_id = 999")
    a, b = [[tuple(r) for r in pf.fit_betas(x).where("meter_id = 999").collect()] for x in (d, lone)]
    assert len(a) == 1 and a[0] == pytest.approx(b[0], rel=1e-9)
